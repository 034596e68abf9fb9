"""The corpus pipeline: its stages, and all of them in turn. They are defined in the subpackage of the operators."""

from briefloom.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
