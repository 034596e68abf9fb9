"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one on a local master; an error on a cluster, whose executors couldn't read it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="briefloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def stash(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    Cuts the lineage: a lost executor re-reads files instead of recomputing, and the planner sees the real size. ``path``:
    a place of ``places`` that may be written over.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def places(spark: SparkSession) -> tuple[str, str]:
    """Two places for the rounds of a loop: each round reads one and writes over the other, so that old rounds don't pile up."""
    name = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    return f"{name}-0", f"{name}-1"
