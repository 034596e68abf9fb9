"""Judgments of displayed products, from decisions by position, earlier judgments and defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checked(rows: DataFrame, good: Column, told: Column) -> DataFrame:
    """``rows``; fails where ``good`` doesn't hold. A filter on the check, so that no projection can prune it away."""
    return rows.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(told).cast("boolean")))


def of_known_cases(runs: DataFrame, cases: DataFrame, case: str) -> DataFrame:
    """``runs``; fails on a run of a case that ``cases`` lacks."""
    known = cases.select(F.col(case).alias("_case")).distinct()
    both = runs.join(known, F.col(case) == F.col("_case"), "left")
    return _checked(both, F.col("_case").isNotNull(), F.concat(F.lit("unknown case: "), F.coalesce(F.col(case).cast("string"), F.lit("none")))).drop("_case")


def with_binding(decisions: DataFrame, files: DataFrame, digest: str) -> DataFrame:
    """``decisions`` with path and bound: the file (``json_documents.read_files``) whose bytes have the digest that they name; the first by path, if several have. Null and false for none."""
    seen = files.where("sha256 is not null").groupBy("sha256").agg(F.min("path").alias("path"))
    return decisions.join(seen, F.lower(F.col(digest)) == F.col("sha256"), "left").withColumn("bound", F.col("path").isNotNull()).drop("sha256")


def of_bound_runs(decisions: DataFrame, files: DataFrame, digest: str) -> DataFrame:
    """``decisions`` with the path of the run that they are bound to; fails where there is none."""
    return _checked(with_binding(decisions, files, digest), F.col("bound"), F.concat(F.lit("decisions are not bound to a run: "), F.coalesce(F.col(digest), F.lit("no digest")))).drop("bound")


def by_position(products: DataFrame, decisions: DataFrame, case: str, pos: str) -> DataFrame:
    """Products with the decision (struct ``decision``) that stands at their position; fails where one side lacks a partner."""
    right = decisions.select(F.col(case).alias("_case"), F.col(pos).alias("_pos"), F.struct(*[c for c in decisions.columns if c not in (case, pos)]).alias("decision"))
    both = products.withColumn("_here", F.lit(True)).join(right, (F.col(case) == F.col("_case")) & (F.col(pos) == F.col("_pos")), "full_outer")
    told = F.concat(F.lit("products and decisions differ in number: case "), F.coalesce(F.col(case), F.col("_case")).cast("string"))
    # a filter on the check, so that no projection can prune it away
    return both.where(F.when(F.col("_here").isNull() | F.col("_case").isNull(), F.raise_error(told).cast("boolean")).otherwise(True)).drop("_case", "_pos", "_here")


def duplicate_names(products: DataFrame, case: str, pos: str, name: str, duplicate_of: Column) -> DataFrame:
    """Adds duplicate_name: the name at the position that a product repeats; null for none. Fails on a position that is not there."""
    there = products.select(F.col(case).alias("_case"), F.col(pos).alias("_at"), F.col(name).alias("duplicate_name"), F.lit(True).alias("_there"))
    out = products.withColumn("_of", duplicate_of).join(there, (F.col(case) == F.col("_case")) & (F.col("_of") == F.col("_at")), "left")
    told = F.concat(F.lit("no such position to repeat: case "), F.col(case).cast("string"))
    # position 0 stands for none
    return out.where(F.when((F.col("_of") != 0) & F.col("_there").isNull(), F.raise_error(told).cast("boolean")).otherwise(True)).drop("_case", "_at", "_of", "_there")


def adjudicated(products: DataFrame, decisions: DataFrame, earlier: DataFrame, defaults: Mapping[str, object], case: str, pos: str, name: str, url: str, grade: str, reference_grade: Column, duplicate_of: str, seq: str) -> DataFrame:
    """One judgment per product: (case, pos, name, the fields of ``defaults``, grade, duplicate_name).

    A field is the decision's, else an earlier judgment's of the same case, name and link (the last by ``seq``), else the
    default; the grade is the decision's, else the reference's, else as other fields. Nulls stand for fields not set.
    """
    fields: Sequence[str] = list(defaults)
    keys = [case, name, url]
    last = earlier.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*fields), seq).alias("earlier"))
    rows = by_position(products, decisions, case, pos)
    rows = duplicate_names(rows, case, pos, name, F.col(f"decision.{duplicate_of}"))
    rows = rows.join(last, [F.coalesce(F.col(k).cast("string"), F.lit("")) == F.col(f"_{k}") for k in keys], "left")

    def merged(f: str) -> Column:
        between = [reference_grade] if f == grade else []
        return F.coalesce(F.col(f"decision.{f}"), *between, F.col(f"earlier.{f}"), F.lit(defaults[f])).alias(f)

    return rows.select(case, pos, name, *[merged(f) for f in fields], "duplicate_name")
