"""Report output: JSON, overwritten or not, and Markdown tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_new(df: DataFrame, path: str) -> None:
    """Writes JSON; refuses a path that exists. The committer makes the result appear as a whole."""
    df.write.mode("errorifexists").json(path)


# A file name, and a part of a path, that no report may take.
PROTECTED_NAMES = (".env.local",)
PROTECTED_PARTS = ("/tests/fixtures/review-radar-live/",)


def write_staged(df: DataFrame, path: str) -> None:
    """Writes JSON beside ``path`` and then renames it, so that readers see the old report or the whole new one.

    A job that fails leaves nothing, and what stood there stays. Protected paths are refused before anything is read.
    """
    plain = path.replace("\\", "/").lower()
    if plain.rstrip("/").rpartition("/")[2] in PROTECTED_NAMES or any(p in f"{plain.rstrip('/')}/" for p in PROTECTED_PARTS):
        raise ValueError(f"a protected path: {path}")
    spark = df.sparkSession
    hadoop, folder = spark._jvm.org.apache.hadoop.fs.Path, path.rstrip("/")
    target, staged = hadoop(folder), hadoop(f"{folder}.{uuid.uuid4().hex}.tmp")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.mode("errorifexists").json(staged.toString())
        files.delete(target, True)
        if not files.rename(staged, target):
            raise OSError(f"{staged.toString()} can't be renamed to {path}")
    finally:
        files.delete(staged, True)


def write_plain(df: DataFrame, path: str) -> None:
    """Writes JSON in place of what stands there."""
    df.write.mode("overwrite").json(path)


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("n/a")) for c in cells]), F.lit(" |"))


def markdown_rows(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(line): a row of a Markdown table for each row, in order."""
    return df.orderBy(*order).select(markdown_row(*[F.col(c) for c in columns]).alias("line"))


def percent(rate: Column) -> Column:
    return F.when(rate.isNull(), "n/a").otherwise(F.format_string("%.1f%%", rate * 100))
