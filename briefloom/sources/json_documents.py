"""JSON input: bodies with a byte limit, whole documents with a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BYTES = 64 * 1024


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; null for a null text.

    Spark's parser stops after the first value ("12 apples" is 12 to it). What follows a value is refused by an array
    around the text or by an object around it: no text goes on after its first value inside both.
    """
    within = lambda start, end: F.try_parse_json(F.concat(F.lit(start), text, F.lit(end))).isNotNull()
    return F.when(text.isNotNull(), within("[", "]") & within('{"a":', "}"))


def body_problem(raw: Column, content_length: Column | None = None, max_bytes: int = DEFAULT_BYTES) -> Column:
    """Why a body is refused, the first reason that holds; null for a good one. raw: binary or string."""
    size = F.octet_length(raw)
    out = F.when(size > max_bytes, "too_large").when(~F.is_valid_utf8(raw.cast("string")), "invalid_encoding").when(~F.coalesce(is_json(raw.cast("string")), F.lit(False)), "invalid_json")
    if content_length is None:
        return out
    declared = content_length.try_cast("decimal(38,0)")
    return F.when(content_length.isNotNull() & ~content_length.rlike(r"^\d+$"), "invalid_content_length").when(declared > max_bytes, "too_large").otherwise(out)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row per file, fields by declared schema; what isn't declared is not read."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_files(spark: SparkSession, path: str, schema: T.StructType | str, max_bytes: int = 64 << 20) -> DataFrame:
    """(path, length, sha256, problem, document): a row per file below ``path``, with the digest of its bytes and its fields by ``schema``.

    A broken file is a row with a ``body_problem`` and a null document, not a failure; one over ``max_bytes`` is not read at
    all: its length is known without its content, and so it has no digest. Spark passes over files without any byte.
    """
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    size = F.col("length")
    text = F.col("content").cast("string")
    held = files.where(size <= max_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"), body_problem(F.col("content"), max_bytes=max_bytes).alias("problem"), text.alias("_text"))
    held = held.select("path", "length", "sha256", "problem", F.when(F.col("problem").isNull(), F.from_json("_text", schema)).alias("document"))
    large = files.where(size > max_bytes).select("path", "length", F.lit(None).cast("string").alias("sha256"), F.lit("too_large").alias("problem"), F.lit(None).cast(schema).alias("document"))
    return held.unionAll(large)
