"""Tables written between jobs, in the folder of spark.checkpoint.dir that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession) -> str:
    """A new path in the shared folder. Where none is set, a local master gets a temporary one; a cluster's session is refused."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="briefloom-"))
        folder = sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/stored-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: what several branches read is computed once, and lost executors re-read files."""
    spark = df.sparkSession
    path = place(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession, rows: int) -> int:
    """Parts that so many rows are dealt to by a key: half a million a part, and no fewer parts than a shuffle or two rounds of all cores have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-rows // 500_000))


def stored_by(df: DataFrame, key: str, n: int) -> DataFrame:
    """``stored`` in ``n`` buckets of a key: joins and groups by it read them as they were dealt. ``df`` should be dealt to ``n`` parts by that key already, else each part writes a file per bucket."""
    spark = df.sparkSession
    name = f"stored_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("path", place(spark)).saveAsTable(name, format="parquet")
    out = spark.table(name)
    # the name is not needed any more; files outside the warehouse stay
    spark.sql(f"DROP TABLE {name}")
    return out
