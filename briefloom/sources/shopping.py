"""Recorded answers of shopping searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Listings of an answer that are read.
LISTINGS_MOST = 10
SCHEMA = "shopping array<struct<title:string,imageUrl:string,link:string,productId:string>>"


def listings(rows: DataFrame, body: str, most: int = LISTINGS_MOST) -> DataFrame:
    """(``rows`` without ``body``, rank, title, image_url, link, product_id): the first listings of each recorded JSON answer, from rank 1 on. What is no answer has none."""
    kept = [c for c in rows.columns if c != body]
    found = F.slice(F.from_json(F.col(body), SCHEMA)["shopping"], 1, most)
    given = rows.select(*kept, F.posexplode(found).alias("_at", "_l")).where("_l is not null")
    return given.select(*kept, (F.col("_at") + 1).alias("rank"), F.col("_l.title").alias("title"), F.col("_l.imageUrl").alias("image_url"), F.col("_l.link").alias("link"), F.col("_l.productId").alias("product_id"))
