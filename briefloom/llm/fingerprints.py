"""Document fingerprints: bottom-k sketches of shingle hashes, by Spark functions alone.

A sketch is the ascending array of the k smallest distinct hashes of a text's word shingles. Sketches of parts merge
to the sketch of the whole, and two sketches estimate resemblance, containment and numbers of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stash

K = 128
SHINGLE = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once: a lambda variable isn't computed anew at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of the n-word shingles (case kept apart from A-Z), in order. Fewer words: all of them as one; none: empty."""

    def of(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))
        return F.when(F.size(words) >= n, many).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    return let(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\x09-\\x0D]+"), lambda w: w != ""), of)


def bottom(hashes: Column, k: int = K) -> Column:
    """The sketch of an array of hashes.

    Of a long array only hashes below a bound are sorted, one that about 2 k + 64 of them pass; if too few do, all are.
    """
    span = F.lit(2.0**64)

    def of(h: Column) -> Column:
        bound = (F.lit(-(2.0**63)) + span * F.lit(float(2 * k + 64)) / F.size(h)).cast("long")
        few = F.array_distinct(F.filter(h, lambda x: x < bound))
        plain = lambda a: F.slice(F.sort_array(a), 1, k)
        return F.when(F.size(h) <= 4 * k + 128, plain(F.array_distinct(h))).otherwise(let(few, lambda f: F.when(F.size(f) >= k, plain(f)).otherwise(plain(F.array_distinct(h)))))

    return let(hashes, of)


def sketch(text: Column, n: int = SHINGLE, k: int = K) -> Column:
    return bottom(shingle_hashes(text, n), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(rows: DataFrame, by: Sequence[str], sketches: str, k: int = K, parts: int = 64) -> DataFrame:
    """(by, ``sketches``): the sketch of all parts of each group.

    Distinct hashes are dealt to parts of a group, each of which keeps its k smallest, and then the group its k: no task
    has all of a large group, and no array more than k hashes. Groups of empty sketches have an empty one.
    """
    keys = list(by)
    each = rows.select(*keys, F.explode(sketches).alias("_h")).distinct().withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(parts)))
    least = lambda df, *within: df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, *within).orderBy("_h"))).where(F.col("_r") <= k)
    found = least(least(each, "_part")).groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketches))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    groups = rows.select(*keys).distinct().join(found.toDF(*[f"_{key}" for key in keys], sketches), same, "left")
    return groups.select(*keys, F.coalesce(sketches, F.array().cast("array<bigint>")).alias(sketches))


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact under k."""
    top = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / top)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance; two empty sketches: 1, one: 0."""
    of = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(let(merge(a, b, k), of))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too."""
    j = resemblance(a, b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), let(j, lambda x: x * distinct_count(merge(a, b, k), k) / distinct_count(a, k))))


def fingerprint(s: Column) -> Column:
    """A sketch as text, 16 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


#: Stands for a null key: under all others, so that plain joins and groupings hold for it too.
_NULL = -(2**63) - 1


def _held(key: Column) -> Column:
    return F.coalesce(key.cast("long").cast("decimal(20,0)"), F.lit(str(_NULL)).cast("decimal(20,0)"))


def followers(docs: DataFrame) -> DataFrame:
    """(id, next_id) in descending order of id; the first follows the last. Whole order without one sorted partition."""
    ids = docs.groupBy("id").agg(F.lit(1).alias("one")).select("id")
    parts = max(1, ids.sparkSession.sparkContext.defaultParallelism * 4)
    dealt = stash(ids.repartitionByRange(parts, F.col("id").desc()).withColumn("part", F.spark_partition_id()))
    along = Window.partitionBy("part").orderBy(F.col("id").desc())
    inner = dealt.withColumn("inner_id", F.lead("id").over(along))
    heads = dealt.groupBy("part").agg(F.max("id").alias("head"))
    # one row per partition
    order = Window.orderBy("part")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(every)).alias("later"))
    return inner.join(heads, "part").select("id", F.coalesce("inner_id", "later").alias("next_id"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the next document's beginning replaces the last third.

    Returns ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null and empty
    texts have the empty fingerprint; two empty ones are alike (1). Of rows that repeat a key, the smallest text stands
    for the key as the next document; each row keeps a row of its own. A null key comes last in the order. An only
    document follows itself. Columns beside ``key`` and ``text`` are not read.
    """
    texts = docs.select(_held(F.col(key)).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    lengths = texts.groupBy("id").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("need"))
    wanted = stash(followers(texts).join(lengths, "id").select(F.col("id").alias("for"), F.col("next_id").alias("id"), "need"))
    # what the next document gives, at its own place: its beginning and its sketch; only these move on
    given = texts.join(wanted, "id").select("for", F.struct(F.substring("text", F.lit(1), F.col("need")).alias("head"), sketch(F.col("text"), n, k).alias("sketch")).alias("follow"))
    given = given.groupBy(F.col("for").alias("id")).agg(F.min("follow").alias("follow"))
    rows = texts.join(given, "id")
    chars = F.length("text")
    rows = rows.withColumn("n_chars", chars.cast("long")).withColumn("cut", F.floor(chars / 3).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("cut")), F.substring("follow.head", F.lit(1), F.col("cut")))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text"), n, k).alias("own"), sketch(F.col("edited"), n, k).alias("other"), F.col("follow.sketch").alias("after"))
    return rows.select(F.when(F.col("id") > F.lit(str(_NULL)).cast("decimal(20,0)"), F.col("id").cast("long")).alias(key), "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("other"), k).alias("near_edited"), resemblance(F.col("own"), F.col("after"), k).alias("near_next"))
