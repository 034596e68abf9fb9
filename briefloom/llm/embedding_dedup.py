"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the nearest signed axis is its hash.
Two such hashes make a bucket, and a vector goes into the PROBES most likely buckets of each of TABLES tables. Two
vectors of cosine 0.95 in 64 dimensions share a bucket of one table with probability 0.84, of any of six with 0.99998.
Within buckets all pairs are compared in double precision by matrix products, at the threshold by the plain formula; a pair is counted in the first bucket
that its vectors share and in no other, so that links are counted without ever being listed. A bucket over BLOCK
vectors is cut into blocks, and blocks meet pair by pair. Equal vectors are collapsed first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .storage import stash

TABLES, PROBES, CHOICES = 6, 3, 4
BLOCK = 512
_SEED = 7
#: Products of unit vectors this near to the threshold are computed again by the plain formula.
NEAR = 1e-12
#: Vectors of floats stay floats in shuffles; they are compared as doubles.
_KINDS = {"float": "<f4", "double": "<f8"}


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of rows whose length is a power of two, normalised."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def buckets(vectors: np.ndarray) -> np.ndarray:
    """Codes of the buckets of each vector: (vectors, TABLES, PROBES), the likeliest first."""
    n, dims = vectors.shape
    width = 1 << max(2, (dims - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :dims] = vectors
    rng = np.random.default_rng([_SEED, dims])
    out = np.zeros((n, TABLES, PROBES), np.int32)
    for t in range(TABLES):
        codes, costs = [], []
        for _ in range(2):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :CHOICES]
            value = np.take_along_axis(size, top, 1)
            codes.append(top * 2 + (np.take_along_axis(y, top, 1) < 0))
            costs.append(value[:, :1] ** 2 - value**2)
        cost = (costs[0][:, :, None] + costs[1][:, None, :]).reshape(n, -1)
        code = (codes[0][:, :, None] * (2 * width) + codes[1][:, None, :]).reshape(n, -1)
        out[:, t] = np.take_along_axis(code, np.argsort(cost, axis=1, kind="stable")[:, :PROBES], 1)
    return out


def _usable(vectors: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """(id, bytes): finite, non-zero vectors as ``kind``, float or double; null, zero and non-finite ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            values = column.flatten().to_numpy(zero_copy_only=False) + np.dtype(_KINDS[kind]).type(0)  # a null becomes NaN, -0 becomes 0
            sizes = np.asarray(pc.list_value_length(column).fill_null(0))
            ends = np.cumsum(sizes)
            upto = lambda mask: np.r_[0, np.cumsum(mask)]
            bad, held = upto(~np.isfinite(values)), upto(values != 0)
            good = np.flatnonzero((bad[ends] == bad[ends - sizes]) & (held[ends] > held[ends - sizes]))
            out = [values[a:b].tobytes() for a, b in zip((ends - sizes)[good].tolist(), ends[good].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(good)), pa.array(out, pa.binary())], ["id", "v"])

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v")).where("id is not null").mapInArrow(run, "id long, v binary")


def _entries(reps: DataFrame, kind: str) -> DataFrame:
    """(tab, code, id, weight, v, codes): a row per bucket of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.array(batch.column("v").to_pylist(), object)
            sizes = np.array([len(x) for x in raw], np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(raw[at]), _KINDS[kind]).astype(np.float64).reshape(len(at), -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                codes = buckets(x / np.linalg.norm(x, axis=1, keepdims=True))
                each = np.repeat(at, TABLES * PROBES)
                own = pa.array([c.tobytes() for c in codes], pa.binary()).take(np.repeat(np.arange(len(at)), TABLES * PROBES))
                table = np.tile(np.repeat(np.arange(TABLES), PROBES), len(at)) + TABLES * size
                columns = [pa.array(table, pa.int64()), pa.array(codes.ravel()), batch.column("id").take(each), batch.column("weight").take(each), batch.column("v").take(each), own]
                yield pa.RecordBatch.from_arrays(columns, ["tab", "code", "id", "weight", "v", "codes"])

    return reps.mapInArrow(run, "tab long, code int, id long, weight long, v binary, codes binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b by the plain formula."""
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def _compare(cosine: float, kind: str):
    """Of a group of buckets of one table: (id, links, other), links counted here; (id, other) rows join what is linked."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("code", "ascending"), ("block", "ascending"), ("id", "ascending")])
        given = np.frombuffer(b"".join(table.column("v").to_pylist()), _KINDS[kind]).astype(np.float64).reshape(table.num_rows, -1)
        x, ids, weight = _unit(given), np.asarray(table.column("id")), np.asarray(table.column("weight"))
        code, block = np.asarray(table.column("code")), np.asarray(table.column("block"))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int32).reshape(len(ids), TABLES, PROBES)
        tab, cross = table.column("tab")[0].as_py() % TABLES, table.column("low")[0].as_py() != table.column("high")[0].as_py()
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            mid = lo + int(np.searchsorted(block[lo:hi], block[lo], "right")) if cross else lo
            if hi - lo < 2 or (cross and mid == hi):
                continue
            one, two = (slice(lo, mid), slice(mid, hi)) if cross else (slice(lo, hi), slice(lo, hi))
            found = x[one] @ x[two].T
            i, j = np.nonzero(found >= cosine - NEAR)
            about = found[i, j] < cosine + NEAR
            i, j = i + lo, j + (mid if cross else lo)
            with np.errstate(all="ignore"):
                exact = _plain(given[i[about]], given[j[about]])
            # the plain formula decides at the threshold, unless its squares leave the range of doubles
            keep = i < j
            keep[np.flatnonzero(about)] &= np.where(np.isfinite(exact) & (exact != 0), exact, found[i[about] - lo, j[about] - (mid if cross else lo)]) >= cosine
            i, j = i[keep], j[keep]
            for a in range(0, len(i), 50_000):
                p, q = i[a : a + 50_000], j[a : a + 50_000]
                same = (codes[p][:, :, :, None] == codes[q][:, :, None, :]).any(axis=3)  # (pair, table, probe of p)
                before = same[:, :tab].any(axis=(1, 2)) | (same[:, tab] & (codes[p][:, tab] < code[lo])).any(axis=1)
                p, q = p[~before], q[~before]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
                while True:  # labels of what is linked: the smallest place
                    least = np.minimum(root[p], root[q])
                    if (root[p] == least).all() and (root[q] == least).all():
                        break
                    np.minimum.at(root, root[p], least)
                    np.minimum.at(root, root[q], least)
                    np.minimum.at(root, p, least)
                    np.minimum.at(root, q, least)
        while (root[root] != root).any():
            root = root[root]
        held = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table({"id": ids[held], "links": links[held], "other": ids[root[held]]}, schema=pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]))

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(``key``, n_links, component_id, kept) for each row.

    Links join vectors of cosine ``cosine`` or more; n_links counts other rows linked directly, component_id is the
    smallest key reachable, kept says whether that is the row's own. Null vectors, zero vectors and vectors that hold a
    null or a non-finite component link with nothing, nor do vectors of different lengths or rows with a null key.
    Equal vectors link with each other. A key that repeats is linked if one of its rows is. Other columns are not read.
    """
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    usable = _usable(vectors, key, vector, kind)
    classes = stash(usable.groupBy(F.sha2("v", 256).alias("class")).agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.min("v").alias("v")))
    members = usable.select("id", F.sha2("v", 256).alias("class")).join(classes.select("class", "rep", "weight"), "class").select("id", "rep", "weight")
    entries = stash(_entries(classes.select(F.col("rep").alias("id"), "weight", "v"), kind))

    sizes = entries.groupBy("tab", "code").agg(F.count("*").alias("n"))
    hot = stash(sizes.where(F.col("n") > BLOCK).select("tab", "code", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    groups = max(1, round(classes.count() * PROBES / 1000))
    rows = entries.join(hot, ["tab", "code"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), "blocks"), F.lit(0).cast("long")))
    others = F.coalesce(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.array(F.lit(0).cast("long")))
    grp = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("code"), F.lit(groups))).otherwise(-1 - F.col("code").cast("long"))
    rows = rows.withColumn("grp", grp).withColumn("with", F.explode(others)).select("tab", "code", "id", "weight", "v", "codes", "grp", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block")
    found = stash(rows.groupBy("tab", "grp", "low", "high").applyInArrow(_compare(cosine, kind), "id long, links long, other long"))

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("id").alias("u"), F.col("other").alias("v")))
    known = members.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    known = known.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = vectors.select(F.col(key).cast("long").alias("key")).join(known, F.col("key") == F.col("id"), "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
