"""Exact top-k search by inner product: columnar branch-and-bound.

Queries and candidates are dealt into cells, a block of queries by a block of candidates, and each cell is one task. There
the candidates lie dimension by dimension, the dimensions of most mass first. Scores grow block of dimensions by block;
after each, a pair stays only if its score so far, plus the lengths of both remainders multiplied (as much as the rest can
still add), beats the k-th best of its query. Candidates that no query needs are compacted away, and where few pairs
are left, they alone are followed. Cells return their k best; the best of these are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vector_arrays import matrices

#: Dimensions of a block.
DIMS = 8
#: Bytes of a cell's candidates and of its queries, as doubles; and the cells that a smaller table is dealt into.
CANDIDATE_BYTES, QUERY_BYTES, CELLS = 32 << 20, 16 << 20, 24
#: Candidates and queries that are compared at one time within a cell.
AT_ONCE, QUERIES_AT_ONCE = 2048, 256
#: Pairs are followed one by one where fewer than one in so many are left.
SPARSE = 16
#: Doubles hold whole numbers up to here.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _usable(rows: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, dims, v): vectors as whole numbers, floor(scale * x); those that are null or hold a null or non-finite component are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column("v")):
                with np.errstate(over="ignore"):
                    x = np.floor(x * scale)
                fits = np.isfinite(x).all(axis=1)
                at, x = at[fits], x[fits]
                kind = "<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<f8"
                packed = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(np.full(len(at), x.shape[1], np.int32)), packed], ["id", "dims", "v"])

    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null").mapInArrow(run, "id long, dims int, v binary")


def _unpacked(packed: list[bytes], dims: int) -> np.ndarray:
    """A matrix of doubles; rows were packed as 16-bit numbers where those hold them."""
    out = np.zeros((len(packed), dims))
    short = np.array([len(p) == 2 * dims for p in packed], bool)
    for kind, at in (("<i2", np.flatnonzero(short)), ("<f8", np.flatnonzero(~short))):
        if len(at) and dims:
            out[at] = np.frombuffer(b"".join(packed[i] for i in at.tolist()), kind).reshape(len(at), dims)
    return out


class Best:
    """The k best (score, smallest id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.place = k, np.full((queries, k), -np.inf), np.full((queries, k), -1)

    def add(self, query: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        """Takes pairs whose places are all beyond those of earlier calls: at equal scores earlier ones stay before."""
        touched = np.unique(query)
        old = self.place[touched] >= 0
        query = np.r_[np.repeat(touched, old.sum(axis=1)), query]
        place, score = np.r_[self.place[touched][old], place], np.r_[self.score[touched][old], score]
        order = np.lexsort((place, -score, query))
        query, place, score = query[order], place[order], score[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        top = nth < self.k
        self.score[query[top], nth[top]], self.place[query[top], nth[top]] = score[top], place[top]


def search(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """Best candidates of each query by inner product; places are rows of ``candidates``, whose ids must ascend. Own ids don't count."""
    best, dims = Best(len(queries), k), candidates.shape[1]
    order = np.argsort(-np.square(candidates).sum(axis=0), kind="stable")
    across, queries = np.ascontiguousarray(candidates.T[order]), queries[:, order]
    cuts = [*range(0, dims, DIMS), dims]
    # lengths of what is left from each cut on; the rounding of norms is far below this excess
    rest = lambda x: np.sqrt(np.stack([np.square(x[c:]).sum(axis=0) for c in cuts])) * (1 + 1e-9)
    left, asked = rest(across), rest(queries.T)
    for lo in range(0, len(ids), AT_ONCE):
        for first in range(0, len(queries), QUERIES_AT_ONCE):
            q, c = np.arange(first, min(first + QUERIES_AT_ONCE, len(queries))), np.arange(lo, min(lo + AT_ONCE, len(ids)))
            worst, score = best.score[q, -1], np.zeros((len(q), len(c)))
            open_ = ids[c] != query_ids[q][:, None]
            i = j = None
            for b, (at, upto) in enumerate(zip(cuts[:-1], cuts[1:])):
                if i is None:
                    score += queries[q, at:upto] @ across[at:upto, c]
                    open_ &= score + asked[b + 1, q][:, None] * left[b + 1, c] > worst[:, None]
                    needed = open_.any(axis=0)
                    if not needed.any():
                        break
                    if needed.mean() < 0.9:
                        c, score, open_ = c[needed], np.compress(needed, score, axis=1), np.compress(needed, open_, axis=1)
                    if SPARSE * np.count_nonzero(open_) < open_.size:
                        i, j = np.nonzero(open_)
                        score = score[i, j]
                else:
                    score = score + np.einsum("ij,ji->i", queries[q[i], at:upto], across[at:upto, c[j]])
                    stay = score + asked[b + 1, q[i]] * left[b + 1, c[j]] > worst[i]
                    i, j, score = i[stay], j[stay], score[stay]
            if i is None:
                if not dims:
                    open_ &= score > worst[:, None]
                if len(c) > k:  # of each row what is below its own k-th can't count
                    shown = np.where(open_, score, -np.inf)
                    open_ &= score >= np.partition(shown, len(c) - k, axis=1)[:, -k][:, None]
                i, j = np.nonzero(open_)
                score = score[i, j]
            if len(i):
                best.add(q[i], c[j], score)
    return best


def _plain(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, id, score) by Python's integers, for numbers whose products doubles can't hold. Scores beyond a long are cut to its limits."""
    whole = [[int(x) for x in row] for row in candidates.tolist()]
    for key, row in zip(query_ids.tolist(), queries.tolist()):
        own = [int(x) for x in row]
        found = sorted((-max(-_LONG - 1, min(_LONG, sum(x * y for x, y in zip(own, other)))), i) for i, other in zip(ids.tolist(), whole) if i != key)
        yield from ((key, i, -s) for s, i in found[:k])


def _cell(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, asks = np.asarray(table.column("id")), np.asarray(table.column("asks"))
        dims = table.column("dims")[0].as_py()
        x = _unpacked(table.column("v").to_pylist(), dims)
        queries, own, candidates, others = x[asks], ids[asks], x[~asks], ids[~asks]
        if not len(own) or not len(others):
            return schema.empty_table()
        longest = lambda m: float(np.sqrt(np.square(m).sum(axis=1)).max())
        if not longest(queries) * longest(candidates) < _EXACT / 2:
            return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in _plain(queries, own, candidates, others, k)], schema)
        best = search(queries, own, candidates, others, k)
        i, j = np.nonzero(best.place >= 0)
        return pa.table([own[i], others[best.place[i, j]], best.score[i, j].astype(np.int64)], schema=schema)

    return run


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def top_k(queries: DataFrame, candidates: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, ``key``, score): the ``k`` best ``candidates`` of each query, fewer where there are fewer.

    Components count as the whole numbers floor(scale * x), and a score is their inner product, exact; ties go to the smaller
    key. A candidate of the query's own key doesn't count. Rows with a null key, and vectors that are null or hold a null or
    non-finite component, take no part, neither as queries nor as candidates; vectors meet those of their length, empty ones
    score 0. Rows that repeat a key: each is a candidate; as a query, the key is asked with the least of its vectors. Scores
    that a long can't hold are cut to its limits. Other columns are not read. Empty tables give an empty result.
    """
    asked = queries.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_v"))
    asked = _usable(asked, "_id", "_v", scale).groupBy("id", "dims").agg(F.min("v").alias("v")).groupBy("id").agg(F.min(F.struct("dims", "v")).alias("q")).select("id", "q.dims", "q.v")
    rows, widest = candidates.agg(F.count("*"), F.max(F.size(vector))).first()
    width = 8 * max(1, widest or 1)
    n_rows = max(1, CANDIDATE_BYTES // width)
    blocks = max(1, -(-rows // n_rows), min(CELLS, -(-rows // 512)))
    parts = max(1, -(-queries.count() * width // QUERY_BYTES))
    # any dealing gives the same result; this one is even, whatever the keys
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    offered = _usable(candidates, key, vector, scale).select("id", "dims", "v", F.lit(False).alias("asks"), dealt.alias("block")).withColumn("part", _numbers(parts))
    asked = asked.select("id", "dims", "v", F.lit(True).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")).withColumn("block", _numbers(blocks))
    found = offered.unionByName(asked).groupBy("dims", "part", "block").applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(key), "score")
