"""Best-fit packing: token sequences of fixed length, filled by the sum-of-squares rule.

A document is cut only if it is longer than a sequence. Pieces are dealt to groups by a hash, of some ten thousand
each, and every group is packed on its own, in descending length: of the open sequences in which a piece fits, it goes
into one after which the squared counts of open sequences per residual gap sum to the least; if it fits in none, it
opens one. Only lengths travel to the packing tasks.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import pieces

#: Documents to a packing group; the waste of a group is a few sequences.
GROUP = 30_000
#: Splitting rule of the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def ranks_encoder(path: str, added: tuple[tuple[str, int], ...] = ()):
    """Encoder of a byte-level vocabulary given as ranks, with its added tokens (string, id)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict(added))


def default_ranks() -> str:
    """The byte-level BPE vocabulary of 50k ids, as ranks: the same ids as its JSON file gives."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def default_added() -> tuple[tuple[str, int], ...]:
    """The added tokens of that JSON file, which its ranks don't hold."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


def token_pieces(docs: DataFrame, key: str, text: str, room: int, ranks: str | None, end_id: int, added: Mapping[str, int] | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): a document's ids and the end id, cut so that only the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ranks_encoder(ranks or default_ranks(), tuple(added.items()) if added is not None else () if ranks else default_added())
        for batch in batches:
            for part in pieces(batch, "text"):
                out: list[tuple] = []
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array([*(encoder.encode(text, allowed_special="all") if text else ()), end_id], "<u4")
                    stops = range((len(ids) - 1) % room + 1, len(ids) + 1, room)
                    start = 0
                    for i, stop in enumerate(stops):
                        out.append((key, i, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                        start = stop
                names = ["id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def place(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) for each length, none over ``room``, by the sum-of-squares rule in descending length."""
    order = np.argsort(-lengths, kind="stable")
    counts = np.zeros(room + 1, np.int64)  # open sequences by gap; a full one is none
    held: list[list[int]] = [[] for _ in range(room + 1)]
    sequence, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in order.tolist():
        size = int(lengths[i])
        # change of the sum, halved: one more of gap g - size, one less of gap g
        fits = counts[size:room]
        change = np.where(fits > 0, counts[: room - size] - fits, 1 << 40)
        gap = size + int(change.argmin()) if len(change) else room
        if gap < room and counts[gap]:
            at = held[gap].pop()
            counts[gap] -= 1
        else:
            gap, at, n = room, n, n + 1
        sequence[i], offset[i], left = at, room - gap, gap - size
        if left:
            held[left].append(at)
            counts[left] += 1
    return sequence, offset


def _packer(room: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = place(np.asarray(table.column("length")), room)
        base = table.column("grp")[0].as_py() << 32
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", room: int = 2048, ranks: str | None = None, end_id: int = 0, added: Mapping[str, int] | None = None) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Rows that repeat a key are packed each on its own, as are rows with a
    null key. An empty table gives an empty result. ``ranks``: file of a byte-level vocabulary as ranks. ``added``:
    ids of its added tokens, which are found in texts wherever they stand; those of the default vocabulary are known, a
    file of ranks has none. Columns beside ``key`` and ``text`` are not read.
    """
    groups = max(1, round(docs.count() / GROUP))
    rows = token_pieces(docs, key, text, room, ranks, end_id, added).withColumn("grp", F.pmod(F.xxhash64("id", "ids_crc32"), F.lit(groups)))
    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return rows.groupBy("grp").applyInArrow(_packer(room), schema).withColumnRenamed("id", key)
