"""Words of Arrow text columns as numpy arrays: one vectorised pass over the bytes of many documents.

A word is a run of bytes other than space and 0x09-0x0D. No Spark code: small helpers for ``mapInArrow`` functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U64 = np.uint64


class _Base(NamedTuple):
    table: np.ndarray
    root: int
    inverse: int


def _base(seed: int) -> _Base:
    rng = np.random.default_rng(seed)
    root = int(rng.integers(0, 2**63)) * 2 + 1
    return _Base(rng.integers(1, 2**63, 256).astype(_U64), root, pow(root, -1, 2**64))


#: Two independent hash families.
FAMILIES = (_base(11), _base(29))


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of splitmix64, over a whole array."""
    h = h + _U64((salt * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def _powers(root: int, n: int) -> np.ndarray:
    out = np.full(n, root, dtype=_U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    """Words of one batch. ``bounds[i]:bounds[i+1]`` are the words of document i, in order."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray

    def hashes(self, family: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, from prefix sums of a polynomial over its bytes."""
        base, n = FAMILIES[family], len(self.data)
        sums = np.zeros(n + 1, _U64)
        np.cumsum(base.table[self.data] * _powers(base.root, n), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * _powers(base.inverse, n + 1)[self.start], family + 1)


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of a string array; a null is an empty text."""
    texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    if lower:
        data = _LOWER[data]
    offsets = offsets - offsets[0]
    solid = ~_SPACE[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edges[1:-1]
    stop[:-1] &= ~solid[1:] | edges[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    return Words(data, start, end, doc, bounds)


def rolling(hashes: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hash of ``hashes[i:i+k]`` at each i; the last k - 1 places have none. Crosses documents: see ``inside``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U64)
    root, out = _U64(FAMILIES[family].root), np.zeros(n, _U64)
    for j in range(k):
        out = out * root + hashes[j : j + n]
    return mix(out, k + 100 * family)


def inside(w: Words, k: int) -> np.ndarray:
    """Which places of ``rolling`` lie within one document."""
    n = len(w.doc) - k + 1
    return w.doc[:n] == w.doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """For each document its distinct k-word shingle hashes, ascending (the global order). Fewer words: the sequence as one."""
    hashes = w.hashes()
    grams = rolling(hashes, k)
    for lo, hi in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        if hi - lo >= k:
            yield np.unique(grams[lo : hi - k + 1])
        elif hi > lo:
            yield rolling(hashes[lo:hi], hi - lo)
        else:
            yield np.zeros(0, _U64)


def pieces(batch: pa.RecordBatch, text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has about ``most`` bytes of text (or one longer text)."""
    sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0))
    at = 0
    while at < len(sizes):
        total = np.cumsum(sizes[at : at + 20_000])
        n = max(1, int(np.searchsorted(total, most, "right")))
        yield batch.slice(at, n)
        at += n


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
