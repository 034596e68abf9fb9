"""Language ID by cross-parsing entropy.

For each language a suffix automaton holds labelled texts, whole ones of a bounded number of rows. A text is parsed against
it into the longest phrases that occur there; the number of phrases, times the bits of a pointer, over the text's length
estimates the cross-entropy. The language with the least wins. Every automaton has all letters of its own sample.
Automata are built in tasks, one language at a time, and stay a table; texts are parsed against groups of languages of
bounded size, one group after the other.

Texts are cut into blocks that are parsed side by side: an automaton is a table of transitions, and one numpy step
advances all of a batch's blocks by one letter. Phrases don't end with their block: a block is parsed again from the state
in which the one before ends, until it meets its first parse, which it then follows to its end.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stash
from .text_arrays import pieces

#: Bound of all tables of transitions together, in bytes; where they would be larger, sorted lists of transitions stand for them.
DENSE_BYTES = 64 << 20
#: Bytes of the automata that are broadcast at one time (or one language's, if that has more).
GROUP_BYTES = 32 << 20
#: Letters of a block.
BLOCK = 256


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def folded(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points; a run of other characters is one 0."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    return codes[keep]


class Learned(NamedTuple):
    """One language: the code points of its letters, and the suffix automaton of ``n`` symbols.

    Symbols: 0 no letter, 1 a letter that the sample lacks, then the letters. ``to[i]`` is where ``keys[i]``, state times
    symbols plus symbol, leads; keys ascend.
    """

    lang: str
    n: int
    letters: np.ndarray
    states: int
    keys: np.ndarray
    to: np.ndarray

    def row(self) -> dict:
        return {"lang": self.lang, "n": self.n, "letters": self.letters.astype("<u4").tobytes(), "states": self.states, "keys": self.keys.astype("<i8").tobytes(), "to": self.to.astype("<i4").tobytes()}

    @classmethod
    def of(cls, row: dict) -> Learned:
        return cls(row["lang"], row["n"], np.frombuffer(row["letters"], "<u4"), row["states"], np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["to"], "<i4"))


def suffix_automaton(codes: np.ndarray, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(states, keys, to) of a sequence of numbers below ``size``. Transitions are one map and lists in arrays, some 250 bytes a letter while it is built."""
    links, lengths, moves = array("i", [-1]), array("i", [0]), {}
    first, following, symbols = array("i", [-1]), array("i"), array("i")  # a state's symbols, as a list

    def leads(state: int, c: int, to: int) -> None:
        moves[state * size + c] = to
        symbols.append(c)
        following.append(first[state])
        first[state] = len(symbols) - 1

    def state(length: int) -> int:
        links.append(0)
        lengths.append(length)
        first.append(-1)
        return len(links) - 1

    last = 0
    for c in codes.tolist():
        new, at = state(lengths[last] + 1), last
        while at >= 0 and at * size + c not in moves:
            leads(at, c, new)
            at = links[at]
        if at >= 0:
            to = moves[at * size + c]
            if lengths[at] + 1 == lengths[to]:
                links[new] = to
            else:
                twin = state(lengths[at] + 1)
                links[twin], e = links[to], first[to]
                while e >= 0:
                    leads(twin, symbols[e], moves[to * size + symbols[e]])
                    e = following[e]
                while at >= 0 and moves.get(at * size + c) == to:
                    moves[at * size + c] = twin
                    at = links[at]
                links[to] = links[new] = twin
        last = new
    keys, to = np.fromiter(moves.keys(), np.int64, len(moves)), np.fromiter(moves.values(), np.int32, len(moves))
    order = np.argsort(keys)
    return len(links), keys[order], to[order]


def learn(lang: str, texts: Iterable[str]) -> Learned:
    """The automaton of whole texts, one after the other."""
    codes = np.concatenate([np.zeros(0, np.uint32), *[folded(t + " ") for t in texts]])
    letters = np.unique(codes[codes > 0])
    own = np.where(codes == 0, 0, np.searchsorted(letters, codes) + 2)
    return Learned(lang, len(codes), letters, *suffix_automaton(own, len(letters) + 2))


class Dense:
    """All transitions as a table. A step gives twice the next state, plus 1 where a phrase begins.

    A letter that doesn't prolong the phrase is parsed from the root; one that the root doesn't know is a phrase of its own.
    """

    def __init__(self, given: Learned):
        self.size = len(given.letters) + 2
        table = np.tile(_root(given).astype(np.int32), given.states)
        further = np.searchsorted(given.keys, self.size)
        table[given.keys[further:]] = given.to[further:] * 2
        self.flat = table

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return self.flat[state * self.size + symbols]


class Sparse:
    """Transitions that prolong a phrase, in order; the others are the root's."""

    def __init__(self, given: Learned):
        self.size, self.root = len(given.letters) + 2, _root(given)
        further = np.searchsorted(given.keys, self.size)
        self.keys, self.to = given.keys[further:], given.to[further:].astype(np.int64) * 2

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return self.root[symbols]
        key = state * self.size + symbols
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], self.root[symbols])


def _root(given: Learned) -> np.ndarray:
    """Where each symbol leads from the root, as a step that begins a phrase."""
    size = len(given.letters) + 2
    upto, root = np.searchsorted(given.keys, size), np.zeros(size, np.int64)
    root[given.keys[:upto]] = given.to[:upto]
    return root * 2 + 1


class Model:
    """Alphabets and automata of some languages."""

    def __init__(self, learned: Iterable[Learned]):
        learned = sorted(learned, key=lambda x: x.lang)
        self.symbols = np.unique(np.concatenate([np.zeros(0, np.uint32), *[x.letters for x in learned]]))
        self.languages = [x.lang for x in learned]
        self.own = [self._own(x.letters) for x in learned]
        self.tables = [(Dense if x.states * (len(x.letters) + 2) * 4 <= DENSE_BYTES // len(learned) else Sparse)(x) for x in learned]
        self.bits = [math.log2(max(2, x.n)) for x in learned]

    def _own(self, letters: np.ndarray) -> np.ndarray:
        """For each symbol of all languages that of one: 0: no letter, 1: a letter that its sample lacks, then the sample's."""
        own = np.r_[0, np.ones(len(self.symbols) + 1, np.int64)]
        own[np.searchsorted(self.symbols, letters) + 2] = np.arange(len(letters)) + 2
        return own

    def coded(self, codes: np.ndarray) -> np.ndarray:
        """0: no letter, 1: a letter of no sample, then those of all samples."""
        if not len(self.symbols):
            return (codes > 0).astype(np.int32)
        at = np.minimum(np.searchsorted(self.symbols, codes), len(self.symbols) - 1)
        return np.where(codes == 0, 0, np.where(self.symbols[at] == codes, at + 2, 1)).astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each (coded) text needs in each language, each the longest match from where the last one ends."""
        lanes = [-(-len(t) // BLOCK) for t in texts]
        first = np.r_[0, np.cumsum(lanes)]
        grid, ends = np.zeros(first[-1] * BLOCK, np.int32), np.full(first[-1], BLOCK)
        for t, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist()):
            grid[a * BLOCK : a * BLOCK + len(t)] = t
            if b > a:
                ends[b - 1] = len(t) - (b - a - 1) * BLOCK
        order = np.argsort(-ends, kind="stable")
        grid, ends = np.ascontiguousarray(grid.reshape(-1, BLOCK)[order].T), ends[order]
        alive = np.searchsorted(-ends, -np.arange(BLOCK), "left")  # lanes longer than the step
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # the lane of the block before, if it is of the same text
        before = np.where(np.isin(order, first[:-1]), -1, place[order - 1]) if len(order) else order
        out = np.zeros((len(self.tables), len(texts)), np.int64)
        owner = np.repeat(np.arange(len(texts)), lanes)[order]
        for k, (own, table) in enumerate(zip(self.own, self.tables)):
            steps = np.zeros((BLOCK, len(order)), np.int64)
            state = np.zeros(len(order), np.int64)
            for i in range(BLOCK):
                if not (n := int(alive[i])):
                    break
                steps[i, :n] = table.step(state[:n], own[grid[i, :n]])
                state[:n] = steps[i, :n] >> 1
            entry = np.zeros(len(order), np.int64)
            while True:
                wanted = np.where(before < 0, 0, steps[-1, before] >> 1)
                live = np.flatnonzero(wanted != entry)
                if not len(live):
                    break
                state = entry[live] = wanted[live]
                for i in range(BLOCK):
                    inside = ends[live] > i
                    live, state = live[inside], state[inside]
                    if not len(live):
                        break
                    step = table.step(state, own[grid[i, live]])
                    apart = step >> 1 != steps[i, live] >> 1
                    steps[i, live] = step
                    live, state = live[apart], step[apart] >> 1
            out[k] = np.bincount(owner, (steps & 1).sum(axis=0), len(texts)).astype(np.int64)
        return out

    def best(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the two languages that need least, as (need, lang); none for texts without a letter."""
        coded = [self.coded(folded(t)) if t else np.zeros(0, np.int32) for t in texts]
        need = self.phrases(coded) * np.array(self.bits)[:, None]
        order = np.argsort(need, axis=0, kind="stable")[:2]
        return [[{"need": float(need[k, i]), "lang": self.languages[k]} for k in order[:, i].tolist()] if (c > 0).any() else [] for i, c in enumerate(coded)]


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: CRC-32 of its key as text, modulo 4, is 2. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 32, letters: int = 64_000) -> DataFrame:
    """A row per language, the fields of ``Learned``, from rows that are not held out and have text and language.

    At most ``rows`` rows of a language are learned, each with its whole text: of so many slots by hash the row with the
    smallest hash in each. Rows of up to ``letters`` characters are preferred, and taken slot by slot as long as their
    characters are no more together; a language that has none is learned from its shortest text. Automata are built in
    tasks and written; no text comes to the driver.
    """
    given, content = F.col(key), F.col(text).cast("string")
    known = docs.where(~held_out(given)).where(F.col(text).isNotNull() & F.col(lang).isNotNull()).where(content.rlike(r"\p{L}"))
    at = F.when(given.isNull(), F.xxhash64(F.lit(17), content)).otherwise(F.xxhash64(F.lit(17), given))
    known = known.select(F.col(lang).cast("string").alias("lang"), content.alias("text"), at.alias("at"))
    size = F.length("text")
    choice = F.struct((size > letters).alias("long"), F.when(size > letters, size).otherwise(0).alias("size"), F.col("at"))
    # a few rows per language; the planner broadcasts them if they are small
    least = stash(known.groupBy("lang", F.pmod("at", F.lit(rows)).alias("slot")).agg(F.min(choice).alias("c")).select("lang", "c.at", "slot", "c.long"))
    picked = known.join(least, ["lang", "at"]).groupBy("lang", "at", "slot", "long").agg(F.min("text").alias("text"))

    def build(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: (r["long"], len(r["text"]) if r["long"] else r["slot"], r["at"]))
        taken, left = [], letters
        for r in found:
            if not taken and r["long"] or not r["long"] and len(r["text"]) <= left:
                taken.append(r["text"])
                left -= len(r["text"])
        return pa.Table.from_pylist([learn(found[0]["lang"], taken).row()], schema)

    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("letters", pa.binary()), ("states", pa.int64()), ("keys", pa.binary()), ("to", pa.binary())])
    return stash(picked.groupBy("lang").applyInArrow(build, "lang string, n long, letters binary, states long, keys binary, to binary"))


def _groups(learned: DataFrame) -> list[list[str]]:
    """Names of languages, in order, in groups of GROUP_BYTES at most (or one language)."""
    out, left = [], 0
    for r in learned.select("lang", (F.length("keys") + F.length("to") + F.length("letters")).alias("size")).orderBy("lang").collect():
        if r["size"] > left or not out:
            out.append([])
            left = GROUP_BYTES
        out[-1].append(r["lang"])
        left -= r["size"]
    return out


def _parsed(rows: DataFrame, learned: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``best`` in place of text: the two of these languages that need least."""
    spark = rows.sparkSession
    own = learned.where((F.col("lang") >= names[0]) & (F.col("lang") <= names[-1])).collect()
    shared = spark.sparkContext.broadcast(Model(Learned.of(r.asDict()) for r in own))
    kept = [c for c in rows.columns if c != "text"]
    kind = pa.list_(pa.struct([("need", pa.float64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                found = shared.value.best(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(found, kind)], [*kept, "best"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{types}, best array<struct<need: double, lang: string>>")


def identify(docs: DataFrame, learned: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, held_out, lang_pred, score) for each row, from its whole text alone. ``learned``: of ``fit``.

    Score: how much less the winner needs than the second, 0 to 1. Null texts and texts without a letter: ``und``, 0; so is
    everything if nothing could be learned. Repeated rows have repeated results; equal needs go to the language that sorts
    first. Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    groups = _groups(learned)
    if not groups:
        rows = rows.select("id", "held_out", F.expr("cast(array() as array<struct<need: double, lang: string>>)").alias("best"))
    elif len(groups) == 1:
        rows = _parsed(rows, learned, groups[0])
    else:  # each group's table is written before the next group is read
        rows = stash(rows.withColumn("row", F.monotonically_increasing_id()))
        parts = [stash(_parsed(rows.select("row", "text"), learned, names)) for names in groups]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionAll(part)
        every = every.groupBy("row").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, 2).alias("best"))
        rows = rows.drop("text").join(every, "row")
    first, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - first["need"] / F.coalesce(second["need"], 2 * first["need"])))
    return rows.select(F.col("id").alias(key), "held_out", F.coalesce(first["lang"], F.lit("und")).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score"))
