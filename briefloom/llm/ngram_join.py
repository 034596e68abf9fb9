"""N-gram Jaccard join: groups of documents whose word n-gram sets resemble each other, exactly.

The n-grams of a set are 64-bit hashes in ascending order, the global order. The order is cut into slices of equal
width; a set's n-grams within a slice are a path of that slice's prefix tree, and sets that hold the same n-grams
there end in the same node. Two sets of Jaccard resemblance t or more, both of at most b n-grams, differ in at most
D = 2b (1 - t) / (1 + t) n-grams, so of more than D slices one has no difference: only sets that meet in a node of
some tree can be linked. Size bands keep b close to the sizes at hand. Sets that meet are compared by parity sketches,
which bound their difference from below, so that unrelated sets that share a passage are told apart without their
texts. Those left are put together (components) and joined inside with a prefix tree over whole sets: a traversal carries the overlap so far for all sets
below a node and leaves a subtree as soon as the remaining lengths can't bring it to the needed overlap.

Equal sets are collapsed first and stay out of the search; a class is represented by its smallest id.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import connected_components
from .storage import stash
from .text_arrays import mix, pieces, shingle_sets, signed, words

#: Ratio of the largest and the smallest set of a size band.
BAND = 1.5
#: Sets that meet one task in the verifying join; larger groups are cut into pairs of such blocks.
BLOCK = 192
#: Sketches of a node that meet one task; larger nodes are cut into pairs of such blocks. Other nodes are dealt to groups of about so many.
MEET, DEAL = 1024, 4096


class Slices:
    """Size bands and the number of slices in each, for a threshold of percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self._cuts = [1]
        while self._cuts[-1] < 1 << 40:
            self._cuts.append(max(self._cuts[-1] + 1, math.ceil(self._cuts[-1] * BAND)))

    def band(self, size: int) -> int:
        return bisect_left(self._cuts, size + 1) - 1

    def bands(self, size: int) -> range:
        """The set's own band and those of larger sets that can still resemble it."""
        return range(self.band(size), self.band(size * 100 // self.percent) + 1)

    def largest(self, band: int) -> int:
        return self._cuts[band + 1] - 1

    def count(self, band: int) -> tuple[int, int]:
        """(slices, spare ones): more slices than differences, plus spares for slices that are empty by chance."""
        low, high = self._cuts[band] * self.percent / 100, self._cuts[band + 1] - 1
        worst = 2 * high * (100 - self.percent) // (100 + self.percent)
        spare = 1
        for _ in range(20):
            n = worst + 1 + spare
            empty = n * math.exp(-low / n)
            spare = min(n, math.ceil(empty + 3 * math.sqrt(empty)) + 1)
        return worst + 1 + spare, spare


def nodes(grams: np.ndarray, slices: Slices) -> Iterator[tuple[int, np.ndarray]]:
    """(band, hashes of the tree nodes at which a set ends). Nodes of empty slices count only if there are more than the spares."""
    if not len(grams):
        return
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams, 7), out=sums[1:])
    for band in slices.bands(len(grams)):
        n, spare = slices.count(band)
        if n - spare == 1:
            continue  # no difference allowed: equal sets, which are collapsed before
        # slice of a hash: its upper half times n, upper half of the product
        cut = np.searchsorted((grams >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
        held = np.diff(cut) > 0
        path = mix(sums[cut[1:]] - sums[cut[:-1]] + np.arange(n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1000 + band)
        yield band, path if n - held.sum() > spare else path[held]


def parity(grams: np.ndarray, band: int, slices: Slices) -> bytes:
    """The set's size and, for two bits per n-gram, whether an odd number of n-grams falls on each bit.

    Sets of one band whose bits differ in d places differ in d n-grams at least.
    """
    n = 64 * math.ceil(slices.largest(band) / 32)
    bits = np.bincount((mix(grams, 5000 + band) % np.uint64(n)).astype(np.int64), minlength=n) & 1
    return len(grams).to_bytes(8, "little") + np.packbits(bits.astype(np.uint8)).tobytes()


def _sets(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """One pass over the texts, with three kinds of rows.

    (id, n_shingles, class) per document, where class digests the set and is null for empty sets; (id, band, node) per
    tree node; (id, band, sketch) per size band. What a kind hasn't is null.
    """
    names, kinds = ["id", "n_shingles", "class", "band", "node", "sketch"], [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]

    def batch_of(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = Slices(percent)
        for batch in batches:
            for part in pieces(batch, "text"):
                sizes, digests, found, sketches = [], [], [], []
                for key, grams in zip(part.column("id").to_pylist(), shingle_sets(words(part.column("text"), lower=True), n)):
                    sizes.append(len(grams))
                    digests.append(mix(np.array([mix(grams, s).sum() for s in (3, 4)], np.uint64), len(grams) % 97).tobytes() if len(grams) else None)
                    if key is not None:
                        for band, at in nodes(grams, slices):
                            found.append((np.full(len(at), key, np.int64), np.full(len(at), band, np.int32), at))
                            sketches.append((key, band, parity(grams, band, slices)))
                yield batch_of(len(sizes), **{"id": part.column("id"), "n_shingles": sizes, "class": digests})
                if found:
                    ids, bands, at = (np.concatenate(x) for x in zip(*found))
                    yield batch_of(len(at), id=ids, band=bands, node=signed(at))
                    yield batch_of(len(sketches), **dict(zip(("id", "band", "sketch"), zip(*sketches))))

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, n_shingles long, class binary, band int, node long, sketch binary")


def _alike(met: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between ids that meet in a node and whose sketches don't rule a link out: a forest of them per node.

    met: (node, band, id), stashed; sketches: (id, band, sketch). Nodes are dealt by hash, large ones in pairs of blocks.
    """
    groups = max(1, math.ceil(met.count() / DEAL))
    hot = stash(met.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > MEET).select("node", F.ceil(F.col("n") / MEET).alias("blocks")))
    zero = F.lit(0).cast("long")
    rows = met.join(hot, "node", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), "blocks"), zero))
    others = F.coalesce(F.sequence(zero, F.col("blocks") - 1), F.array(zero))
    deal = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("node"), F.lit(groups))).otherwise(F.col("node"))
    rows = rows.withColumn("deal", deal).withColumn("other", F.explode(others)).select("deal", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "band", "id")
    rows = rows.join(sketches, ["id", "band"]).select("deal", "low", "high", "node", "band", "id", "sketch")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("node", "ascending"), ("band", "ascending"), ("id", "ascending")])
        band, node, ids, raw = np.asarray(table.column("band")), np.asarray(table.column("node")), np.asarray(table.column("id")), table.column("sketch").to_pylist()
        edges, found = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (band[1:] != band[:-1]), True]), []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            x = np.frombuffer(b"".join(raw[lo:hi]), np.uint64).reshape(hi - lo, -1)
            sizes, bits, label = x[:, 0].astype(np.int64), x[:, 1:], np.arange(hi - lo)
            for i in range(hi - lo - 1):
                rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
                if len(rest):
                    apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
                    near = rest[apart * (100 + percent) <= (100 - percent) * (sizes[rest] + sizes[i])]
                    if len(near):
                        label[np.isin(label, label[near])] = label[i]
            moved = np.flatnonzero(label != np.arange(hi - lo))
            found.append((ids[lo:hi][moved], ids[lo:hi][label[moved]]))
        u, v = (np.concatenate(x) for x in zip(*found))
        return pa.table({"u": u, "v": v}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return rows.groupBy("deal", "low", "high").applyInArrow(run, "u long, v long")


class Tree:
    """Prefix tree over ordered sets, path-compressed; leaves know the sets that end there."""

    __slots__ = ("below", "ends", "grams", "longest", "shortest")

    def __init__(self, sets: list[tuple[int, list[int]]], depth: int = 0):
        """sets: (number, ordered n-grams), sorted by n-grams."""
        first, last, stop = sets[0][1], sets[-1][1], depth
        most = min(len(first), len(last))
        while stop < most and first[stop] == last[stop]:
            stop += 1
        self.grams = first[depth:stop]
        self.longest, self.shortest = max(len(s) for _, s in sets), min(len(s) for _, s in sets)
        at = 0
        while at < len(sets) and len(sets[at][1]) == stop:
            at += 1
        self.ends, self.below = sets[:at], []
        while at < len(sets):
            lead, to = sets[at][1][stop], at
            while to < len(sets) and sets[to][1][stop] == lead:
                to += 1
            self.below.append(Tree(sets[at:to], stop))
            at = to

    def search(self, probe: list[int], held: set[int], percent: int, found: list[int], depth: int = 0, overlap: int = 0) -> None:
        """Numbers of the sets at or below this node with at least percent / 100 resemblance to the probe."""
        depth += len(self.grams)
        for g in self.grams:
            overlap += g in held
        # the most that can still be shared: what is left of the probe after this node's last n-gram, or of the longest set below
        left = len(probe) - (bisect_left(probe, self.grams[-1] + 1) if self.grams else 0)
        best = overlap + min(left, self.longest - depth)
        if best * (100 + percent) < percent * (len(probe) + max(self.shortest, best)):
            return
        for number, s in self.ends:
            if overlap * 100 >= percent * (len(probe) + len(s) - overlap):
                found.append(number)
        for t in self.below:
            t.search(probe, held, percent, found, depth, overlap)


def similar(left: list[list[int]], right: list[list[int]] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of linked sets: of one list with itself (i < j), or of two lists."""
    order = sorted(((i, s) for i, s in enumerate(left) if s), key=lambda x: x[1])
    if not order:
        return
    tree = Tree(order)
    for j, s in enumerate(left if right is None else right):
        found: list[int] = []
        if s:
            tree.search(s, set(s), percent, found)
        yield from ((i, j) for i in found if right is not None or i < j)


def _spanning(pairs: Iterator[tuple[int, int]], ids: list[int], shift: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs: as many rows as sets at most, whatever the number of pairs."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for i, j in pairs:
        a, b = top(ids[i]), top(ids[shift + j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((max(a, b), min(a, b)))
    return out


def _text_sets(table: pa.Table, n: int) -> list[np.ndarray]:
    return [g for batch in table.select(["text"]).to_batches() for part in pieces(batch, "text") for g in shingle_sets(words(part.column("text"), lower=True), n)]


def _from_first(members: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, grp, step, direct) for members (id, text, grp, n_blocks): the distance from the group's first set, in whole steps of 1 - threshold.

    Up to exactly one step is a link (direct). Only the first set is copied to all blocks, so that the work is linear in a group's size.
    """
    own = F.pmod(F.xxhash64("id"), F.col("n_blocks"))
    blocks = F.when(F.col("id") == F.col("grp"), F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).otherwise(F.array(own))
    rows = members.select("grp", "id", "text", F.explode(blocks).alias("block"))

    def run(table: pa.Table) -> pa.Table:
        ids, sets = table.column("id").to_pylist(), _text_sets(table, n)
        grp = table.column("grp")[0].as_py()
        # of several sets under the first's key all blocks take the same one
        first = min((s for i, s in zip(ids, sets) if i == grp and len(s)), key=lambda s: s.tobytes())
        steps, direct = [], []
        for s in sets:
            at = np.minimum(np.searchsorted(first, s), len(first) - 1)
            shared = int((first[at] == s).sum())
            union = len(first) + len(s) - shared
            away, step = 100 * (union - shared), union * max(1, 100 - percent)
            steps.append(-1 if away == 0 else away // step)
            direct.append(away <= step)
        return pa.table({"id": table.column("id"), "grp": table.column("grp"), "step": pa.array(steps, pa.int32()), "direct": pa.array(direct, pa.bool_())})

    found = rows.groupBy("grp", "block").applyInArrow(run, "id long, grp long, step int, direct boolean")
    return found.where("step >= 0")


def _joined(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) that connect the groups of members (id, text, grp, n_blocks).

    Sets that link with their group's first need no more among themselves. Jaccard distance is a metric: other sets
    are compared only with those whose distance from the first is about the same, that is, whose step is the same or
    the next one; block against block. A set exactly one step away links with the first, but is in step 1: it may link
    with sets up to exactly two steps away.
    """
    steps = stash(_from_first(members, n, percent))
    direct = steps.where("direct").select(F.col("id").alias("u"), F.col("grp").alias("v"))
    cells = steps.groupBy("grp", "step").agg(F.ceil(F.count("*") / BLOCK).alias("own"))
    along = Window.partitionBy("grp").orderBy("step")  # a few rows a group
    beside = lambda f, by: F.when(f("step").over(along) == F.col("step") + by, f("own").over(along)).otherwise(F.lit(0)).cast("long")
    cells = cells.select("grp", "step", "own", beside(F.lag, -1).alias("before"), beside(F.lead, 1).alias("after"))
    cells = cells.where("step > 0 or after > 0")
    rows = members.drop("n_blocks").join(steps.drop("direct").distinct().join(cells, ["grp", "step"]), ["id", "grp"])
    block, zero, k = F.pmod(F.xxhash64("id"), F.col("own")), F.lit(0).cast("long"), F.col("step")
    pair = lambda a, i, b, j: F.struct(a.alias("low"), i.alias("i"), b.alias("high"), j.alias("j"))
    upto = lambda m: F.filter(F.sequence(zero, F.greatest(m, F.lit(1)) - 1), lambda x: x < m)
    same = F.transform(upto(F.when(k > 0, F.col("own")).otherwise(zero)), lambda x: pair(k, F.least(block, x), k, F.greatest(block, x)))
    after = F.transform(upto(F.col("after")), lambda x: pair(k, block, k + 1, x))
    before = F.transform(upto(F.col("before")), lambda x: pair(k - 1, x, k, block))
    rows = rows.withColumn("block", block).withColumn("p", F.explode(F.concat(same, after, before))).select("grp", "p.*", "step", "block", "id", "text")

    def run(table: pa.Table) -> pa.Table:
        ids, sets = table.column("id").to_pylist(), [s.tolist() for s in _text_sets(table, n)]
        low, i, high, j = (table.column(c)[0].as_py() for c in ("low", "i", "high", "j"))
        step, block = np.asarray(table.column("step")), np.asarray(table.column("block"))
        one, two = (np.flatnonzero((step == a) & (block == b)).tolist() for a, b in ((low, i), (high, j)))
        if (low, i) == (high, j):
            found = _spanning(similar([sets[x] for x in one], None, percent), [ids[x] for x in one])
        else:
            found = _spanning(similar([sets[x] for x in one], [sets[x] for x in two], percent), [ids[x] for x in one + two], len(one))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return direct.unionAll(rows.groupBy("grp", "low", "i", "high", "j").applyInArrow(run, "u long, v long"))


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``key`` (long), n_shingles (distinct n-grams), component_id (smallest key reachable by links).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of n consecutive words (A-Z
    lower-cased; a text of fewer words is one n-gram). Null and empty texts have no n-gram and link with nothing; so do
    rows with a null key, whose component_id is null. Rows that repeat a key are one vertex: whatever either links
    with, both do. Other columns are not read, so their names don't matter.
    """
    sets = stash(_sets(docs, key, text, n, percent))
    classes, meeting = sets.where("n_shingles is not null").select("id", "n_shingles", "class"), sets.where("node is not null").select("node", "band", "id")
    keyed = classes.where("id is not null and class is not null")
    reps = stash(keyed.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    copy_links = stash(keyed.join(reps, "class").where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    # equal sets: their first stands for all of them; a key of several sets stays, for the sake of the others
    several = keyed.groupBy("id").agg(F.count_distinct("class").alias("k")).where("k > 1").select("id")
    copies = copy_links.select(F.col("u").alias("id")).distinct().join(several, "id", "left_anti")

    shared = stash(meeting.groupBy("node").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("node"))
    met = stash(meeting.join(shared, "node").join(copies, "id", "left_anti"))
    sketches = sets.where("sketch is not null").select("id", "band", "sketch")
    near = connected_components(stash(_alike(met, sketches, percent)))
    sizes = near.groupBy("component").agg(F.count("*").alias("members")).where("members > 1")
    groups = stash(near.join(sizes, "component").select("id", F.col("component").alias("grp"), F.ceil(F.col("members") / BLOCK).alias("n_blocks")))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # texts always move by their key: one plan at every size
    links = _joined(stash(texts.join(groups.hint("merge"), "id")), n, percent)

    components = connected_components(stash(links).unionAll(copy_links))
    out = classes.select("id", "n_shingles").join(components, "id", "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first (smallest key) of their group; rows with a null key stay."""
    gone = jaccard_groups(docs, key, text, n, percent).where(f"{key} <> component_id").select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, F.col(key) == F.col("_gone"), "left_anti")
