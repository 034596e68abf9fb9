"""Substring dedup: words of passages that already stand in an earlier document are removed.

Windows of ``window`` consecutive words are the edges of a De Bruijn graph; its nodes are the sequences of one word
less that they begin and end with. Texts that repeat as a whole are set aside: only the earliest copy enters the graph.

1. Windows of a document that follow each other and share an anchor (the smallest hash among their inner word k-mers;
   equal windows have equal anchors) are a run. Runs whose anchor stands in one document alone can't repeat.
2. Equal runs are one path of the graph, with the coordinates (document, first word) at which it stands first. A node
   between two paths doesn't branch if wherever the one stands the other follows, and wherever that stands the one is before.
3. Repeated paths that meet in such nodes are compacted to one, by joins whose reach doubles every round. Wherever its
   head stands, all of it stands: compacted paths are the candidates, and only their heads are looked up in documents.
4. A path is verified once: the words at its source's coordinates are digested, and a span is cut only if its own words
   have that digest.
5. Only where anchors branch, that is have several paths, may paths share single windows: there paths are opened to
   single edges in the document that holds them first, and what repeats among those is verified in the same way, span by span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import places, stash
from .text_arrays import FAMILIES, Words, _powers, inside, mix, pieces, rolling, signed, words

#: Paths and edges that hold more than one part in so many of all rows are joined in parts of that size: there are fewer than that.
HOT = 4096


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of windows, their anchors, word hashes)."""
    hashes = w.hashes()
    k = max(2, window // 2)
    grams, n = rolling(hashes, k), len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), hashes
    least = grams[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(least, grams[j : j + n], out=least)
    at = np.flatnonzero(inside(w, window))
    return at, least[at], hashes


def _spans_hash(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the words start:stop, for arrays of places."""
    base = FAMILIES[1]
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes, 5) * _powers(base.root, len(hashes)), out=sums[1:])
    return mix((sums[stop] - sums[start]) * _powers(base.inverse, len(hashes) + 1)[start] + (stop - start).astype(np.uint64), 9)


def _anchored(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, id) of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words(part.column("text"))
                at, anchor, _ = _anchors(w, window)
                owner = w.doc[at]
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])][: len(at)])
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[new])), part.column("id").take(pa.array(owner[new]))], ["anchor", "id"])

    return docs.mapInArrow(run, "anchor long, id long")


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, path, id, place): a run of windows of one anchor. path is the hash of its words; place holds its first word, times 2^32, and its number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words(part.column("text"))
                at, anchor, hashes = _anchors(w, window)
                if not len(at):
                    continue
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
                start, owner, n = at[new], w.doc[at[new]], np.diff(np.r_[new, len(at)])
                columns = [signed(anchor[new]), signed(_spans_hash(hashes, start, start + n + window - 1)), np.asarray(part.column("id"))[owner], (start - w.bounds[owner]) << 32 | n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "path", "id", "place"])

    return docs.mapInArrow(run, "anchor long, path long, id long, place long")


def _edges(docs: DataFrame, window: int) -> DataFrame:
    """(u, v, id, start) of the windows of ``runs``, a column of (start, n): the hashes of their first and of their last words, one less than the window has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w, runs = words(part.column("text")), part.column("runs")
                nodes = signed(rolling(w.hashes(), window - 1))
                owner = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(runs)))
                start, n = (np.asarray(x, np.int64) for x in runs.flatten().flatten())
                fits = start + n + window - 1 <= np.diff(w.bounds)[owner]  # a row that repeats another's key may be shorter
                owner, start, n = owner[fits], start[fits], n[fits]
                each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                owner, start = np.repeat(owner, n), np.repeat(start, n) + each
                at = w.bounds[owner] + start
                columns = [nodes[at], nodes[at + 1], np.asarray(part.column("id"))[owner], start.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["u", "v", "id", "start"])

    return docs.mapInArrow(run, "u long, v long, id long, start int")


def compact(paths: DataFrame) -> DataFrame:
    """(at, path, place) for paths (at, u, v): ``at`` names a path, u and v are the nodes at which it begins and ends.

    Paths that follow each other over nodes with one path in and one out are one longer path, named by its first;
    place counts the paths before. Circles stay in parts.
    """
    ends = paths.select(F.col("u").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")).unionAll(paths.select("v", F.lit(1), F.lit(0)))
    ends = ends.groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out"))
    straight = stash(ends.where("into = 1 and out = 1").select("node"))
    after = paths.select("at", F.col("u").alias("node")).join(straight.hint("merge"), "node")
    # of a straight node one path comes
    ahead = after.join(paths.select(F.col("at").alias("path"), F.col("v").alias("node")).hint("merge"), "node").where("at <> path").select("at", "path", F.lit(1).alias("place"))
    spots, i, moving = places(paths.sparkSession), 0, -1
    ahead = stash(ahead, spots[1])
    while True:
        further = ahead.select(F.col("at").alias("path"), F.col("path").alias("next"), F.col("place").alias("more"))
        ahead = ahead.drop("moved").join(further.hint("merge"), "path", "left")
        ahead = stash(ahead.select("at", F.coalesce("next", "path").alias("path"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("next").isNotNull().alias("moved")), spots[i])
        i = 1 - i
        before, moving = moving, ahead.where("moved").count()
        if moving in (0, before):  # a path has fewer that move every round, a circle as many
            break
    found = paths.select("at").join(ahead.where("not moved").drop("moved").hint("merge"), "at", "left")
    return found.select("at", F.coalesce("path", "at").alias("path"), F.coalesce("place", F.lit(0)).alias("place"))


def _with_source(rows: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, id, ...) joined to their source (keys, rows, ...), rows being how many they are; frequent keys are joined in parts."""
    total = sources.agg(F.sum("rows").alias("total"))
    shares = sources.crossJoin(F.broadcast(total)).withColumn("parts", F.when(F.col("rows") * HOT > F.col("total"), F.ceil(F.col("rows") * HOT / F.col("total"))).otherwise(F.lit(1)).cast("long")).drop("total", "rows")
    # fewer than HOT rows
    hot = F.broadcast(stash(shares.where("parts > 1").select(*[F.col(k).alias(f"hot_{k}") for k in keys], "parts")))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"hot_{k}"))
    rows = rows.join(hot, same, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0))).drop("parts", *[f"hot_{k}" for k in keys])
    return rows.join(shares.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts").hint("merge"), [*keys, "part"]).drop("part")


def _joined_up(late: DataFrame) -> DataFrame:
    """Spans (id, start, n, sid, sstart) of single windows in ``late`` (id, start, sid, sstart) that follow each other at one distance from the source."""
    by = ["id", "sid", "apart"]
    # windows of one distance that follow each other keep their distance from their place in order, too
    rows = late.withColumn("apart", F.col("start") - F.col("sstart")).drop("sstart")
    rows = rows.withColumn("island", F.col("start") - F.dense_rank().over(Window.partitionBy(*by).orderBy("start")))
    spans = rows.groupBy(*by, "island").agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + 1).alias("n"))
    return spans.select("id", "start", "n", "sid", (F.col("start") - F.col("apart")).alias("sstart"))


def _digest(parts: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(parts), digest_size=16).digest()


def _verified(places: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(sid, sstart, n, digest) for distinct ``places`` (sid, sstart, n): the digest of the words there."""
    asked = places.groupBy(F.col("sid").alias("id")).agg(F.collect_list(F.struct("sstart", "n")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words(part.column("text"))
                data, out = w.data.tobytes(), []
                for key, lo, hi, asked in zip(part.column("id").to_pylist(), w.bounds[:-1].tolist(), w.bounds[1:].tolist(), part.column("asked").to_pylist()):
                    for s in asked:
                        a, b = lo + s["sstart"], lo + s["sstart"] + s["n"] + window - 1
                        if b <= hi:
                            out.append((key, s["sstart"], s["n"], _digest([data[x:y] for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist())])))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], ["sid", "sstart", "n", "digest"])

    # a key of several rows has a digest for each text
    return docs.join(asked.hint("merge"), "id").mapInArrow(run, "sid long, sstart int, n int, digest binary").distinct()


def _whole(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """(id, start, n, digest, sid, sstart): n windows from word ``start`` on that also start at word sstart of document sid, which has a smaller id.

    A row per compacted path that the document holds, or per span of single windows; digest is that of the words at sstart.
    Texts that repeat one of a smaller id as a whole have one row of id, sid and the digest of the text.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    whole = docs.select("id", _whole(F.col("text")).alias("whole"))
    several = whole.groupBy("whole").agg(F.min("id").alias("sid"), F.max("id").alias("last")).where("sid < last")
    copies = stash(whole.join(several.hint("merge"), "whole").where("id > sid").select("id", "whole", "sid").distinct())
    # a key of several rows may stand for other texts too: it stays in the graph
    again = stash(docs.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"))
    aside = stash(copies.join(again.hint("merge"), "id", "left_anti").select("id"))

    shared = stash(_anchored(docs, window).groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor"))
    runs = _runs(docs, window).join(shared.hint("merge"), "anchor").join(aside.hint("merge"), "id", "left_anti")
    runs = stash(runs.select("anchor", "path", "id", F.shiftright("place", 32).cast("int").alias("start"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("n")))
    at = F.min(F.struct(F.col("id").alias("sid"), F.col("start").alias("sstart"))).alias("at")
    paths = stash(runs.groupBy("anchor", "path").agg(at, F.max("id").alias("last"), F.count("*").alias("rows"), F.min("n").alias("n")))
    several = paths.where("rows > 1").select("anchor", "path", "at", "last", "rows")
    places = stash(_with_source(runs, several, ["anchor", "path"]))
    heads = _compacted(paths.where("at.sid < last"), places.where("at.sid < last"), again)

    # windows that paths of one anchor share: all places of a path in the document that holds it first
    branching = paths.groupBy("anchor").agg(F.count("*").alias("several")).where("several > 1").select("anchor")
    opened = paths.where("rows = 1").select("anchor", F.col("at.sid").alias("id"), F.col("at.sstart").alias("start"), "n").unionAll(places.where("id = at.sid").select("anchor", "id", "start", "n"))
    opened = opened.join(branching.hint("merge"), "anchor").groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    edges = stash(_edges(docs.join(opened.hint("merge"), "id"), window))
    first = edges.groupBy("u", "v").agg(F.min(F.struct("id", "start")).alias("source"), F.max("id").alias("last"), F.count("*").alias("rows"))
    first = stash(first.where("source.id < last").select("u", "v", F.col("source.id").alias("sid"), F.col("source.start").alias("sstart"), "rows"))
    single = stash(_joined_up(_with_source(edges, first, ["u", "v"]).where("id > sid").select("id", "start", "sid", "sstart")))

    wanted = heads.select("sid", "sstart", "n").unionAll(single.select("sid", "sstart", "n").distinct())
    digests = stash(_verified(wanted, docs, window))
    heads = stash(heads.join(digests.hint("merge"), ["sid", "sstart", "n"]))
    whole_paths = _with_source(places.select("anchor", "path", "id", "start"), heads, ["anchor", "path"]).where("id > sid").select("id", "start", "n", "digest", "sid", "sstart")
    singles = single.join(digests.hint("merge"), ["sid", "sstart", "n"]).select("id", "start", "n", "digest", "sid", "sstart")
    none = F.lit(None).cast("int")
    return whole_paths.unionAll(singles).unionAll(copies.select("id", none, none, F.col("whole"), "sid", none))


def _compacted(paths: DataFrame, places: DataFrame, again: DataFrame) -> DataFrame:
    """(anchor, path, sid, sstart, n, rows): heads of compacted ``paths``, each with all the windows that follow from it.

    places: all places of the paths. Keys of several rows (``again``) tell nothing of what follows what.
    """
    text = Window.partitionBy("id").orderBy("start", "path")
    begin, end = F.col("start"), F.col("start") + F.col("n")
    own = lambda salt: F.xxhash64(F.lit(salt), "id", "start", "path")  # noqa: E731  like no other
    around = places.join(again.select(F.col("id").alias("_again")).hint("merge"), F.col("id") == F.col("_again"), "left")
    around = around.withColumns({"_before": F.when(F.lag(end).over(text) == begin, F.lag("path").over(text)), "_after": F.when(F.lead(begin).over(text) == end, F.lead("path").over(text))})
    single = F.col("_again").isNull()
    around = around.select("anchor", "path", F.coalesce(F.when(single, F.col("_before")), own(1)).alias("before"), F.coalesce(F.when(single, F.col("_after")), own(2)).alias("after"))
    around = around.groupBy("anchor", "path").agg(*[f(c).alias(f"{c}{i}") for c in ("before", "after") for i, f in enumerate((F.min, F.max))])
    paths = stash(paths.join(around.hint("merge"), ["anchor", "path"]))
    # a node between two paths has one number, made of both, on either side; ends and branches have numbers of their own
    node = lambda one, two: F.xxhash64(one, two)
    u = F.when(F.col("before0") == F.col("before1"), node(F.col("before0"), F.col("path"))).otherwise(F.xxhash64(F.lit(1), "anchor", "path"))
    v = F.when(F.col("after0") == F.col("after1"), node(F.col("path"), F.col("after0"))).otherwise(F.xxhash64(F.lit(2), "anchor", "path"))
    joined = compact(paths.select("at", u.alias("u"), v.alias("v")))
    parts = paths.select("anchor", F.col("path").alias("words"), "at", "n", "rows").join(joined.hint("merge"), "at")
    # of a path that is whole, each part begins in the source where the one before ends
    along, every = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    follows = (F.col("at.sid") == F.col("path.sid")) & (F.col("at.sstart") == F.col("path.sstart") + F.coalesce(F.sum("n").over(along), F.lit(0)))
    parts = parts.withColumn("follows", follows).withColumn("whole", F.bool_and("follows").over(every)).withColumn("windows", F.sum("n").over(every).cast("int"))
    heads = parts.where("not whole or place = 0")
    return stash(heads.select("anchor", F.col("words").alias("path"), F.col("at.sid").alias("sid"), F.col("at.sstart").alias("sstart"), F.when(F.col("whole"), F.col("windows")).otherwise(F.col("n")).alias("n"), "rows"))


def cut_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """``docs`` with the words of earlier documents' passages cut out of ``text``; adds n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller key; windows
    are judged on the input. What stays keeps its layout; a cut leaves one space. kept_sha256 is the digest of the kept
    words joined by one space. Null texts: no words, text stays null. Rows with a null key lose nothing and are no
    source. Rows that repeat a key count as one document: none is a source of the other. Texts under ``window`` words
    stay. Extra columns are carried along, whatever their names.
    """
    spans = repeated_spans(docs, key, text, window)
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    rows = docs.toDF(*names).withColumn(names[at], F.col(names[at]).cast("string"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.join(spans.hint("merge"), F.col(names[docs.columns.index(key)]).cast("long") == F.col("id"), "left").drop("id")
    kept = rows.select(*names, "spans").mapInArrow(_cutter(names, names[at], window), types + ", n_words long, n_removed long, kept_sha256 string")
    return kept.toDF(*docs.columns, "n_words", "n_removed", "kept_sha256")


def _cutter(names: list[str], text: str, window: int):
    def stays(n: int, given: list[dict], own: list[bytes], raw: str | None) -> np.ndarray:
        """Which words of a text stay: those of no span whose words have its digest."""
        stay = np.ones(n, bool)
        for s in given:
            if s["start"] is None:
                if n >= window and hashlib.sha256((raw or "").encode()).digest() == s["digest"]:
                    stay[:] = False
            else:
                a, b = s["start"], s["start"] + s["n"] + window - 1
                if b <= n and _digest(own[a:b]) == s["digest"]:
                    stay[a:b] = False
        return stay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                w = words(part.column(text))
                data, start, end = w.data.tobytes(), w.start.tolist(), w.end.tolist()
                kept, counts, removed, digests = part.column(text).to_pylist(), np.diff(w.bounds), [], []
                for i, spans in enumerate(part.column("spans").to_pylist()):
                    lo, hi = int(w.bounds[i]), int(w.bounds[i + 1])
                    own = [data[a:b] for a, b in zip(start[lo:hi], end[lo:hi])]
                    if spans:
                        stay = stays(hi - lo, spans, own, kept[i])
                        at = np.flatnonzero(stay)
                        if (n := len(at)) < hi - lo:
                            new = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1]) if n else []
                            last = np.r_[new[1:], n] - 1 if n else []
                            kept[i] = b" ".join(data[start[lo + a] : end[lo + b]] for a, b in zip(at[new].tolist(), at[last].tolist())).decode() if n else ""
                            own = [own[a] for a in at.tolist()]
                    removed.append(hi - lo - len(own))
                    digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
                columns = [pa.array(kept, pa.string()) if c == text else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], [*names, "n_words", "n_removed", "kept_sha256"])

    return run
