"""Source divergence audit: how far apart the sources of a language are in their terms, and what marks each of them.

Counts of terms are gathered per (language, source). Kept terms are dealt into blocks; a block is a dense tile of int64,
groups by terms, zeros included. Within a tile all pairs of groups are compared by broadcasting, and each group keeps a
heap of the terms that it uses most above its language. Partial pair matrices are summed, heaps are merged. Where a
language has more than GROUPS sources, tiles are of two blocks of groups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stash

#: Terms and groups of a tile; pairs by terms that are broadcast at one time.
TERMS, GROUPS, AT_ONCE = 512, 256, 1 << 20
#: A document has kept terms of its language if so many documents of that language hold them.
MIN_DOCUMENTS = 30
UNIT, PRIOR = 1_000_000_000, 5
#: Bytes of text that are cut into terms at one time, and distinct terms that a task gathers before it passes them on.
PIECE, GATHERED = 4 << 20, 200_000

#: ASCII other than letters parts terms; A-Z become small.
_LETTER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, part by part."""
    at = 0
    while at < len(text):
        upto = at + PIECE
        while upto < len(text) and _LETTER[text[upto]] != 32:
            upto += 1
        yield text[at:upto].translate(_LETTER).split()
        at = upto


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), in parts: occurrences and documents. A null term's row counts the documents of a group."""
    names = ["lang", "source", "term", "n", "docs"]

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]], seen: Counter) -> pa.RecordBatch:
        keys = [(*group, term, n, held[group][1][term]) for group in held for term, n in held[group][0].items()] + [(*group, None, n, n) for group, n in seen.items()]
        lang, source, term, n, docs = zip(*keys)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        seen: Counter = Counter()
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())):
                uses, documents = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(uses)
                own: set[bytes] = set()
                for part in terms(text.as_py()):
                    uses.update(part)
                    own.update(part)
                documents.update(own)
                seen[lang, source] += 1
                size += len(uses) - before
                if size > GATHERED:
                    yield rows(held, seen)
                    held, seen, size = {}, Counter(), 0
        if seen:
            yield rows(held, seen)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kept)), exact; totals run along the first axis."""
    below = (totals + PRIOR * kept).reshape(-1, *[1] * (counts.ndim - 1))
    if counts.max(initial=0) + PRIOR < np.iinfo(np.int64).max // UNIT:
        return 1 + (counts + PRIOR) * UNIT // np.maximum(below, 1)
    return (1 + (counts.astype(object) + PRIOR) * UNIT // np.maximum(below, 1)).astype(np.int64)


def _tile(top: int):
    """Of a tile: (lang, source, part, item, value), sums over its terms for pairs of groups, and each group's heap."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        lang, one, two = table.column("lang")[0], *(table.column(c)[0].as_py() for c in ("low", "high"))
        is_group = pc.is_null(table.column("term"))
        groups, uses = table.filter(is_group).sort_by("source"), table.filter(pc.invert(is_group))
        names, kept = groups.column("source").combine_chunks(), groups.column("kept")[0].as_py()
        words = uses.column("term").combine_chunks().dictionary_encode()
        tile = np.zeros((len(names), len(words.dictionary)), np.int64)
        row, column = np.asarray(pc.index_in(uses.column("source").combine_chunks(), names)), np.asarray(words.indices)
        tile[row, column] = np.asarray(uses.column("n"))
        p = shares(tile, np.asarray(groups.column("n")), kept)
        # terms of this tile that only groups of other blocks use
        absent, unused = groups.column("held")[0].as_py() - tile.shape[1], shares(np.zeros(len(names), np.int64), np.asarray(groups.column("n")), kept)
        block = np.asarray(groups.column("block"))
        mine, others = np.flatnonzero(block == one), np.flatnonzero(block == two)
        found: list[pa.Table] = []

        def add(part: str, sources: pa.Array, items: pa.Array, values: np.ndarray) -> None:
            found.append(pa.table([pa.repeat(lang, len(values)), sources, pa.repeat(part, len(values)), items, pa.array(values, pa.int64())], schema=schema))

        step = max(1, AT_ONCE // max(1, len(others) * tile.shape[1]))
        for lo in range(0, len(mine), step):
            i = mine[lo : lo + step]
            apart = np.abs(p[i][:, None, :] - p[others][None, :, :]).sum(axis=2) + absent * np.abs(unused[i][:, None] - unused[others][None, :])
            a, b = (x.ravel() for x in np.meshgrid(i, others, indexing="ij"))
            new = a != b
            a, b, apart = names.take(pa.array(a[new])), names.take(pa.array(b[new])), apart.ravel()[new]
            add("pair", a, b, apart)
            if one != two:
                add("pair", b, a, apart)
        if one == two and len(words.dictionary):
            overall = np.zeros(tile.shape[1], np.int64)
            overall[column] = np.asarray(uses.column("all_n"))
            over = p - shares(overall[None], np.asarray(groups.column("all_n"))[:1], kept)
            alphabetic = np.empty(tile.shape[1], np.int64)
            alphabetic[np.asarray(pc.sort_indices(words.dictionary.cast(pa.binary())))] = np.arange(tile.shape[1])
            for g in mine.tolist():
                marks = np.flatnonzero((tile[g] > 0) & (over[g] > 0))
                marks = marks[np.lexsort((alphabetic[marks], -over[g, marks]))[:top]]
                if len(marks):
                    add("term", pa.repeat(names[g], len(marks)), words.dictionary.take(pa.array(marks)), over[g, marks])
        return pa.concat_tables(found) if found else schema.empty_table()

    return run


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_documents: int = MIN_DOCUMENTS, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) of ``docs``.

    Terms are runs of letters and non-ASCII characters, A-Z as small letters; a language keeps those that at least
    ``min_documents`` of its documents hold. A group's share of a term is smoothed and in whole billionths, all in integers.
    Part ``pair``: item is another source of the language, value the sum of what their shares of kept terms differ by (0 where
    the language keeps none); all of them, ranked. Part ``term``: item is a term of the group whose share is above its
    language's, value by how much, the first ``top``. Ranks: value descending, then item by its bytes.

    Null text, language and source count as empty; empty texts have no terms, but their group is there. Each row is a
    document, also where keys repeat. Other columns are not read. An empty table gives an empty result.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = stash(_counted(texts).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    kept = stash(kept.where(F.col("docs") >= min_documents).drop("docs"))
    uses = stash(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]))

    # a language's kept terms and all their uses, a group's uses, a language's groups
    mine = uses.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.where("term is null").select("lang", "source").join(mine, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("all_n"), F.ceil(F.count("*") / GROUPS).alias("blocks"))
    size = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    langs = stash(langs.join(size, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0))).withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS))))

    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    tile = F.pmod(F.xxhash64("term"), "tiles").alias("tile")
    held = kept.join(langs.select("lang", "tiles"), "lang").groupBy("lang", tile).agg(F.count("*").alias("held"))
    rows = uses.join(langs.select("lang", "blocks", "kept", "tiles"), "lang").withColumn("tile", tile)
    heads = groups.join(langs, "lang").withColumn("tile", F.explode(numbers(F.col("tiles")))).join(held, ["lang", "tile"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    rows = rows.unionByName(heads, allowMissingColumns=True).withColumn("block", F.pmod(F.xxhash64("source"), "blocks")).withColumn("with", F.explode(numbers(F.col("blocks"))))
    rows = rows.select("lang", "tile", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "source", "term", "n", "all_n", "kept", "held")
    found = rows.groupBy("lang", "tile", "low", "high").applyInArrow(_tile(top), "lang string, source string, part string, item string, value long")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
