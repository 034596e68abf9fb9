"""Quality classifier: document evidence and hierarchical empirical-Bayes posteriors of sites.

Evidence of a document is the sum of log odds of the features that it holds: words, their beginnings and endings, and
the share of distinct words. Features are hashed to a fixed number of buckets; only those with clear odds in a bounded
sample of labelled rows count. A logistic curve turns evidence for and against into a probability. Labelled outcomes are grouped by
host and by path within host; a path's rate is shrunk toward its host's, a host's toward the global one, by
beta-binomial priors whose strength is estimated from the spread of rates. A document's log odds and those of its site
(relative to the global rate) add up; the site's are those without the document's own label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stash
from .text_arrays import FAMILIES, Words, _powers, mix, pieces, words
from .url_filter import strength

#: Feature buckets, and the bound of the training sample in rows.
FEATURES, SAMPLE = 1 << 18, 12_000
#: A feature counts from so many documents and so many standard errors on.
LEAST_DOCS, LEAST_Z = 8, 5.0
#: The targets: 1 - quality, and toxic.
TARGETS = ("bad", "toxic")


def _byte_hashes(w: Words, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    base = FAMILIES[0]
    sums = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum(base.table[w.data] * _powers(base.root, len(w.data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers(base.inverse, len(w.data) + 1)[start], salt)


def features(w: Words, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, distinct and in order of documents; only useful features, if these are given."""
    kinds = [_byte_hashes(w, w.start, w.end, 201), _byte_hashes(w, w.start, np.minimum(w.start + 5, w.end), 202), _byte_hashes(w, np.maximum(w.end - 2, w.start), w.end, 203)]
    n = len(w.bounds) - 1
    doc = np.concatenate([w.doc] * 3) if len(w.doc) else np.zeros(0, np.int64)
    bucket = (np.concatenate(kinds) % np.uint64(FEATURES)).astype(np.int64) if len(w.doc) else np.zeros(0, np.int64)
    if useful is not None:
        held = useful[bucket]
        doc, bucket = doc[held], bucket[held]
    pairs = np.unique(doc * FEATURES + bucket)
    # share of distinct words, in eighths
    counts = np.diff(w.bounds)
    first = np.unique(mix(kinds[0] ^ mix(w.doc.astype(np.uint64), 205)), return_index=True)[1]
    distinct = np.bincount(w.doc[first], minlength=n)
    share = np.minimum(8 * distinct // np.maximum(counts, 1), 7) + 10 * np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), 12)
    style = mix(share.astype(np.uint64), 204) % np.uint64(FEATURES)
    pairs = np.unique(np.concatenate([pairs, np.arange(n) * FEATURES + style.astype(np.int64)]))
    return pairs // FEATURES, pairs % FEATURES


class Weights:
    """Log odds of the features that count, and the curve from evidence to log odds, for each target."""

    def __init__(self, odds: np.ndarray):
        self.odds = odds.astype(np.float32)
        self.curve = np.tile([1.0, 1.0, 0.0], (len(TARGETS), 1))

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """(target, 2, text): roots of the sums of log odds for the target, and of those against it.

        Kept apart, so that a few clear signs aren't drowned by the many plain words of a long text.
        """
        doc, bucket = features(words(texts, lower=False), (self.odds != 0).any(axis=0))
        parts = [np.maximum(o[bucket], 0) for o in self.odds for o in (o, -o)]
        return np.sqrt(np.stack([np.bincount(doc, x, len(texts)) for x in parts])).reshape(len(TARGETS), 2, -1)

    def log_odds(self, evidence: np.ndarray) -> np.ndarray:
        """Weighted evidence for less weighted evidence against; without evidence the sample's base rate."""
        return evidence[:, 0] * self.curve[:, :1] - evidence[:, 1] * self.curve[:, 1:2] + self.curve[:, 2:]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes (not negative) of evidence for and against, by Newton's method with a ridge; the intercept is the base rate's log odds."""
    base = (y.sum() + 0.5) / (len(y) + 10)
    intercept, b = float(np.log(base / (1 - base))), np.zeros(2)
    z = np.stack([x[:, 0], -x[:, 1]], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b + intercept, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2), z.T @ (y - p) - 0.01 * b)
        b = np.maximum(b + np.clip(step, -5, 5), 0)
        if np.abs(step).max() < 1e-6:
            break
    return np.array([*b, intercept])


def _marked(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, bad, toxic) of labelled rows; a label that is null counts as good."""
    return docs.join(_marks(labels, key), F.col("id") == F.col("i")).drop("i")


def _marks(labels: DataFrame, key: str) -> DataFrame:
    marks = labels.select(F.col(key).cast("long").alias("i"), (F.coalesce("quality", F.lit(1)) == 0).cast("int").alias("bad"), (F.coalesce("toxic", F.lit(0)) == 1).cast("int").alias("toxic"))
    return marks.where("i is not null").groupBy("i").agg(F.max("bad").alias("bad"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Weights:
    """Learns from at most about SAMPLE labelled rows, chosen by a hash of the key."""
    share = min(1.0, SAMPLE / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64(F.lit(3), F.col(key).cast("long")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = stash(_marked(docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")), chosen, key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                doc, bucket = features(words(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *(part.column(t).take(pa.array(doc)) for t in TARGETS)], ["f", *TARGETS])

    counted = rows.mapInArrow(run, "f int, bad int, toxic int").groupBy("f").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).where(F.col("n") >= LEAST_DOCS)
    total = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TARGETS]).first()
    odds = np.zeros((len(TARGETS), FEATURES))
    found = counted.toPandas()  # FEATURES rows at most
    for k, t in enumerate(TARGETS):
        pos, neg = total[t], total["n"] - total[t]
        a, b = found[t].to_numpy(float), (found["n"] - found[t]).to_numpy(float)
        rate, base = a / np.maximum(a + b, 1), pos / max(1, pos + neg)
        z = (rate - base) / np.sqrt(max(base * (1 - base), 1e-9) / np.maximum(a + b, 1))
        value = np.log((a + 0.5) / (pos + 1)) - np.log((b + 0.5) / (neg + 1))
        value[np.abs(z) < LEAST_Z] = 0
        odds[k, found["f"].to_numpy(int)] = value
    model = Weights(odds)
    shown = _evidence(rows.select("id", "text", *TARGETS), model, list(TARGETS)).toPandas()  # SAMPLE rows, numbers only
    for k, t in enumerate(TARGETS):
        model.curve[k] = _logistic(shown[[f"{t}_for", f"{t}_against"]].to_numpy(float), shown[t].to_numpy(float))
    return model


def _evidence(rows: DataFrame, model: Weights, also: list[str]) -> DataFrame:
    """Adds {target}_for, {target}_against and {target}_logit to the columns ``also`` and id."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = ["id", *also]
    names = [*(f"{t}_{x}" for t in TARGETS for x in ("for", "against")), *(f"{t}_logit" for t in TARGETS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                e = shared.value.evidence(part.column("text"))
                logits = shared.value.log_odds(e)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *map(pa.array, e.reshape(2 * len(TARGETS), -1)), *map(pa.array, logits)], [*kept, *names])

    types = dict(rows.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in kept] + [f"{n} double" for n in names])
    return rows.select(*kept, "text").mapInArrow(run, schema)


def _sites(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, tuple[float, float, float]]]:
    """Paths (host, path, n, bad, toxic), hosts (host, n, bad, toxic), and for each target the global rate and the strengths of the hosts' and the paths' priors.

    Counts are grouped by host and path first and added up to hosts, so that a hot host is no one task's. Null hosts and
    paths are sites of their own.
    """
    paths = stash(outcomes.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]))
    hosts = stash(paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]))
    # one row of sums
    sums = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TARGETS]).first()
    priors = {}
    for t in TARGETS:
        p0 = (sums[t] + 0.5) / (sums["n"] + 1)
        k1 = strength(hosts.select("n", F.col(t).alias("bad"), F.lit(p0).alias("p")), "p").first()["k"]
        own = hosts.select(F.col("host").alias("h"), ((F.col(t) + k1 * p0) / (F.col("n") + k1)).alias("p"))
        k2 = strength(paths.join(own, F.col("host").eqNullSafe(F.col("h"))).select("n", F.col(t).alias("bad"), "p"), "p").first()["k"]
        priors[t] = p0, k1, k2
    return paths, hosts, priors


def _shift(t: str, prior: tuple[float, float, float], one: Column) -> Column:
    """Log odds of a site's posterior rate less the global ones, from the counts (host_n, host_{t}, path_n, path_{t}) of its host and path; one: the label to leave out, null for none."""
    p0, k1, k2 = prior
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    own, seen = F.coalesce(one, F.lit(0)), one.isNotNull().cast("int")
    p1 = (count(f"host_{t}") - own + k1 * p0) / (count("host_n") - seen + k1)
    p2 = (count(f"path_{t}") - own + k2 * p1) / (count("path_n") - seen + k2)
    return F.log(p2 / (1 - p2)) - float(np.log(p0 / (1 - p0)))


def _with_sites(rows: DataFrame, paths: DataFrame, hosts: DataFrame) -> DataFrame:
    named = lambda df, of: df.select(F.col("host").alias("h"), *([F.col("path").alias("p")] if of == "path" else []), *[F.col(c).alias(f"{of}_{c}") for c in ("n", *TARGETS)])
    rows = rows.join(named(paths, "path"), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left").drop("h", "p")
    return rows.join(named(hosts, "host"), F.col("host").eqNullSafe(F.col("h")), "left").drop("h")


def site_posteriors(outcomes: DataFrame) -> DataFrame:
    """(host, path, bad_shift, toxic_shift): log odds of each site's posterior rates less the global ones, from labelled rows (host, path, bad 0/1, toxic 0/1)."""
    paths, hosts, priors = _sites(outcomes)
    rows = _with_sites(paths.select("host", "path"), paths, hosts)
    return rows.select("host", "path", *[_shift(t, priors[t], F.lit(None).cast("int")).alias(f"{t}_shift") for t in TARGETS])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: Column | str = "source", path: Column | str = "lang", sites: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(``key``, p_bad, p_toxic, bad_logit, toxic_logit, bad_shift, toxic_shift, keep) for each row of ``docs``: evidence, sites, and both.

    sites: (``key``, host, path) of documents whose URL is known; of several the first in order. Other documents have the
    columns ``host`` and ``path``. A row is kept if both probabilities are under the threshold. Null and empty texts have
    only the evidence of being empty; a path without labelled rows has its host's posterior, a host without any the
    global one (shift 0); without labels all probabilities are low and all rows stay. Repeated rows are judged each, and
    rows with a null key as any other. Extra columns are not read.
    """
    host, path = (F.col(c) if isinstance(c, str) else c for c in (host, path))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    model = fit(rows, labels.withColumnRenamed(key, "id"), "id", "text")
    scored = _placed(_evidence(rows, model, ["host", "path"]), sites, key)
    outcomes = _marked(_placed(rows.select("id", "host", "path"), sites, key), labels, key, text)
    paths, hosts, priors = _sites(outcomes)
    marks = _marks(labels, key).select("i", *[F.col(t).alias(f"own_{t}") for t in TARGETS])
    scored = _with_sites(scored, paths, hosts).join(marks, F.col("id") == F.col("i"), "left").drop("i")
    for t in TARGETS:
        scored = scored.withColumn(f"{t}_shift", _shift(t, priors[t], F.col(f"own_{t}")))
        scored = scored.withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.col(f"{t}_logit") + F.col(f"{t}_shift")))))
    keep = (F.col("p_bad") < threshold) & (F.col("p_toxic") < threshold)
    return scored.select(F.col("id").alias(key), "p_bad", "p_toxic", "bad_logit", "toxic_logit", "bad_shift", "toxic_shift", keep.alias("keep"))


def _placed(rows: DataFrame, sites: DataFrame | None, key: str) -> DataFrame:
    """``rows`` (id, host, path, ...) with the host and path of ``sites`` where it has the row's id."""
    if sites is None:
        return rows
    first = sites.where(F.col(key).isNotNull() & F.col("host").isNotNull()).groupBy(F.col(key).cast("long").alias("i")).agg(F.min(F.struct("host", "path")).alias("site"))
    rows = rows.join(first, F.col("id") == F.col("i"), "left").drop("i")
    place = lambda c: F.when(F.col("site").isNotNull(), F.col(f"site.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(*[place(c) if c in ("host", "path") else c for c in rows.columns if c != "site"])


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that aren't rejected; a key that repeats goes if one of its rows is rejected, null keys stay."""
    gone = judge(docs, labels, key, **options).where("not keep").select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, F.col(key) == F.col("_gone"), "left_anti")
