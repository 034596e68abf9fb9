"""URL filters: given rules, and elsewhere empirical-Bayes reputation of hosts.

Labelled page outcomes are counted per host, registered domain and suffix. A suffix's rate is shrunk toward the global
rate, a domain's toward its suffix's, a host's toward its domain's, each by a beta-binomial prior whose strength is
estimated from how much the rates of that level differ (method of moments). A page without a rule is blocked if the
lower bound of its host's posterior is over the threshold; a host without outcomes has the posterior of its domain,
else of its suffix, else the global one, as a host of no outcomes beneath it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .public_suffixes import SUFFIXES
from .storage import stash

#: Bounds of a prior's strength, in outcomes.
WEAKEST, STRONGEST = 2.0, 200.0
#: Standard deviations from the posterior's mean to its lower bound, and the bound from which pages are blocked.
Z, THRESHOLD = 1.64, 0.5
#: Labels that make a public suffix of two together with a country's label of two letters after them. (Fixed values.)
SECOND_LEVELS = ("ac", "co", "com", "edu", "gob", "gov", "go", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first ``://`` up to / ? # or the end, A-Z lower-cased; none, or null: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct of rule and verdict; else null. Rules are folded into the expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(begin))
        out = F.when(fits, F.struct(F.lit(at + begin).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class SuffixRules(NamedTuple):
    """Rules by their number of labels: plain ones, wildcards (by what follows the star) and exceptions."""

    plain: dict[int, list[str]]
    wild: dict[int, list[str]]
    excepted: dict[int, list[str]]

    @classmethod
    def of(cls, rules: Iterable[str]) -> SuffixRules:
        out = cls({}, {}, {})
        for r in rules:
            kind, name = (out.wild, r[2:]) if r.startswith("*.") else (out.excepted, r[1:]) if r.startswith("!") else (out.plain, r)
            kind.setdefault(name.count(".") + 1, []).append(name)
        return out

    def lengths(self) -> list[int]:
        """Numbers of labels that a suffix by these rules may have, the most first."""
        return sorted({*self.plain, *(k + 1 for k in self.wild)}, reverse=True)


def levels(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, its user and port left out. An IP address is both on its own.

    A suffix is the longest of the public suffix rules (SUFFIXES and ``suffixes``, wildcards and exceptions included) that
    ends the host, else two labels by the rule of SECOND_LEVELS, else the last label. A name among ``suffixes`` is no
    exception. The domain has one label more.
    """
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    labels, size = F.split(host, r"\."), F.size(F.split(host, r"\."))
    ending = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), size - k + 1), size), ".")
    is_one = lambda k, names: (size >= k) & ending(k).isin(*names)
    rules = SuffixRules.of([r for r in SUFFIXES if r.removeprefix("!") not in suffixes] + list(suffixes))
    n = F.when(F.lit(False), 0)
    for k, names in sorted(rules.excepted.items(), reverse=True):
        n = n.when(is_one(k, names), k - 1)
    for k in rules.lengths():
        n = n.when(is_one(k, rules.plain[k]), k) if k in rules.plain else n
        n = n.when((size >= k) & is_one(k - 1, rules.wild[k - 1]), k) if k - 1 in rules.wild else n
    long = (size > 1) & F.get(labels, size - 1).rlike("^[a-z]{2}$") & F.get(labels, size - 2).isin(*SECOND_LEVELS)
    n = n.when(long, 2).otherwise(1)
    address = host.rlike(r"^(\d+\.){3}\d+$|^\[")
    return F.when(address, host).otherwise(ending(n + 1)), F.when(address, host).otherwise(ending(n))


def strength(rows: DataFrame, parent: str) -> DataFrame:
    """One row, the prior strength of a level (n, bad, and the parent's rate per row), by the method of moments.

    The rates' spread around their parents, less what chance alone gives, is the variance of a beta distribution.
    """
    p = F.col(parent)
    chance, spread = F.sum(p * (1 - p)), F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2))
    # E[sum n (rate - p)^2] = sum p(1-p) (1 + (n - 1) / (strength + 1))
    more = F.sum(p * (1 - p) * (F.col("n") - 1))
    found = F.when(spread > chance, more / (spread - chance) - 1).otherwise(F.lit(STRONGEST))
    return rows.where("n > 0").agg(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.coalesce(found, F.lit(STRONGEST)))).alias("k"))


def _bound(mean: str, *weights: Column) -> Column:
    """Lower bound of a rate. Weights, in outcomes: of what is known of the level seen, and of the priors of the levels beneath it."""
    m, known = F.col(mean), F.lit(1.0)
    for w in weights:  # E[p (1 - p)] shrinks by as much at each level; the rest is the rate's variance
        known = known * (1 - 1 / (w + 1))
    return m - Z * F.sqrt(m * (1 - m) * (1 - known))


def _posteriors(outcomes: DataFrame, suffixes: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame, tuple | None]:
    """Hosts (host, domain, suffix, n, bad, mean, known), domains (domain, suffix, p2, p2_n), suffixes (suffix, p1, p1_n), and (p0, p0_n, the strengths of the priors of suffixes, domains and hosts), or None without outcomes.

    Counts are added up from hosts to domains to suffixes, so that a hot host costs no more than others. What goes
    to the driver are one-row sums.
    """
    domain, suffix = levels(F.col("host"), suffixes)
    added = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    hosts = stash(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"))
    domains = stash(hosts.groupBy("domain", "suffix").agg(*added))
    endings = stash(domains.groupBy("suffix").agg(*added))
    total = endings.agg(*added).first()
    p0, p0_n = ((total["bad"] + 0.5) / (total["n"] + 1), float(total["n"] + 1)) if total["n"] else (0.5, 1.0)

    def shrunk(rows: DataFrame, parent: str, name: str) -> tuple[DataFrame, float]:
        k = strength(rows, parent).first()["k"]
        return rows.withColumn(name, (F.col("bad") + k * F.col(parent)) / (F.col("n") + k)).withColumn(f"{name}_n", F.col("n") + k), k

    endings, k0 = shrunk(endings.withColumn("p0", F.lit(p0)), "p0", "p1")
    domains, k1 = shrunk(domains.join(endings.select("suffix", "p1"), "suffix"), "p1", "p2")
    hosts, k2 = shrunk(hosts.join(domains.select("domain", "suffix", "p2"), ["domain", "suffix"]), "p2", "mean")
    hosts = hosts.select("host", "domain", "suffix", "n", "bad", "mean", F.col("mean_n").alias("known"))
    return hosts, domains.select("domain", "suffix", "p2", "p2_n"), endings.select("suffix", "p1", "p1_n"), (p0, p0_n, k0, k1, k2) if total["n"] else None


def reputation(outcomes: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """(host, domain, suffix, n, bad, mean, bound) from labelled outcomes (host, bad 0/1): one row per host with an outcome."""
    return _posteriors(outcomes, suffixes)[0].withColumn("bound", _bound("mean", F.col("known"))).drop("known")


def reputation_of(hosts: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """(host, mean, bound) for each distinct host of ``hosts``: by its own outcomes, else by its domain's, suffix's or all outcomes.

    A host without outcomes has the mean of the lowest level that has some; its bound allows for how much the levels
    beneath that one differ. Empty and null hosts, which are no sites, have no row; without any outcome there are nulls.
    """
    seen, domains, endings, total = _posteriors(outcomes, suffixes)
    asked, none = hosts.where("host <> ''").select("host").distinct(), F.lit(None).cast("double")
    if total is None:
        return asked.select("host", none.alias("mean"), none.alias("bound"))
    p0, p0_n, k0, k1, k2 = total
    domain, suffix = levels(F.col("host"), suffixes)
    asked = stash(asked.select("host", domain.alias("domain"), suffix.alias("suffix")))
    asked = asked.join(stash(seen.select("host", "known", F.col("mean").alias("own"))), "host", "left").join(stash(domains), ["domain", "suffix"], "left").join(stash(endings), "suffix", "left")
    asked = asked.withColumn("mean", F.coalesce("own", "p2", "p1", F.lit(p0)))
    k0, k1, k2 = (F.lit(k) for k in (k0, k1, k2))
    bound = F.when(F.col("own").isNotNull(), _bound("mean", F.col("known"))).when(F.col("p2").isNotNull(), _bound("mean", F.col("p2_n"), k2))
    bound = bound.when(F.col("p1").isNotNull(), _bound("mean", F.col("p1_n"), k1, k2)).otherwise(_bound("mean", F.lit(p0_n), k0, k1, k2))
    return asked.select("host", "mean", bound.alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (), key: str = "page_id", url: str = "url", suffixes: Sequence[str] = ()) -> DataFrame:
    """(``key``, host, path, rule, verdict, bad_rate) for each row of ``pages``.

    outcomes: (host, bad). Hosts without an outcome of their own are judged by their domain's, their suffix's or all
    outcomes; without any outcome, bad_rate is null and pages are allowed, as are null urls and urls without ``://``
    (host and path empty) unless a rule fits. Rows that repeat a key are judged each. suffixes: public suffixes beyond the
    rule of ``levels``. Other columns are not read.
    """
    rows = pages.select(F.col(key).cast("long").alias("id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    seen = reputation_of(rows, outcomes.where("host is not null and bad is not null"), suffixes).withColumnRenamed("host", "h")
    rows = rows.join(seen, F.col("host") == F.col("h"), "left").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") >= THRESHOLD, "block").otherwise("allow")
    return rows.select(F.col("id").alias(key), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), F.round("mean", 9).alias("bad_rate"))
