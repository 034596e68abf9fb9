"""URLs and searches: what may be shown, what isn't a product's page, when two links are one page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dictionaries as D
from .text import strip


def host(url: Column) -> Column:
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(full, F.lit("HOST")), url)), r"^www\.", "")


def safe_product_link(url: Column) -> Column:
    """https, a dotted public host that is no address, no credentials, port 443, 2,000 characters, no blank or control."""
    h = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.$", "")
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    good = (
        (F.length(url) <= 2000) & ~url.rlike(r"[\x00-\x20\x7f]") & url.rlike("(?i)^https://") & F.contains(h, F.lit(".")) & ~F.contains(authority, F.lit("@")) & ~authority.rlike(r":(?!443$)\d+$")
        & ~h.rlike(r"(?:^|\.)(?:0x[0-9a-f]*|\d+)$") & ~F.startswith(h, F.lit("[")) & ~h.rlike(r"(?:^|\.)(?:localhost|local|internal|test|invalid)$")
    )
    return F.coalesce(good, F.lit(False))


def non_product_source(url: Column) -> Column:
    """Review and discussion sites (or subdomains), hosts with a support label, paths with a support word."""
    h = host(url)
    labels = F.split(h, r"\.")
    # all suffixes of the host: membership instead of a test per domain
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    site = F.arrays_overlap(suffixes, F.array(*[F.lit(d) for d in D.NON_PRODUCT_DOMAINS])) | F.arrays_overlap(labels, F.array(*[F.lit(x) for x in D.NON_PRODUCT_LABELS]))
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    path = F.filter(F.split(F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit("")), "/"), lambda s: s != "")
    return F.coalesce(site | F.exists(path, lambda s: s.rlike(D.NON_PRODUCT_PATH)), F.lit(False))


def page_key(url: Column) -> Column:
    """A link without fragment and tracking parameters, parameters in order: equal for one page."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_|srsltid(?:=|$)|gclid(?:=|$))")))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def search_error(query: Column) -> Column:
    """empty, vague, or null where a search can run."""
    q = strip(F.coalesce(query, F.lit("")))
    words = F.filter(F.transform(F.split(F.lower(q), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9-]", "")), lambda w: w != "")
    vague = (F.length(q) < 3) | (F.size(words) == 0) | F.forall(words, lambda w: w.isin(*D.VAGUE_WORDS))
    return F.when(q == "", "empty").when(vague, "vague")
