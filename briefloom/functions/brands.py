"""Brands that a brief names and products show, and labels that name a shop or a source instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dictionaries as D
from .text import bound, compact, plain, strip

_BY_NAME = {n: canonical for canonical, aliases in reversed(D.BRANDS) for n in (canonical, *aliases)}
_DOMAIN = r"(?i)\.(?:com|org|net)\b"


def canonical_brand(value: Column) -> Column:
    """The dictionary's name of a brand, the words "only" and "brand" left out; of an unknown one the text itself."""
    said = F.trim(F.regexp_replace(F.regexp_replace(plain(value), r"\b(?:only|brand)\b", " "), r"\s+", " "))
    names = {" ".join("".join(c if c.isalnum() else " " for c in n.lower()).split()): canonical for n, canonical in _BY_NAME.items()}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, said), strip(value))


def brand_aliases(value: Column) -> Column:
    """All names of a brand: its canonical one, the text itself, and the dictionary's aliases."""
    aliases: dict[str, list[str]] = {}
    for canonical, more in D.BRANDS:
        aliases.setdefault(canonical, []).extend(more)
    listed = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    own = canonical_brand(value)
    return F.filter(F.array_distinct(F.concat(F.array(own, strip(value)), F.coalesce(F.try_element_at(listed, own), F.array().cast("array<string>")))), lambda a: a != "")


def brand_evidence(text: Column, canonical: Column) -> Column:
    """The text that may show a brand: for HP without horsepower."""
    out = text
    for p in D.HORSEPOWER:
        out = F.regexp_replace(out, f"(?i){p}", " ")
    return F.when(canonical == "HP", out).otherwise(text)


def _forms(text: Column) -> Column:
    """Struct of a text's ``plain`` form between spaces and without them."""
    return bound(plain(text), lambda t: F.struct(F.concat(F.lit(" "), t, F.lit(" ")).alias("words"), F.replace(t, F.lit(" "), F.lit("")).alias("tight")))


def _shows(forms: Column, alias: Column) -> Column:
    """Whether a text holds a ``plain`` alias: as words; else, over three letters and not inside one longer word, with spaces left out."""
    whole = F.contains(forms["words"], F.concat(F.lit(" "), alias, F.lit(" ")))
    inside = ~F.contains(alias, F.lit(" ")) & F.exists(F.split(forms["words"], " "), lambda w: (F.length(w) > F.length(alias)) & F.contains(w, alias))
    return (alias != "") & (whole | ((F.length(alias) > 3) & F.contains(forms["tight"], F.replace(alias, F.lit(" "), F.lit(""))) & ~inside))


def _any_shown(text: Column, brand: Column) -> Column:
    return bound(_forms(text), lambda t: F.exists(brand_aliases(brand), lambda a: _shows(t, plain(a))))


def known_brands(text: Column) -> Column:
    """Brands that a text names, in order of the dictionary, which is one literal array: no join, and a short expression."""
    names = [(" ".join("".join(c if c.isalnum() else " " for c in n.lower()).split()), canonical) for canonical, aliases in D.BRANDS for n in dict.fromkeys((canonical, *aliases))]
    column = lambda i: F.split(F.lit("\n".join(n[i] for n in names)), "\n")
    dense = F.split(F.lit("\n".join(n[0].replace(" ", "") for n in names)), "\n")
    listed = F.arrays_zip(column(0).alias("alias"), column(1).alias("brand"), dense.alias("dense"))
    form = lambda t, x: F.when(x["brand"] == "HP", t["hp"]).otherwise(t["plain"])
    # what a text shows, it also holds with spaces left out: one search for most of the dictionary
    shown = lambda t, x: F.contains(form(t, x)["tight"], x["dense"]) & _shows(form(t, x), x["alias"])
    both = F.struct(_forms(text).alias("plain"), _forms(brand_evidence(text, F.lit("HP"))).alias("hp"))
    return bound(both, lambda t: F.array_distinct(F.transform(F.filter(listed, lambda x: shown(t, x)), lambda x: x["brand"])))


def inferred_brand(text: Column) -> Column:
    """The first brand that a text names, else null."""
    return F.get(known_brands(F.coalesce(text, F.lit(""))), F.lit(0))


def shows_brand(text: Column, brand: Column) -> Column:
    """Whether a product text shows a required brand, known or not."""
    return F.coalesce(_any_shown(brand_evidence(F.coalesce(text, F.lit("")), canonical_brand(brand)), brand), F.lit(False))


def brand_is_measure(text: Column, brand: Column) -> Column:
    """Whether HP stands in a text for horsepower alone."""
    text, hp = F.coalesce(text, F.lit("")), canonical_brand(brand) == "HP"
    return F.coalesce(hp & _any_shown(text, brand) & ~_any_shown(brand_evidence(text, canonical_brand(brand)), brand), F.lit(False))


def source_label(value: Column) -> Column:
    """Whether a label names a shop or a source: a domain, one of their names, or a word for a shop at its end."""
    raw = strip(F.coalesce(value, F.lit("")))
    key = compact(F.regexp_replace(F.regexp_replace(raw, r"(?i)^\s*the\s+", ""), _DOMAIN, " "))
    return (raw != "") & (raw.rlike(_DOMAIN) | key.isin(*D.SOURCE_NAMES) | key.rlike("(?:marketplace|retailer|store)$"))


def without_source_label(value: Column) -> Column:
    """A text without up to two leading labels of shops or sources, each followed by a colon."""
    out, pattern = strip(value), r"^([^:]{2,50}):\s*(.+)$"
    for _ in range(2):
        label = F.regexp_extract(out, pattern, 1)
        out = F.when((label != "") & source_label(label), strip(F.regexp_extract(out, pattern, 2))).otherwise(out)
    return out
