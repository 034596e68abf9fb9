"""Normalisers of free text, as Column functions. They differ on purpose: each serves one kind of match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers trim it: beyond \s, no-break space and the byte order mark.
WS = r"[\s ﻿]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeezed(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def _lowered(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("&"), F.lit(" and "))


def plain(c: Column) -> Column:
    """Brand and category names: a-z and 0-9 only."""
    return F.trim(F.regexp_replace(_lowered(c), "[^a-z0-9]+", " "))


def compact(c: Column) -> Column:
    return F.replace(plain(c), F.lit(" "), F.lit(""))


def requirement(c: Column) -> Column:
    """Requirement text: keeps $ . " ' and -."""
    return squeezed(F.regexp_replace(_lowered(c), r"""[^a-z0-9$."'-]+""", " "))


def feature_text(c: Column) -> Column:
    """Labels of selectable features: keeps . $ " and -."""
    return squeezed(F.regexp_replace(_lowered(c), r'[^a-z0-9.$"-]+', " "))


def meaning(c: Column) -> Column:
    """Evidence text: straight quotes, units as ``ft`` and ``in``, no hyphens."""
    c = F.translate(F.lower(c), "‘’“”", "''\"\"")
    c = F.replace(c, F.lit("&"), F.lit(" and "))
    c = F.regexp_replace(c, r"(\d)\s*(?:feet|foot|ft\.)\b", "$1 ft")
    c = F.regexp_replace(c, r"(\d)\s*(?:inches|inch|in\.)\b", "$1 in")
    c = F.regexp_replace(c, r"\bk[\s-]?cup\b", "k cup")
    c = F.regexp_replace(c, "[-_/]+", " ")
    return squeezed(F.regexp_replace(c, r"""[^a-z0-9$.'"\s]+""", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(feature_text(c), r"\s+", "-")


def title_case(c: Column) -> Column:
    return F.initcap(squeezed(c))


def singular(c: Column) -> Column:
    """One word: -ies to -y, -sses to -ss, longer words lose -s."""
    return (
        F.when(F.endswith(c, F.lit("ies")), F.regexp_replace(c, "ies$", "y")).when(c.rlike("sses$"), F.regexp_replace(c, "es$", ""))
        .when((F.length(c) > 3) & F.endswith(c, F.lit("s")), F.regexp_replace(c, "s$", "")).otherwise(c)
    )


def tokens(c: Column) -> Column:
    return F.transform(F.filter(F.split(meaning(c), " "), lambda w: w != ""), singular)


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whether ``meaning`` text holds a phrase at word boundaries."""
    escaped = "".join(x if x.isalnum() or x == " " else "\\" + x for x in phrase).replace(" ", r"\s+")
    return text.rlike(rf"(^|[^a-z0-9]){escaped}([^a-z0-9]|$)")


def js_round(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5)


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
