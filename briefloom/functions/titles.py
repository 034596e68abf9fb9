"""Product titles: compatibility forms of text, and whether a listing's title is the recommended model."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Words of accessories, of variants, words that name no model, and units after a number.
ACCESSORIES = "replacement compatible accessory accessories bundle combo kit case cover charger battery filter carafe lid mount stand attachment adapter spare repair sleeve protector strap cable bag refill".split()
VARIANTS = "pro max plus mini ultra lite se xl xs ii iii iv gen generation mk mark deluxe elite signature select touch premium classic essential".split()
GENERIC = "the and with for a an by new product coffee maker brewer machine wireless headphones monitor vacuum cleaner chair electric cordless inch cup cups".split()
UNITS = "cup cups inch in cm mm oz ml qt w watts v volt hz gb tb".split()

#: Words of a title or a name that may be written as one model code.
_JOINED = 3


@functools.cache
def _folds() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII: it is one such character; one, with marks from U+0300 to U+036F; anything else."""
    one, marked, other = {}, {}, {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1))):
        form = unicodedata.normalize("NFKD", c)
        if form.isascii() and len(form) == 1:
            one[c] = form
        elif re.fullmatch(r"[\x00-\x7f][\u0300-\u036f]+", form):
            marked[c] = form[0]
        elif re.search(r"[\x00-\x7f]", form):
            other[c] = form
    return one, marked, other


def folded(c: Column) -> Column:
    """Unicode's compatibility decomposition of what it makes ASCII of. Other characters stand as they are, each with a mark (U+0301) after it, as those have that it parts from letters.

    Spark has no function for it. A Python function would hide from joins after it how rows are dealt, and they would be shuffled again.
    """
    one, marked, other = _folds()
    replaced = lambda x, forms: F.translate(x, "".join(forms), "".join(forms.values()))
    # one literal: planning a map of a thousand takes seconds
    spelt = F.str_to_map(F.lit("\n".join(f"{a}\t{b}" for a, b in other.items())), F.lit("\n"), F.lit("\t"))
    each = F.transform(F.split(c, ""), lambda x: F.when(x <= "\x7f", x).otherwise(F.coalesce(spelt[x], x)))
    # translate looks characters up; a regular expression tries those of a class one by one
    some = replaced(c, dict.fromkeys(other, "\0")) != c
    parted = F.regexp_replace(replaced(F.when(some, F.array_join(each, "")).otherwise(c), one), r"([^\x00-\x7f])", "$1\u0301")
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(replaced(parted, marked))


def evaluated(c: Column) -> Column:
    """Names as evaluations compare them. Accents split words, and a trade mark sign becomes letters."""
    return F.trim(F.regexp_replace(F.lower(folded(c)), "[^a-z0-9]+", " "))


def title_tokens(c: Column) -> Column:
    """Words of a title: no accents or apostrophes; hyphens and dots inside a word are left out."""
    plain = F.when(F.length(c) == F.octet_length(c), c).otherwise(F.regexp_replace(folded(c), r"[̀-ͯ]", ""))
    for apostrophe in "'’":
        plain = F.replace(plain, F.lit(apostrophe), F.lit(""))
    return F.transform(F.regexp_extract_all(F.lower(plain), F.lit("[a-z0-9]+(?:[-.][a-z0-9]+)*"), F.lit(0)), lambda t: F.translate(t, "-.", ""))


def _runs(words: Column) -> Column:
    """At each word an array of it alone, with the next one, and with the next two as one word; null beyond the end."""

    def run(word: Column, i: Column) -> Column:
        runs = [word]
        for k in range(1, _JOINED):
            runs.append(F.concat(runs[-1], F.get(words, i + k)))
        return F.array(*runs)

    return F.transform(words, run)


def model_places(expected: Column, actual: Column) -> Column:
    """Numbers, from 0, of the words of ``actual`` that the expected words take, each the first place that it can; null if one finds none.

    Only codes of letters and digits may be joined or split: wh-1000 xm5, wh1000xm5. Every expression is Spark's: words
    need not be copied to Python and back.
    """
    spans, asked = F.flatten(_runs(actual)), F.transform(_runs(expected), lambda words, i: F.struct(i.alias("i"), words.alias("words")))

    def step(s: Column, x: Column, spans: Column) -> Column:
        def found(k: int) -> Column:
            word = F.get(x["words"], F.lit(k))
            # of words that are no codes only single ones, which are each third span
            alone = F.array_position(actual, word) * _JOINED - (_JOINED - 1) if k == 0 else F.lit(0)
            place = F.when(word.rlike("[a-z]") & word.rlike("[0-9]"), F.array_position(spans, word)).otherwise(alone).cast("int") - 1

            def taking(p: Column) -> Column:
                first = F.floor(p / _JOINED).cast("int")
                return F.when(p >= 0, F.struct((x["i"] + k + 1).alias("next"), F.concat(s["taken"], F.sequence(first, first + p % _JOINED)).alias("taken")))

            return bound(place, taking)

        lost = F.struct(F.lit(-1).alias("next"), s["taken"].alias("taken"))
        return F.when(s["next"] != x["i"], s).otherwise(F.coalesce(*[found(k) for k in range(_JOINED)], lost))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("taken"))
    done = lambda s: F.when(s["next"] == F.size(expected), s["taken"])
    return bound(spans, lambda spans: F.aggregate(asked, start, lambda s, x: step(s, x, spans), done))


def _same_item(expected: Column, actual: Column) -> Column:
    array = lambda words: F.array(*[F.lit(w) for w in words])
    identity = F.filter(expected, lambda t: ~t.isin(*GENERIC))
    extra = F.arrays_overlap(F.array_except(actual, expected), array(ACCESSORIES + VARIANTS))

    def foreign(taken: Column, word: Column, i: Column) -> Column:
        after = F.coalesce(F.get(actual, i + 1), F.lit(""))
        measure = F.regexp_replace(word, r"^\d+", "").isin(*UNITS) | (word.rlike(r"^\d+$") & after.isin(*UNITS))
        return word.rlike(r"\d") & ~F.array_contains(taken, i) & ~measure

    none_foreign = lambda taken: taken.isNotNull() & (F.size(F.filter(actual, lambda word, i: foreign(taken, word, i))) == 0)
    # no word is expected that the title's letters don't hold in one piece: most other models end here
    held = bound(F.array_join(actual, ""), lambda letters: F.forall(expected, lambda word: F.contains(letters, word)))
    return (F.size(identity) >= 2) & ~extra & held & bound(model_places(expected, actual), none_foreign)


def matches_model(name: Column, title: Column) -> Column:
    """Whether a title is the named model's: two words of identity, all expected words, nothing that makes it another item.

    Other items: accessories, variants, packs, further numbers that are no measure. Null, blank and titles of over 400
    characters match nothing.
    """
    pack = title.rlike(r"(?i)\b(?:pack|set)\s+of\s+\d|\b\d+\s*[- ]?pack\b|\s\+\s") & ~name.rlike(r"(?i)\b(?:pack|set)\b|\s\+\s")
    words = F.struct(title_tokens(name).alias("expected"), title_tokens(title).alias("actual"))
    good = (F.trim(title) != "") & (F.length(title) <= 400) & ~pack & bound(words, lambda w: _same_item(w["expected"], w["actual"]))
    return F.coalesce(good, F.lit(False))
