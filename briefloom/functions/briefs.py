"""What a brief says beside specifications: budget, sizes, brands, colours, materials, category, bed size."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dictionaries as D
from .brands import known_brands
from .categories import base_category
from .text import bound, js_round, meaning, plain, requirement, strip

__all__ = ["base_group", "bed_size", "budget_rule", "category_group", "inline_amount", "known_brands", "money_amount", "named_values", "premium_cap", "range_max", "selected_sizes", "size_array", "size_constraints"]

# Amounts, and units that make an amount no price.
_AMOUNT = r"([\d,]+(?:\.\d+)?)"
_UNITS = r'inches|inch|in\.?|"|feet|foot|ft\.?|pounds?|lbs?|lb\.?|ounces?|oz\.?|kilograms?|kg|grams?|g|centimeters?|cm|millimeters?|mm|hours?|hrs?|minutes?|mins?|cfm|psi|watts?|w|mah|gb|tb|hz'


def _money(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def money_amount(text: Column) -> Column:
    """The first number."""
    return _money(F.regexp_extract(text, rf"\$?\s*{_AMOUNT}", 1))


def _upper_end(pattern: str):
    return lambda whole: F.greatest(*[_money(F.regexp_extract(whole, pattern, i)) for i in (2, 3)])


def range_max(text: Column, dollar: bool) -> Column:
    """Upper end of the first price range; ``dollar``: only ranges that show a $. Ranges of inches are none."""
    tail = r'(?!\s*(?:inches|inch|in\.?|")\b)'
    found = []
    for lead, joint in ((r"\bbetween\s*", r"(?:and|to|-|–)"), ("", r"(?:-|–|to)")):
        pattern = rf"(?i)({lead}\$?\s*{_AMOUNT}\s*{joint}\s*\$?\s*{_AMOUNT}\b){tail}"
        rows = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda w: F.contains(w, F.lit("$")) if dollar else F.lit(True))
        found.append(F.get(F.filter(F.transform(rows, _upper_end(pattern)), lambda v: v.isNotNull()), F.lit(0)))
    return F.coalesce(*found)


def inline_amount(text: Column) -> Column:
    """An amount after under, at most and the like, unless a unit follows."""
    t = requirement(text)
    lead = rf"(?i)\b(?:under|less than|below|no more than|at most|max|maximum)\s*\$?\s*{_AMOUNT}\b"
    after = F.regexp_extract(t, rf"{lead}(.*)$", 2)
    return F.when(~after.rlike(rf"(?i)^\s*(?:{_UNITS})\b"), _money(F.regexp_extract(t, lead, 1)))


def budget_rule(budget: Column, priorities: Column, query: Column) -> Column:
    """Struct (amount, flexible, operator, label, premium_cap); null without a budget. A range beats an amount, the budget field other fields."""
    amount = F.coalesce(range_max(budget, False), range_max(priorities, True), range_max(query, True), money_amount(budget), inline_amount(priorities), inline_amount(query))
    said = F.coalesce(F.nullif(budget, F.lit("")), F.nullif(priorities, F.lit("")), query, F.lit(""))

    def of(x: Column) -> Column:
        text, amount = x["text"], x["amount"]
        flexible = text.rlike(r"\b(?:about|around|flexible|roughly|target)\b")
        firm = text.rlike(r"\b(?:under|less than|below|no more than|at most|max|maximum)\b") | ~flexible
        shown = F.regexp_replace(amount.cast("string"), r"\.0$", "")
        label = F.when(firm, F.concat(F.lit("Budget: $"), shown, F.lit(" or less"))).otherwise(F.concat(F.lit("Budget target: $"), shown))
        cap = premium_cap(amount, category_group(F.coalesce(query, F.lit(""))))
        rule = F.struct(amount.alias("amount"), flexible.alias("flexible"), F.when(firm, "max").otherwise("target").alias("operator"), label.alias("label"), cap.cast("double").alias("premium_cap"))
        none = F.lit(None).cast("double")
        unknown = F.struct(none.alias("amount"), F.lit(True).alias("flexible"), F.lit("unknown").alias("operator"), strip(budget).alias("label"), none.alias("premium_cap"))
        return F.when(amount.isNotNull(), rule).when(strip(budget) != "", unknown)

    return bound(F.struct(requirement(said).alias("text"), amount.alias("amount")), of)


def category_group(category: Column) -> Column:
    """The first group one of whose terms the text contains, what ``base_category`` leaves out aside; else general."""
    return base_group(base_category(category))


def base_group(base: Column) -> Column:
    """The same of a text that ``base_category`` has made."""

    def of(text: Column) -> Column:
        out = F.lit("general")
        for group, terms in reversed(D.CATEGORIES):
            out = F.when(reduce(or_, [F.contains(text, F.lit(t)) for t in terms]), group).otherwise(out)
        return out

    # the text is made once, not once per term
    return bound(plain(base), of)


def premium_cap(amount: Column, group: Column) -> Column:
    """What a premium pick may cost: the lesser of budget times multiplier and budget plus allowance."""
    look = lambda d, other, g: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, float(v))]), g), F.lit(other))
    return bound(group, lambda g: js_round(F.least(amount * look(D.PREMIUM_MULTIPLIER, 2.0, g), amount + look(D.PREMIUM_ALLOWANCE, 500.0, g))))


def bed_size(text: Column, need_context: bool = True) -> Column:
    """The most specific bed size named; null where nothing says that it is a bed's."""
    padded, out = F.concat(F.lit(" "), F.lower(text), F.lit(" ")), F.lit(None).cast("string")
    for size, aliases in reversed(D.BED_SIZES):
        pattern = "|".join(a.replace(" ", r"\s+") for a in aliases)
        out = F.when(padded.rlike(rf"(^|\W)(?:{pattern})(\W|$)"), size).otherwise(out)
    return F.when(text.rlike(f"(?i){D.BED_CONTEXT}"), out) if need_context else out


def named_values(text: Column, values: tuple[str, ...], longest: bool = False) -> Column:
    """Values named at word boundaries, in order; ``longest`` drops those inside another that is named.

    The values are one literal array; a pattern is made only of a value that the text holds.
    """
    listed = F.split(F.lit("\n".join(values)), "\n")
    at_words = lambda t, v: F.rlike(t, F.concat(F.lit(r"(^|[^a-z0-9])\Q"), v, F.lit(r"\E([^a-z0-9]|$)")))
    found = bound(meaning(text), lambda t: F.filter(listed, lambda v: F.contains(t, v) & at_words(t, v)))
    if not longest:
        return found
    return bound(found, lambda all_: F.filter(all_, lambda v: ~F.exists(all_, lambda o: (F.length(o) > F.length(v)) & F.contains(o, v))))


_DIMENSIONS = "(width|wide|depth|deep|height|high|tall|length|long)"
_MAX = "(?:under|less than|below|no bigger than|no larger than|no deeper than|no taller than|at most|max|maximum)"
_MIN = "(?:at least|min|minimum)"
_INCH, _FOOT, _N = r'(?:inches|inch|in\.?|")', r"(?:feet|foot|ft\.?)", r"(\d+(?:\.\d+)?)"

# Fixed values: (pattern, group of the amount, group of the dimension or 0, default dimension, operator, unit, plain label), in order.
SIZE_PATTERNS = (
    (rf"\b{_MAX}\s*{_N}\s*{_INCH}\s*(?:{_DIMENSIONS})?\b", 1, 2, "width", "max", "in", False),
    (rf"\b{_MIN}\s*{_N}\s*{_INCH}\s*(?:{_DIMENSIONS})?\b", 1, 2, "width", "min", "in", False),
    (rf"\b{_DIMENSIONS}\s*(?:{_MAX})?\s*{_N}\s*{_INCH}\b", 2, 1, "width", "max", "in", False),
    (rf"\b{_MAX}\s*{_N}\s*[-\s]*{_FOOT}\s*(?:length|long)?\b", 1, 0, "length", "max", "ft", False),
    (rf"\b{_MIN}\s*{_N}\s*[-\s]*{_FOOT}\s*(?:length|long)?\b", 1, 0, "length", "min", "ft", False),
    (rf"\b(?:length|long)\s*(?:{_MIN})?\s*{_N}\s*[-\s]*{_FOOT}\b", 1, 0, "length", "min", "ft", True),
    (rf"\b{_N}\s*[-\s]*{_FOOT}\b", 1, 0, "length", "min", "ft", True),
)


def _size_of(dimension: int, default: str, operator: str, unit: str, short: bool):
    """Struct of one match (v: amount, d: word of the dimension)."""

    def one(x: Column) -> Column:
        word = F.lower(x["d"]) if dimension else F.lit("")
        kind = F.when(word.isin("depth", "deep"), "depth").when(word.isin("height", "high", "tall"), "height").when(word.isin("width", "wide"), "width").when(word.isin("length", "long"), "length").otherwise(default)
        value = x["v"].cast("double")
        shown = F.concat(F.regexp_replace(value.cast("string"), r"\.0$", ""), F.lit(" ft" if unit == "ft" else " inches"))
        limit = F.lit(": under " if operator == "max" else ": at least ")
        label = F.concat(F.initcap(kind), F.when(F.lit(short) & (kind == "length"), F.lit(": ")).otherwise(limit), shown)
        return F.struct(kind.alias("dimension"), F.lit(operator).alias("operator"), F.lit(unit).alias("unit"), value.alias("value"), label.alias("label"))

    return one


def size_array(text: Column, strict: bool = False) -> Column:
    """Structs (dimension, operator, unit, value, label) of the sizes that a text asks for, as ``size_constraints`` gives them."""
    arrays = []
    for pattern, amount, dimension, default, operator, unit, short in SIZE_PATTERNS:
        lead = r"(?<!\b(?:sq|square|cu|cubic)\s{0,4})" if unit == "ft" else ""
        full = F.lit(rf"(?i){lead}{pattern}")
        values = F.regexp_extract_all(text, full, F.lit(amount))
        named = F.regexp_extract_all(text, full, F.lit(dimension or 1))
        arrays.append(F.transform(F.arrays_zip(values.alias("v"), named.alias("d")), _size_of(dimension, default, operator, unit, short)))
    found = F.filter(F.concat(*arrays), lambda x: x["value"] > 0)
    if strict:
        twice = lambda x, all_: (x["operator"] == "min") & F.exists(all_, lambda y: (y["operator"] == "max") & (y["value"] == x["value"]) & (y["unit"] == x["unit"]))
        found = bound(found, lambda all_: F.filter(all_, lambda x: ~twice(x, all_)))
    return bound(found, lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda x: x["label"])), lambda k: F.get(F.filter(all_, lambda x: x["label"] == k), F.lit(0))))


def selected_sizes(f: Column) -> Column:
    """The same structs for a selected feature (``requests.selected_feature``): its name gives the dimension, its operator the bounds.

    A range is a minimum and a maximum; an exact value counts for lengths alone, as a minimum.
    """
    span = r"^(-?\d+(?:\.\d+)?)-(-?\d+(?:\.\d+)?)$"

    # step by step, so that no step's expression is repeated inside the next one's
    def said_of(f: Column) -> Column:
        clean = strip(F.regexp_replace(f["name"], r"(?i)\s*[:=-]?\s*\d+(?:\.\d+)?\s*(?:feet|foot|ft\.?|inches|inch|in\.?)\b", ""))
        return F.struct(f.alias("f"), requirement(f["name"]).alias("said"), clean.alias("clean"), requirement(F.coalesce(f["unit"], F.lit(""))).alias("unit"))

    def read(x: Column) -> Column:
        f = x["f"]
        held = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x["said"], w))
        dimension = F.when(held("depth"), "depth").when(held("height"), "height").when(held("length", "long"), "length").when(held("width", "size"), "width")
        unit = F.when(F.contains(x["unit"], F.lit("ft")), "ft").otherwise("in")
        amount = F.regexp_extract(F.replace(f["value"], F.lit(","), F.lit("")), r"\d+(?:\.\d+)?", 0).try_cast("double")
        low, high = (F.regexp_extract(f["value"], span, i).try_cast("double") for i in (1, 2))
        fields = {"operator": f["operator"], "dimension": dimension, "unit": unit, "name": F.when(x["clean"] == "", f["name"]).otherwise(x["clean"]), "amount": amount, "low": low, "high": high}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    def sizes(y: Column) -> Column:
        def one(word: str, operator: str, value: Column) -> Column:
            label = F.concat(y["name"], F.lit(f": {word}"), F.regexp_replace(value.cast("string"), r"\.0$", ""), F.lit(" "), y["unit"])
            return F.struct(y["dimension"].alias("dimension"), F.lit(operator).alias("operator"), y["unit"].alias("unit"), value.alias("value"), label.alias("label"))

        dimension, operator, amount, low, high = (y[c] for c in ("dimension", "operator", "amount", "low", "high"))
        none = F.filter(F.array(one("", "", F.lit(0.0))), lambda x: F.lit(False))
        return (
            F.when(dimension.isNull() | ((operator == "equals") & (dimension != "length")), none).when((operator == "between") & low.isNotNull() & high.isNotNull(), F.array(one("at least ", "min", low), one("under ", "max", high)))
            .when(amount.isNull() | ~operator.isin("lte", "gte", "between", "equals"), none).when(operator == "lte", F.array(one("under ", "max", amount))).when(operator == "equals", F.array(one("", "min", amount))).otherwise(F.array(one("at least ", "min", amount)))
        )

    return bound(bound(bound(f, said_of), read), sizes)


def size_constraints(rows: DataFrame, text: str, strict: bool = False) -> DataFrame:
    """Adds ord, dimension, operator, unit, value, label: a row per size that a text asks for.

    Distinct by label, in order of patterns. Where an upper bound in feet or a dimension before its bound is named,
    general patterns also fire (``under 50 ft`` is a maximum and a minimum); ``strict`` leaves those second readings out.
    """
    once = size_array(F.col(text), strict)
    return rows.select("*", F.posexplode(once).alias("ord", "_s")).select(*rows.columns, "ord", "_s.dimension", "_s.operator", "_s.unit", "_s.value", "_s.label")
