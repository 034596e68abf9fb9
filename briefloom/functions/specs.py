"""Numeric and boolean specifications: constraints that a brief imposes, values that a product shows, and how they compare."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dictionaries import EXACT_WORDS, HARD_WORDS, MAX_WORDS, MIN_WORDS, SPECS, Spec
from .text import bound, strip

#: Characters before a value that are searched for words on how it binds.
LOOK_BACK = 28


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def _as_text(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def _readings(specs: Sequence[Spec]) -> list[tuple[Spec, tuple[str, ...]]]:
    """The dictionary as readings, in order: each pattern of a numeric specification; both patterns of a boolean one."""
    return [(s, m) for s in specs for m in ([s.matchers] if s.direction == "boolean" else [(m,) for m in s.matchers])]


def _tried(text: Column, spec: Spec) -> Column:
    """Whether a pattern may match a text in small letters: none is tried without one of its units."""
    return reduce(or_, [F.contains(text, F.lit(n)) for n in spec.needs], F.lit(not spec.needs))


def _sightings(text: Column, specs: Sequence[Spec], source: Column) -> Column:
    """Structs (reading, before, whole, value) of a text: what a reading matches, in order of readings and matches, and the text before it.

    Every pattern is a literal, which Spark compiles once; one from a table would be compiled for each row.
    """
    seen = lambda i, before, whole, value: F.struct(F.lit(i).alias("reading"), before.alias("before"), whole.alias("whole"), value.alias("value"))

    def numeric(i: int, m: str, padded: Column) -> Column:
        # where the matcher holds, a look-behind of one length captures the text before
        around = F.lit(rf"(?is)(?={m})(?<=(.{{{LOOK_BACK}}}))({m})")
        parts = F.arrays_zip(*[F.regexp_extract_all(padded, around, F.lit(g)).alias(name) for name, g in (("before", 2), ("whole", 3), ("value", 4))])
        # the plain matcher passes over a text far faster than the one that looks around
        return F.when(text.rlike(f"(?is){m}"), F.transform(parts, lambda x: seen(i, F.ltrim(x["before"], F.lit("\0")), x["whole"], _number(x["value"]))))

    def boolean(i: int, yes: str, no: str) -> Column:
        """One at most: present or absent, whichever is asked for first; what is avoided is asked for the other way round."""
        avoided = source == "avoid"
        holds = lambda m: text.rlike(f"(?is){m}")
        one = lambda m, value: F.array(seen(i, F.substring(F.regexp_extract(text, f"(?is)^(.*?)({m})", 1), -LOOK_BACK, LOOK_BACK), F.lit(""), value))
        present, absent = one(yes, F.when(avoided, 0.0).otherwise(1.0)), one(no, F.when(avoided, 1.0).otherwise(0.0))
        return F.when(avoided & holds(no), absent).when(holds(yes), present).when(holds(no), absent)

    found = lambda padded: [F.when(_tried(text, s), boolean(i, *m) if s.direction == "boolean" else numeric(i, *m, padded)) for i, (s, m) in enumerate(_readings(specs))]
    # signs before the text stand in for what a look-behind misses at its beginning; they are no part of a word or a space
    return bound(F.concat(F.lit("\0" * LOOK_BACK), text), lambda padded: F.flatten(F.array_compact(F.array(*found(padded)))))


def _constraint(x: Column, specs: Sequence[Spec], source: Column) -> Column:
    """The constraint of a sighting, as the words before it and its own bind it."""
    rows = [{"spec": s.id, "unit": s.unit, "default": {"lower": "max", "exact": "equals"}.get(s.direction, "min"), "kind": "boolean" if s.direction == "boolean" else "numeric"} for s, _ in _readings(specs)]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<spec: string, unit: string, default: string, kind: string>>")

    def bind(y: Column) -> Column:
        x, r, numeric = y["x"], y["r"], y["r"]["kind"] == "numeric"
        told = F.when(numeric, F.regexp_replace(x["before"], rf"(?i)(?:{MIN_WORDS[3:-1]}|{MAX_WORDS[3:-1]})\s+\$[\d,]+", "")).otherwise(x["before"])
        words = lambda before: F.struct(
            (x["whole"].rlike(r"\d\s*\+") | before.rlike(f"(?i){MIN_WORDS}")).alias("more"), before.rlike(f"(?i){MAX_WORDS}").alias("less"), before.rlike(f"(?i){EXACT_WORDS}").alias("exact"), (before.rlike(f"(?i){HARD_WORDS}") | (source == "smart_feature")).alias("hard"),
        )

        def made(w: Column) -> Column:
            operator = F.when(~numeric | w["exact"], "equals").when(w["more"], "min").when(w["less"], "max").otherwise(r["default"])
            hard = w["hard"] | (numeric & (w["more"] | w["less"] | w["exact"]))
            return F.struct(r["spec"].alias("spec"), r["kind"].alias("kind"), operator.alias("operator"), x["value"].alias("value"), r["unit"].alias("unit"), hard.alias("hard"))

        return bound(bound(told, words), made)

    return bound(F.struct(x.alias("x"), F.get(table, x["reading"]).alias("r")), bind)


def spec_array(text: Column, source: str | Column = "query", specs: Sequence[Spec] = SPECS) -> Column:
    """Distinct constraints of a text as structs (spec, kind, operator, value, unit, strictness, source, id, label), in order of the dictionary.

    Constraints with one id (spec, operator, value) are one; hard if any of them is. A null or empty text has none.
    """
    source = F.lit(source) if isinstance(source, str) else source
    read = lambda t: F.transform(F.filter(_sightings(t, specs, source), lambda x: x["value"].isNotNull()), lambda x: _constraint(x, specs, source))
    names = F.create_map(*[F.lit(x) for s in specs for x in (s.id, s.label)])
    key = lambda x: F.struct(x["spec"].alias("spec"), x["operator"].alias("operator"), x["value"].alias("value"))

    def told(c: Column, hard: Column) -> Column:
        shown, unit, label, number = _as_text(c["value"]), F.coalesce(F.concat(F.lit(" "), c["unit"]), F.lit("")), F.element_at(names, c["spec"]), c["kind"] == "numeric"
        numeric = F.concat(label, F.when(c["operator"] == "min", ": at least ").when(c["operator"] == "max", ": at most ").otherwise(": "), shown, unit)
        boolean = F.when(c["value"] == 1, label).otherwise(F.concat(F.lit("Not "), F.lower(label)))
        own = F.concat(F.lit("spec-"), c["spec"], F.lit("-"), F.when(number, c["operator"]).otherwise("bool"), F.lit("-"), shown)
        fields = {n: c[n] for n in ("spec", "kind", "operator", "value", "unit")} | {"strictness": F.when(hard, "hard").otherwise("soft"), "source": source, "id": own, "label": F.when(number, numeric).otherwise(boolean)}
        return F.struct(*[v.alias(n) for n, v in fields.items()])

    found = bound(F.lower(strip(F.coalesce(text, F.lit("")))), read)
    once = lambda all_: F.transform(F.array_distinct(F.transform(all_, key)), lambda k: bound(F.filter(all_, lambda x: key(x) == k), lambda same: told(same[0], F.exists(same, lambda x: x["hard"]))))
    return bound(found, once)


def spec_constraints(rows: DataFrame, text: str, source: str = "query", specs: Sequence[Spec] = SPECS) -> DataFrame:
    """``spec_array`` as rows: adds ord and the fields of the constraint, one row each."""
    fields = ("spec", "kind", "operator", "value", "unit", "strictness", "source", "id", "label")
    return rows.select("*", F.posexplode(spec_array(F.col(text), source, specs)).alias("ord", "_c")).select(*rows.columns, "ord", *[F.col(f"_c.{f}").alias(f) for f in fields])


def merged_specs(texts: Sequence[tuple[Column, str]], specs: Sequence[Spec] = SPECS) -> Column:
    """Constraints of several (text, source), in order of their first sight: of those with one id the first hard one counts, else the first."""
    given = F.array(*[F.struct(F.coalesce(t, F.lit("")).alias("text"), F.lit(s).alias("source")) for t, s in texts])
    found = F.flatten(F.transform(given, lambda x: spec_array(x["text"], x["source"], specs)))
    return bound(found, lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda x: x["id"])), lambda k: bound(F.filter(all_, lambda x: x["id"] == k), lambda same: F.coalesce(F.get(F.filter(same, lambda x: x["strictness"] == "hard"), F.lit(0)), F.get(same, F.lit(0))))))


def observed(text: Column, spec: Spec) -> Column:
    """The value that a product text shows, as a double (1 and 0 for present and absent); null if none. Absence wins."""
    if spec.direction == "boolean":
        yes, no = spec.matchers
        return F.when(text.rlike(f"(?i){no}"), 0.0).when(text.rlike(f"(?i){yes}"), 1.0)
    return F.coalesce(*[_number(F.regexp_extract(text, f"(?i){m}", 1)) for m in spec.matchers])


def observed_specs(rows: DataFrame, text: str, specs: Sequence[Spec] = SPECS) -> DataFrame:
    """Adds spec and observed: a row per specification that the text shows. Patterns are literals, compiled once."""
    said = F.col(text)

    def seen(t: Column, s: Spec, m: tuple[str, ...]) -> Column:
        return F.when(_tried(t, s), F.struct(F.lit(s.id).alias("spec"), observed(said, s._replace(matchers=m)).alias("observed")))

    shown = bound(F.lower(said), lambda t: F.filter(F.array(*[seen(t, s, m) for s, m in _readings(specs)]), lambda x: x["observed"].isNotNull()))
    first = lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda x: x["spec"])), lambda k: F.filter(all_, lambda x: x["spec"] == k)[0])
    return rows.withColumn("_s", F.explode(bound(shown, first))).select(*rows.columns, "_s.spec", "_s.observed")


def status(operator: Column, wanted: Column, seen: Column) -> Column:
    """pass, fail, or unknown where the product shows no value."""
    ok = F.when(operator == "max", seen <= wanted).when(operator == "min", seen >= wanted).otherwise(seen == wanted)
    return F.when(seen.isNull() | F.isnan(seen), "unknown").when(ok, "pass").otherwise("fail")


def checked(constraints: DataFrame, observed_rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Adds observed and status to constraints, by an equi join on ``on`` and spec."""
    return constraints.join(observed_rows.select(*on, "spec", "observed"), [*on, "spec"], "left").withColumn("status", status(F.col("operator"), F.col("value"), F.col("observed")))
