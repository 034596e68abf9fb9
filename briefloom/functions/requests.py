"""Requests: the first error of a JSON body, and the typed features that a user selects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.json_documents import is_json
from . import dictionaries as D
from .features import FEATURES, canonical_feature
from .links import search_error
from .text import bound, feature_text, requirement, slug, strip

# Longest fields in UTF-16 units, most features, a feature's keys, types and operators.
QUERY_MOST, BUDGET_MOST, DETAILS_MOST, LEGACY_MOST = 200, 500, 2000, 500
ID_MOST, NAME_MOST, VALUE_MOST, UNIT_MOST, FEATURES_MOST = 100, 200, 500, 50, 12
KEYS = ("id", "name", "type", "operator", "value", "unit", "required", "source")
TYPES = ("enum", "boolean", "number", "range", "text", "exclusion")
OPERATORS = ("equals", "not_equals", "includes", "not_includes", "lte", "gte", "between", "required")

_NUMBER = "^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def _units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def _kind(value: Column) -> Column:
    """The JSON type by its Spark name; null where the value is missing."""
    return F.schema_of_variant(value)


def _field(body: Column, name: str) -> Column:
    return F.try_variant_get(body, f"$.{name}", "variant")


def _text(body: Column, name: str) -> Column:
    """A field's text; null if it is missing or anything else."""
    return F.when(_kind(_field(body, name)) == "STRING", F.try_variant_get(body, f"$.{name}", "string"))


def _bounded(value: Column) -> Column:
    """A selected value: text, number, boolean, or two numbers."""
    kind, pair = _kind(value), F.try_variant_get(value, "$", "array<variant>")
    return (
        F.when(kind == "STRING", _units(F.try_variant_get(value, "$", "string")) <= VALUE_MOST).when((kind == "BOOLEAN") | kind.rlike(_NUMBER), True)
        .when(F.startswith(kind, F.lit("ARRAY")), (F.size(pair) == 2) & F.forall(pair, lambda x: F.coalesce(_kind(x).rlike(_NUMBER), F.lit(False)))).otherwise(False)
    )


def feature_valid(item: Column) -> Column:
    """Whether a variant is null, a short text, or a selected feature with the right keys, types and lengths."""
    kind, name, key, unit = _kind(item), _text(item, "name"), _text(item, "id"), _field(item, "unit")
    keys = F.map_keys(F.try_variant_get(item, "$", "map<string,variant>"))
    whole = (
        (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in KEYS]))) == 0) & (strip(key) != "") & (_units(key) <= ID_MOST) & (strip(name) != "") & (_units(name) <= NAME_MOST)
        & _text(item, "type").isin(*TYPES) & _text(item, "operator").isin(*OPERATORS) & (_text(item, "source") == "smart_features")
        & (_kind(_field(item, "required")) == "BOOLEAN") & F.try_variant_get(item, "$.required", "boolean") & _bounded(_field(item, "value"))
        & (unit.isNull() | F.coalesce(_units(_text(item, "unit")) <= UNIT_MOST, F.lit(False)))
    )
    return F.when(kind == "VOID", True).when(kind == "STRING", _units(F.try_variant_get(item, "$", "string")) <= LEGACY_MOST).when(F.startswith(kind, F.lit("OBJECT")), F.coalesce(whole, F.lit(False))).otherwise(False)


def request_error(body: Column) -> Column:
    """The first error of a request's JSON text; null for a good one. Unknown keys are ignored; what is no JSON is no object."""
    v = F.when(is_json(body), F.try_parse_json(body))
    query, features = _text(v, "query"), _field(v, "selectedFeatures")
    given = lambda name: _kind(_field(v, name)) != "VOID"
    bad = lambda name, most: given(name) & F.coalesce(_units(_text(v, name)) > most, F.lit(True))
    items = F.try_variant_get(v, "$.selectedFeatures", "array<variant>")
    return (
        F.when(~F.coalesce(F.startswith(_kind(v), F.lit("OBJECT")), F.lit(False)), "invalid_body").when(query.isNull(), "empty").when(_units(query) > QUERY_MOST, "query_too_long").when(search_error(query).isNotNull(), search_error(query))
        .when(bad("budget", BUDGET_MOST), "invalid_budget").when(bad("priorities", DETAILS_MOST), "invalid_priorities").when(bad("avoid", DETAILS_MOST), "invalid_avoid")
        .when(given("selectedFeatures") & ~F.startswith(_kind(features), F.lit("ARRAY")), "invalid_feature_list").when(F.size(items) > FEATURES_MOST, "too_many_features")
        .when(F.exists(items, lambda x: ~feature_valid(x)), "invalid_feature")
    )


def first_number(raw: Column) -> Column:
    return F.regexp_extract(F.replace(raw, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def number_range(raw: Column) -> Column:
    """Struct (low, high) of "a-b" or "a to b"; null if there is none."""
    plain, pattern = F.replace(raw, F.lit(","), F.lit("")), r"(?i)(-?\d+(?:\.\d+)?)\s*(?:-|to)\s*(-?\d+(?:\.\d+)?)"
    return F.when(plain.rlike(pattern), F.struct(F.regexp_extract(plain, pattern, 1).cast("double").alias("low"), F.regexp_extract(plain, pattern, 2).cast("double").alias("high")))


def inferred_operator(raw: Column, kind: Column, allowed: Column) -> Column:
    """How an option's text binds: required for booleans, bounds by their words, between for ranges, else the feature's own first choice."""
    return bound(feature_text(raw), lambda said: (
        F.when(kind == "boolean", "required").when(said.rlike(r"\b(?:under|less than|below|no more than|at most|max|maximum)\b"), "lte").when(said.rlike(r"\b(?:at least|min|minimum|more than|over)\b"), "gte")
        .when(number_range(raw).isNotNull(), "between").when(F.array_contains(allowed, "equals"), "equals").otherwise(F.coalesce(F.get(allowed, F.lit(0)), F.lit("equals")))
    ))


def _shown(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def option_value(raw: Column, kind: Column, operator: Column) -> Column:
    """The value of an option as text: true, "low-high", a number, or the option itself where it holds none."""
    trimmed = strip(raw)
    numeric = kind.isin("number", "range") | operator.isin("lte", "gte")
    joined = bound(number_range(raw), lambda span: F.concat(_shown(span["low"]), F.lit("-"), _shown(span["high"])))
    return (
        F.when(kind == "boolean", "true").when(operator == "between", F.coalesce(joined, trimmed))
        .when(numeric, F.coalesce(_shown(first_number(raw)), trimmed)).otherwise(trimmed)
    )


def selected_feature(key: Column, name: Column, kind: Column, unit: Column, allowed: Column, raw: Column) -> Column:
    """Struct (id, name, type, operator, value, unit) of an option that a user picked."""
    # step by step, so that no step's expression is repeated inside the next one's
    given = F.struct(*[c.alias(n) for n, c in {"key": key, "name": name, "type": kind, "unit": unit, "allowed": allowed, "raw": raw}.items()])
    bind = lambda x: F.struct(x.alias("x"), inferred_operator(x["raw"], x["type"], x["allowed"]).alias("operator"))
    read = lambda y: F.struct(y["x"].alias("x"), y["operator"].alias("operator"), option_value(y["x"]["raw"], y["x"]["type"], y["operator"]).alias("value"))

    def made(z: Column) -> Column:
        x, operator, value = z["x"], z["operator"], z["value"]
        own = F.when(x["key"] != "", x["key"])
        fields = {"id": slug(F.concat_ws("-", F.coalesce(own, x["name"]), operator, value)), "name": x["name"], "type": x["type"], "operator": operator, "value": value, "unit": F.when(x["unit"] != "", x["unit"])}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    return bound(bound(bound(given, bind), read), made)


def legacy_feature(raw: Column) -> Column:
    """The same struct from "name: value"; a text without a colon is both."""
    first = strip(F.substring_index(raw, ":", 1))
    name = F.when(first == "", "Feature").otherwise(first)
    rest = strip(F.when(F.contains(raw, F.lit(":")), F.regexp_replace(raw, "(?s)^[^:]*:", "")).otherwise(""))
    value, said = F.when(rest == "", name).otherwise(rest), feature_text(name)
    kind = F.when(F.contains(said, F.lit("color")), "enum").when(F.contains(said, F.lit("size")) | F.contains(said, F.lit("width")), "number").otherwise("text")
    fields = {"id": slug(F.concat_ws("-", name, value)), "name": name, "type": kind, "operator": F.lit("equals"), "value": value, "unit": F.lit(None).cast("string")}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _with_unit(value: Column, unit: Column) -> Column:
    """The unit follows unless the value ends with it."""
    unit = strip(F.coalesce(unit, F.lit("")))
    there = F.endswith(F.concat(F.lit(" "), feature_text(value)), F.concat(F.lit(" "), feature_text(unit))) & (feature_text(unit) != "")
    return F.when((unit == "") | there, value).otherwise(F.concat_ws(" ", value, unit))


def feature_label(f: Column) -> Column:
    """What is shown of a selected feature."""
    how = F.when(f["operator"] == "lte", "under ").when(f["operator"] == "gte", "at least ").when(f["operator"].isin("not_equals", "not_includes"), "not ").otherwise("")
    return F.when((f["operator"] == "required") & (f["value"] == "true"), f["name"]).otherwise(F.concat(f["name"], F.lit(": "), how, _with_unit(f["value"], f["unit"])))


def feature_search_text(f: Column) -> Column:
    """What is searched for of a selected feature."""
    value = _with_unit(F.when(f["operator"] == "between", F.regexp_replace(f["value"], r"^(-?[\d.]+)-(-?[\d.]+)$", "$1 to $2")).otherwise(f["value"]), f["unit"])
    joined = lambda *words: F.concat_ws(" ", *words)
    return (
        F.when(f["operator"] == "lte", joined(f["name"], F.lit("under"), value)).when(f["operator"] == "gte", joined(f["name"], F.lit("at least"), value))
        .when(f["operator"].isin("not_equals", "not_includes"), joined(F.lit("without"), f["name"], value)).when((f["operator"] == "required") & (f["value"] == "true"), f["name"]).otherwise(strip(joined(f["name"], value)))
    )


def feature_key(f: Column) -> Column:
    """Features of one key are one."""
    return slug(F.concat_ws(" ", f["id"], f["name"], f["operator"], f["value"], F.coalesce(f["unit"], F.lit(""))))


def feature_kind(name: Column, value: Column) -> Column:
    """What a selected feature constrains: colour, material, brand, size, or what its definition says."""
    said, v = requirement(name), requirement(value)
    holds = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(said, w))
    known = F.create_map(*[F.lit(x) for f in FEATURES for x in (f.name, f.kind)])
    return (
        F.when(holds("color") | v.isin(*D.COLORS), "color").when(holds("material", "fabric") | v.isin(*D.MATERIALS), "material").when(holds("brand"), "brand")
        .when(holds("size", "width", "depth", "height", "length"), "size").otherwise(F.coalesce(F.try_element_at(known, canonical_feature(value)), F.lit("feature")))
    )


def distinct_features(features: Column) -> Column:
    """Of selected features with one key the first, in order."""
    keyed = F.transform(features, lambda f: F.struct(feature_key(f).alias("key"), f.alias("f")))
    first = lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda x: x["key"])), lambda k: F.filter(all_, lambda x: x["key"] == k)[0]["f"])
    return bound(keyed, first)
