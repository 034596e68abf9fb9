"""Requests and responses at their edges: what is sent, what comes back, and what a failure is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.json_documents import is_json
from .images import product_image
from .text import strip

PRODUCTS_MOST, NAME_MOST, LINK_MOST = 5, 200, 2048
_AMOUNT = r"(^|[^\w$])(\$?\s*)(\d[\d,]*(?:\.\d*)?)"

# What ends a request early, and its status.
STATUSES = {
    "concurrency_limit": 429, "rate_limit": 429, "too_large": 413, "invalid_length": 400, "invalid_utf8": 400, "invalid_json": 400, "invalid_request": 400, "unavailable": 503, "cancelled": 499, "failed": 502,
}


def budget_input(value: Column) -> Column:
    """Amounts of a text with a dollar sign and separated thousands."""
    between = F.split(value, _AMOUNT, -1)
    before, amounts = (F.regexp_extract_all(value, F.lit(_AMOUNT), F.lit(i)) for i in (1, 3))

    def shown(a: Column) -> Column:
        plain = F.replace(a, F.lit(","), F.lit(""))
        return F.concat(F.lit("$"), F.format_number(F.regexp_extract(plain, r"^\d+", 0).cast("decimal(38,0)"), 0), F.regexp_extract(plain, r"\.\d*$", 0))

    parts = F.arrays_zip(between.alias("text"), before.alias("lead"), amounts.alias("amount"))
    return F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.coalesce(F.concat(p["lead"], shown(p["amount"])), F.lit("")))), "")


def request_payload(query: Column, budget: Column, priorities: Column, avoid: Column, features: Column) -> Column:
    """The JSON that is sent: trimmed texts, empty ones and empty feature lists left out; the query always."""
    given = lambda c: F.nullif(strip(c), F.lit(""))
    fields = {"query": F.coalesce(strip(query), F.lit("")), "budget": given(budget), "priorities": given(priorities), "avoid": given(avoid), "selectedFeatures": F.when(F.size(features) > 0, features)}
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def benchmark_request(case: Column) -> Column:
    """Of a benchmark case (JSON) what a run may see: category, hardRequirements, id, searchType and five fields of its request. What is no object counts as an empty one."""
    schema = "category string, hardRequirements array<variant>, id string, searchType string, request struct<query:variant,budget:variant,priorities:variant,avoid:variant,selectedFeatures:variant>"
    v = F.from_json(case, schema)
    blank = lambda c: F.coalesce(c, F.lit(""))
    request = F.coalesce(F.to_json(v["request"]), F.lit("{}"))
    return F.when(v.isNotNull(), F.struct(blank(v["category"]).alias("category"), F.coalesce(F.to_json(v["hardRequirements"]), F.lit("[]")).alias("hard_requirements"), blank(v["id"]).alias("id"), request.alias("request"), blank(v["searchType"]).alias("search_type")))


def smoke_grade(exact: Column, near: Column) -> Column:
    """PASS from two exact matches on, MINOR from one or two near ones on, else FAIL."""
    exact, near = F.coalesce(exact, F.lit(0)), F.coalesce(near, F.lit(0))
    return F.when(exact >= 2, "PASS").when((exact == 1) | (near >= 2), "MINOR").otherwise("FAIL")


def response_status(problem: Column) -> Column:
    """The status of a response: 200 without a problem, 400 for errors of the request itself."""
    known = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])
    return F.when(problem.isNull(), 200).otherwise(F.coalesce(F.try_element_at(known, problem), F.lit(400)))


def client_products(body: Column) -> Column:
    """Products of a response's JSON as array<struct<name, productPageUrl, image>>; null where the list or any product is not as agreed.

    A list holds five at most; products have a name and an https link without credentials, and no further keys. An image
    that can't be shown is dropped and its product kept.
    """
    listed = F.try_variant_get(F.when(is_json(body), F.try_parse_json(body)), "$.result.recommendations", "array<variant>")

    def text(v: Column, path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))

    def good(v: Column) -> Column:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        name, link = text(v, "$.name"), text(v, "$.productPageUrl")
        authority = F.try_parse_url(link, F.lit("AUTHORITY"))
        told = (strip(name) != "") & (F.length(name) <= NAME_MOST) & (F.length(link) <= LINK_MOST) & link.rlike("(?i)^https://") & authority.isNotNull() & ~F.contains(authority, F.lit("@"))
        return F.coalesce((F.size(F.array_except(keys, F.array(*[F.lit(k) for k in ("name", "productPageUrl", "image")]))) == 0) & told, F.lit(False))

    def product(v: Column) -> Column:
        image = [text(v, f"$.image.{k}") for k in ("url", "sourceUrl", "sourceTitle", "productId")]
        number = F.try_variant_get(v, "$.image.productId", "variant")
        shown = product_image(*image) & (number.isNull() | image[3].isNotNull())
        fields = F.struct(*[c.alias(n) for n, c in zip(("url", "sourceUrl", "sourceTitle", "productId"), image)])
        return F.struct(text(v, "$.name").alias("name"), text(v, "$.productPageUrl").alias("productPageUrl"), F.when(shown, fields).alias("image"))

    return F.when((F.size(listed) <= PRODUCTS_MOST) & F.forall(listed, good), F.transform(listed, product))


def utc_day(at: Column) -> Column:
    """The day of an instant as yyyy-mm-dd in UTC, whatever the session's time zone: the date that a research request states."""
    micros, day = F.unix_micros(at), F.lit(86_400_000_000)
    return F.date_from_unix_date(((micros - F.pmod(micros, day)) / day).cast("int")).cast("string")
