"""Recorded responses of web research: what was searched and opened, what may be cited, and the final text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.links import safe_product_link

#: Columns of a response's JSON that count; others are ignored.
SCHEMA = (
    "status string, output array<struct<type:string,status:string,phase:string,role:string,action:struct<type:string,url:string,query:string,queries:array<string>,sources:array<struct<url:string>>>,"
    "content:array<struct<type:string,text:string,annotations:array<struct<type:string,url:string>>>>>>"
)
CALLS_MOST, TEXT_MOST, QUERIES_MOST, QUERY_MOST = 6, 32_000, 12, 800


def parsed(body: Column) -> Column:
    """The response as a struct; null for what is no JSON object."""
    return F.from_json(body, SCHEMA)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _calls(r: Column) -> Column:
    return F.filter(r["output"], lambda e: e["type"] == "web_search_call")


def _completed(r: Column) -> Column:
    return F.filter(_calls(r), lambda e: (e["status"] == "completed") & e["action"].isNotNull())


def _searches(r: Column) -> Column:
    return F.filter(_completed(r), lambda e: e["action"]["type"] == "search")


def source_urls(r: Column) -> Column:
    """Distinct safe links: pages opened, sources of completed calls, and citations in finished messages."""
    calls = _completed(r)
    opened = F.transform(F.filter(calls, lambda e: e["action"]["type"].isin("open_page", "find_in_page")), lambda e: e["action"]["url"])
    listed = F.flatten(F.transform(calls, lambda e: F.coalesce(e["action"]["sources"]["url"], _empty("string"))))
    said = F.filter(r["output"], lambda e: (e["type"] == "message") & (e["role"] == "assistant") & (e["status"] == "completed"))
    parts = F.filter(F.flatten(F.transform(said, lambda e: F.coalesce(e["content"], _empty("struct<type:string,text:string,annotations:array<struct<type:string,url:string>>>")))), lambda c: c["type"] == "output_text")
    cited = F.filter(F.flatten(F.transform(parts, lambda c: F.coalesce(c["annotations"], _empty("struct<type:string,url:string>")))), lambda a: a["type"] == "url_citation")
    return F.array_distinct(F.filter(F.concat(opened, listed, F.transform(cited, lambda a: a["url"])), safe_product_link))


def observed_queries(r: Column) -> Column:
    """Queries of completed searches in order, of each the first QUERIES_MOST that aren't too long."""
    asked = lambda a: F.filter(F.concat(F.array(a["query"]), F.coalesce(a["queries"], _empty("string"))), lambda q: F.length(q) <= QUERY_MOST)
    return F.flatten(F.transform(_searches(r), lambda e: F.slice(asked(e["action"]), 1, QUERIES_MOST)))


def counts(r: Column) -> Column:
    """Struct (sources, tool_entries, completed, unfinished, searches)."""
    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    fields = {"sources": n(source_urls(r)), "tool_entries": n(_calls(r)), "completed": n(_completed(r)), "unfinished": n(_calls(r)) - n(_completed(r)), "searches": n(_searches(r))}
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def final_text(r: Column) -> Column:
    """The text of the one final message, which must be the last of all messages; else null."""
    messages = F.filter(r["output"], lambda e: e["type"] == "message")
    finals = F.filter(messages, lambda e: e["phase"] == "final_answer")
    plain = F.filter(messages, lambda e: e["phase"].isNull())
    last = F.try_element_at(messages, F.lit(-1))
    alone = F.when(F.size(finals) > 0, (F.size(finals) == 1) & last["phase"].eqNullSafe(F.lit("final_answer"))).otherwise((F.size(plain) == 1) & last["phase"].isNull())
    whole = last["content"].isNotNull() & ~F.exists(last["content"], lambda c: ~c["type"].eqNullSafe(F.lit("output_text")) | c["text"].isNull())
    text = F.array_join(F.transform(last["content"], lambda c: c["text"]), "")
    good = alone & (last["role"] == "assistant") & (last["status"] == "completed") & whole & (F.length(text) > 0) & (F.length(text) <= TEXT_MOST)
    return F.when(F.coalesce(good, F.lit(False)), text)


def problem(r: Column) -> Column:
    """invalid_output, missing_web_search, or null where the response can be used."""
    finished = F.coalesce(r["status"] == "completed", F.lit(False))
    n = F.coalesce(F.size(_completed(r)), F.lit(0))
    return F.when(~finished | (n > CALLS_MOST), "invalid_output").when(F.coalesce(F.size(_searches(r)), F.lit(0)) == 0, "missing_web_search").when(final_text(r).isNull(), "invalid_output")
