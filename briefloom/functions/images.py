"""Pictures of products, as shopping listings give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

# Links as most are written, and which pass: small letters, digits and signs that need no parser. Others are parsed.
_THUMBNAIL = r"^https://encrypted-tbn[0-3]\.gstatic\.com/shopping\?q=[A-Za-z0-9:._~-]+(?:&[A-Za-z0-9:._~=&-]*)?\z"
_SOURCE = r"^https://(?:[a-z0-9]++(?:-++[a-z0-9]++)*+\.)+[a-z]{2,}+(?<!\.local|\.localhost|\.internal|\.test|\.invalid)(?:/[A-Za-z0-9/._~-]*+)?(?:\?[A-Za-z0-9/._~=&-]*+)?\z"


def _as_written(url: Column, pattern: str) -> Column:
    return F.coalesce((F.length(url) <= 2048) & url.rlike(pattern), F.lit(False))


def _plain_https(url: Column) -> Column:
    """https without credentials or a port, 2,048 characters."""
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    return (F.length(url) <= 2048) & url.rlike("(?i)^https://") & ~F.contains(authority, F.lit("@")) & ~authority.rlike(r":\d+$")


def shopping_image_url(url: Column) -> Column:
    """Whether a link is a shopping search's thumbnail."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    # fixed values: host and path of thumbnails
    there = host.rlike(r"^encrypted-tbn[0-3]\.gstatic\.com$") & (F.try_parse_url(url, F.lit("PATH")) == "/shopping")
    return _as_written(url, _THUMBNAIL) | F.coalesce(_plain_https(url) & there & (F.try_parse_url(url, F.lit("QUERY"), F.lit("q")) != ""), F.lit(False))


def product_image(url: Column, source_url: Column, title: Column, product_id: Column) -> Column:
    """Whether a picture may be shown: a thumbnail, a title of 400 characters, a public source, and a number for an id, if any."""
    host = F.lower(F.try_parse_url(source_url, F.lit("HOST")))
    public = _plain_https(source_url) & host.rlike(r"^(?:[a-z0-9-]+\.)+[a-z]{2,}$") & ~host.rlike(r"\.(?:local|localhost|internal|test|invalid)$")
    named = title.rlike(f"[^{WS[1:-1]}]") & (F.length(title) <= 400) & (product_id.isNull() | product_id.rlike(r"^\d{1,40}$"))
    return shopping_image_url(url) & F.coalesce((_as_written(source_url, _SOURCE) | public) & named, F.lit(False))
