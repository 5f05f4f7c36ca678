"""Links of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalflow.functions.scalars import strip
from pedalflow.functions.text import infer_period

# Fixed value: what counts as a data file.
FILE_PATTERN = r"(?i)\.(csv|zip)(\?.*)?$"

_ANCHOR_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_NOT_CONTENT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _remove_dot_segments(path: Column) -> Column:
    """``/a/./b/../c`` → ``/a/c``; a trailing dot segment leaves a trailing slash."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    trailing = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(kept, "/"), trailing)).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(base_path, r"^/?(.*/)?", 1))
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, base_path, href))
        .when(href.startswith("/"), F.concat(origin, _remove_dot_segments(path), tail))
        .otherwise(F.concat(origin, _remove_dot_segments(F.concat(folder, path)), tail))
    )


def extract_links(pages: DataFrame, pattern: str = FILE_PATTERN) -> DataFrame:
    """Distinct links of each page (``page_id, url, html``) whose target matches ``pattern``.

    Output: page_id, url (absolute), file_name, year, month, pos (first position on the page).
    """
    content = F.regexp_replace("html", _NOT_CONTENT, "")
    found = pages.select(
        "page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all(content, F.lit(_ANCHOR_HREF), 1)).alias("pos", "raw")
    )
    href = F.regexp_replace("raw", r"""^["']|["']$""", "")
    for entity, char in _ENTITIES.items():
        href = F.replace(href, F.lit(entity), F.lit(char))
    links = found.select("page_id", "base", "pos", strip(href).alias("href")).filter(F.col("href").rlike(pattern))
    distinct = (
        links.select("page_id", "pos", resolve_url(F.col("base"), F.col("href")).alias("url"))
        .groupBy("page_id", "url")
        .agg(F.min("pos").alias("pos"))
    )
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    named = distinct.withColumn("file_name", F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]*)$", 1))
    year, month = infer_period(F.col("file_name"))
    return named.select("page_id", "url", "file_name", year.alias("year"), month.alias("month"), "pos")
