"""Web sources as column expressions: sitemaps, pages as text, paths in scripts, metadata triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import col


def sitemap_urls(xml: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(col(xml), F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def strip_html(html: str | Column) -> Column:
    """Text of a page by a chain of replacements: scripts, styles and drawings go whole, tags become spaces."""
    out = col(html)
    for tag in ("script", "style", "svg"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    out = F.replace(F.replace(out, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def path_shape(url: str | Column) -> Column:
    """A path with its numbers masked, such as /en/N."""
    path = F.regexp_extract(col(url), r"^[a-z]+://[^/]*(/[^?#]*)", 1)
    return F.regexp_replace(path, r"\d+", "N")


def script_paths(scripts: DataFrame, text: str, prefix: str = "/api/") -> DataFrame:
    """path, n: string literals in scripts that look like paths, counted."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"[\"'`](\Q" + prefix + r"\E[^\"'`\s]*)[\"'`]"), F.lit(1))
    return scripts.select(F.explode(found).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def pivot_triples(
    triples: DataFrame, subject: str, prop: str, value: str, pos: str, scalars: dict[str, str], relations: dict[str, str]
) -> DataFrame:
    """One row a subject: of scalar properties the last value, of relations all values in order."""
    is_ = lambda name: F.col(prop) == name
    last = [F.max_by(F.when(is_(p), F.col(value)), F.when(is_(p), F.col(pos))).alias(c) for c, p in scalars.items()]
    listed = [
        F.transform(F.array_sort(F.collect_list(F.when(is_(p), F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))), lambda x: x["v"]).alias(c)
        for c, p in relations.items()
    ]
    return triples.groupBy(subject).agg(*last, *listed)
