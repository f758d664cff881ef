"""Document sources: binary files, web pages, and pages of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import refdata as R, text as X

# Entities decoded by the page reader; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
DROPPED_BLOCKS = r"(?is)<!--.*?-->|<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<aside\b.*?</aside\s*>"
TAGS = r"(?s)<[^>]*>"


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path as path, length and content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def byte_gate(content: Column) -> Column:
    """Why a file is refused, or "ok": size first, then the PDF signature."""
    return (
        F.when(F.octet_length(content) > R.MAX_FILE_BYTES, "too_large")
        .when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "ok")
        .otherwise("not_pdf")
    )


def html_text(html: Column) -> Column:
    """Main text of a web page: navigation, footers, scripts and comments go; short rests are empty."""
    body = F.regexp_replace(F.regexp_replace(html, DROPPED_BLOCKS, " "), TAGS, " ")
    for entity, char in ENTITIES:
        body = F.replace(body, F.lit(entity), F.lit(char))
    text = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(text) >= R.MIN_TEXT_CHARS, text).otherwise(F.lit(""))


def page_marked(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """Pages of each document joined in order under page marks."""
    marked = F.concat(F.lit("--- PAGINA "), F.col(page).cast("string"), F.lit(" ---\n"), F.col(text))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("n"), marked.alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r["t"]), "\n").alias("text"))


def _ipv4(host: Column) -> Column:
    octets = F.split(host, r"\.")
    part = lambda i: octets[i].cast("bigint")
    return F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def url_admissible(url: Column) -> Column:
    """https, with a host, and no literal address of a closed network. Names are not resolved."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    address = _ipv4(host)
    closed = host.isin("[::1]", "[::]", "localhost") | host.rlike(r"^\[f([cd]|e[89ab]|f)[0-9a-f]{0,2}:")
    for network, length in R.CLOSED_NETWORKS:
        a, b, c, d = (int(x) for x in network.split("."))
        low = a * 16777216 + b * 65536 + c * 256 + d
        closed = closed | F.coalesce(address.between(low, low + 2 ** (32 - length) - 1), F.lit(False))
    return F.coalesce((scheme == "https") & (host != "") & ~closed, F.lit(False))
