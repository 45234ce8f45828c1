"""URLs, domains and cited sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerlens.functions.text import blank, folded
from answerlens.schemas import CITATION_ITEMS

# Patterns and trailing punctuation that results depend on. Unicode blanks are listed
# one by one, since Java's \s covers ASCII only.
BLANK_CODES = (
    r"\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
URL = rf'https?://[^{BLANK_CODES}()<>"]+'
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
TRAILING_PUNCTUATION = ".,;:!)]}"


def domain(url: Column) -> Column:
    """Lower-cased host of a URL or of a bare domain, without ``www.`` and port.

    User names are not removed. A host with a single bracket is malformed and has no domain; one with both is taken as
    it stands. One regex settles the usual URL. Only one with brackets or line breaks, which count as not there, goes
    the longer way.
    """
    odd = F.contains(url, F.lit("["))
    for mark in ("]", "\t", "\r", "\n"):
        odd = odd | F.contains(url, F.lit(mark))
    usual = F.regexp_extract(url, r"\A(?:https?://)?(?:www\.)?([^/?#:]*)", 1)
    host = F.regexp_extract(F.translate(F.regexp_replace(url, r"\Ahttps?://", ""), "\t\r\n", ""), r"\A[^/?#]*", 0)
    malformed = F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))
    unusual = F.when(malformed, "").otherwise(F.regexp_extract(host, r"\A(?:www\.)?([^:]*)", 1))
    return F.when(url.isNull(), "").otherwise(F.lower(F.when(odd, unusual).otherwise(usual)))


def bare_urls(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(URL), 0), lambda url: F.rtrim(url, F.lit(TRAILING_PUNCTUATION))
    )


def markdown_urls(text: Column) -> Column:
    return F.filter(
        F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), 2), lambda link: F.startswith(link, F.lit("http"))
    )


def _no_items() -> Column:
    return F.array().cast(CITATION_ITEMS)


def text_sources(text: Column) -> Column:
    """Sources named in the text itself: plain URLs, then markdown links not seen before."""
    urls = F.array_distinct(F.concat(bare_urls(text), markdown_urls(text)))
    items = F.transform(urls, lambda url: F.struct(url.alias("source_url"), domain(url).alias("source_domain")))
    named = F.filter(items, lambda item: item.source_domain != "")
    return F.when(F.contains(text, F.lit("http")), named).otherwise(_no_items())


def keep_first(items: Column) -> Column:
    """One item per ``key``, the earliest, in the order of appearance.

    ``items`` are structs that begin with the fields ``key, at``. Sorting puts equal keys side by side,
    so each item is compared with its neighbour only.
    """
    by_key = F.sort_array(items)
    previous = F.concat(F.array(F.lit(None)), by_key)

    def first_or_null(item: Column, before: Column) -> Column:
        repeated = before.isNotNull() & (before.key == item.key)
        return F.when(
            item.isNotNull() & ~repeated,
            F.struct(item["at"].alias("at"), item.source_url.alias("source_url"),
                     item.source_domain.alias("source_domain")),
        )

    in_order = F.sort_array(F.array_compact(F.zip_with(by_key, previous, first_or_null)))
    return F.transform(in_order, lambda item: F.struct(item.source_url.alias("source_url"),
                                                       item.source_domain.alias("source_domain")))


def grounded_items(sources: Column) -> Column:
    """Keyed sources of a grounded answer: by URL, or by title where there is no URL."""

    def item(source: Column, at: Column) -> Column:
        titled = blank(source.url)
        title = folded(F.coalesce(source.title, F.lit("")))
        return F.struct(
            F.when(titled, F.concat(F.lit("title::"), title)).otherwise(source.url).alias("key"),
            at.alias("at"),
            source.url.alias("source_url"),
            F.when(titled, title).otherwise(domain(source.url)).alias("source_domain"),
        )

    return F.filter(F.transform(sources, item), lambda i: i.source_domain != "")


def grounded_sources(sources: Column) -> Column:
    return keep_first(grounded_items(sources))


def cited_sources(text: Column, sources: Column) -> Column:
    """The sources of an answer: the grounded ones if any are given, else those named in the text.

    A given list that turns out to hold nothing usable is not replaced by the text's sources.
    An answer without text cites nothing.
    """
    given = F.size(F.coalesce(sources, F.array().cast("array<struct<url:string,title:string>>"))) > 0
    return (
        F.when(blank(text), _no_items())
        .when(given, grounded_sources(sources).cast(CITATION_ITEMS))
        .otherwise(text_sources(text).cast(CITATION_ITEMS))
    )
