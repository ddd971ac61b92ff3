"""Where in a document something stands: pages of offsets and of excerpts, inside the projection of its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.textnorm import collapse, normalize_business_text

#: Steps of the search over page ends: documents of up to 2 ** STEPS pages.
STEPS = 20


def joined_text(pages: Column) -> Column:
    """The text of a document: its pages one line feed apart, without white space around. Null pages are empty."""
    texts = F.transform(pages, lambda p: F.coalesce(p, F.lit("")))
    return F.regexp_replace(F.array_join(texts, "\n"), r"(?U)^\s+|\s+$", "")


def page_spans(pages: Column) -> Column:
    """(lead, ends, starts): offsets of the pages in the joined text before it is trimmed, and what trimming cuts off.

    The ends ascend, so a page is found by bisection however many there are.
    """
    sizes = F.transform(pages, lambda p: F.length(F.coalesce(p, F.lit(""))))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("ends"))
    step = lambda acc, n: F.struct((acc["at"] + n + 1).alias("at"), F.array_append(acc["ends"], acc["at"] + n).alias("ends"))
    ends = F.aggregate(sizes, start, step, lambda acc: acc["ends"])
    whole = F.array_join(F.transform(pages, lambda p: F.coalesce(p, F.lit(""))), "\n")
    lead = F.length(whole) - F.length(F.regexp_replace(whole, r"(?U)^\s+", ""))
    return F.struct(lead.alias("lead"), ends.alias("ends"), sizes.alias("sizes"))


def page_of_span(spans: Column, start: Column, end: Column) -> Column:
    """The number, from 1, of the first page that a span of the trimmed text overlaps; null for spans outside all pages.

    spans is a column of page_spans(). The pages that end at or before the span are counted by bisection; the next one
    is the page if it begins before the span ends. A span of a line feed between pages alone is on none.
    """
    low, high, ends = start + spans["lead"], end + spans["lead"], spans["ends"]
    powers = F.array(*(F.lit(1 << k) for k in reversed(range(STEPS))))
    before = F.aggregate(powers, F.lit(0), lambda n, k: F.when(F.coalesce(F.get(ends, n + k - 1) <= low, F.lit(False)), n + k).otherwise(n))
    found = F.get(ends, before).isNotNull() & (F.get(ends, before) - F.get(spans["sizes"], before) < high)
    return F.when((start >= 0) & (end > start) & found, before + 1)


def flat_pages(pages: Column) -> Column:
    """Pages as excerpts are looked up in them: white space collapsed, lower case."""
    return F.transform(pages, lambda p: F.lower(F.regexp_replace(F.coalesce(p, F.lit("")), r"(?U)\s+", " ")))


def normal_pages(pages: Column) -> Column:
    """Pages as parsers read them, for excerpts of their lines: normalised like the text, then as in flat_pages()."""
    return F.transform(pages, lambda p: F.lower(F.regexp_replace(normalize_business_text(p), r"(?U)\s+", " ")))


def _first_page(pages: Column, hit: Callable[[Column], Column]) -> Column:
    return F.nullif(F.array_position(F.transform(pages, lambda p: F.coalesce(hit(p), F.lit(False))), True), F.lit(0)).cast("int")


def _flat(text: Column) -> Column:
    return F.lower(collapse(F.regexp_replace(text, r"(?U)\s+", " ")))


def page_of_phrase(flat: Column, excerpt: Column, least: int = 4) -> Column:
    """The first of flat_pages() with the whole excerpt, or a part of it between bars of at least so many characters."""
    whole = _flat(excerpt)
    parts = F.filter(F.transform(F.split(whole, r"\|"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    return F.when(whole != "", _first_page(flat, lambda p: F.contains(p, whole) | F.exists(parts, lambda x: F.contains(p, x))))


def page_of_parts(flat: Column, excerpt: Column, least: int = 3) -> Column:
    """The first of flat_pages() with a part of the excerpt between bars of at least so many characters."""
    parts = F.filter(F.transform(F.split(excerpt, r"\|"), _flat), lambda x: F.length(x) >= least)
    return F.when(excerpt.isNotNull(), _first_page(flat, lambda p: F.exists(parts, lambda x: F.contains(p, x))))
