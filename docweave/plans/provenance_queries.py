"""Queries of page numbers and of authorities that may be one, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import business, labels, provenance
from docweave.plans.business_queries import _PAIRS
from docweave.plans.views import view, with_view

#: Lines of a page, offset between spans and their size in the queries below.
LINES, STEP, SIZE = 3, 5, 7


def paged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business texts cut into pages; the first page of every second document begins with an empty line."""
    t = view(spark, sf_dir, "business_texts")
    lines = F.split("text", "\n")
    cut = F.transform(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(LINES)), lambda i: F.array_join(F.slice(lines, i + 1, LINES), "\n"))
    lead = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("  \n"))).otherwise(F.expr("cast(array() as array<string>)"))
    return t.select("doc_id", "hint", F.concat(lead, cut).alias("pages"))


def span_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of every span of the joined text, 0 where it is on none."""
    t = paged_texts(spark, sf_dir).select("doc_id", provenance.joined_text(F.col("pages")).alias("text"), provenance.page_spans(F.col("pages")).alias("spans"))
    starts = t.select("doc_id", "spans", F.explode(F.sequence(F.lit(0), F.length("text") + STEP, F.lit(STEP))).alias("start"))
    page = provenance.page_of_span(F.col("spans"), F.col("start"), F.col("start") + SIZE)
    return starts.select("doc_id", F.col("start").cast("long").alias("start"), F.coalesce(page.cast("long"), F.lit(0)).alias("page"))


def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of the evidence of every label/value pair, 0 where it is on none."""
    t = paged_texts(spark, sf_dir).select("doc_id", provenance.joined_text(F.col("pages")).alias("text"), provenance.flat_pages(F.col("pages")).alias("flat"))
    found = labels.label_values(t).join(t.select("doc_id", "flat"), "doc_id")
    page = provenance.page_of_parts(F.col("flat"), F.col("excerpt"))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "label", F.coalesce(page.cast("long"), F.lit(0)).alias("page"))


def authority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = business.merge_candidates(view(spark, sf_dir, "authorities"))
    return found.select("doc_id", "value", F.round("confidence", 4).alias("confidence"), "conflict")


_PAGED = f"""t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM business_texts),
paged AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN ['  ' || chr(10)] ELSE [] END
          || list_transform(range(0, len(ls), {LINES}), lambda i: array_to_string(ls[i + 1:i + {LINES}], chr(10))) AS pages FROM t),
pages AS (SELECT doc_id, unnest(pages) AS page_text, generate_subscripts(pages, 1) AS page FROM paged)"""
_SPANS = with_view("business_texts", f"""{_PAGED},
bounds AS (SELECT doc_id, page, coalesce(sum(length(page_text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low,
                  length(page_text) AS size FROM pages),
s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 0 END AS lead, unnest(range(0, length(text) + {STEP} + 1, {STEP})) AS start FROM t)
SELECT s.doc_id, s.start, coalesce(min(page), 0)::BIGINT AS page FROM s LEFT JOIN bounds b
ON b.doc_id = s.doc_id AND s.start + s.lead < b.low + b.size AND s.start + s.lead + {SIZE} > b.low GROUP BY s.doc_id, s.start""")
_EVIDENCE = with_view("business_texts", rf"""{_PAIRS}, {_PAGED},
flat AS (SELECT doc_id, page, lower(regexp_replace(page_text, '\s+', ' ', 'g')) AS body FROM pages),
parts AS (SELECT p.doc_id, p.line_no, p.label, trim(lower(regexp_replace(unnest(string_split(CASE WHEN n.inl THEN n.line ELSE n.line || ' | ' || n.nxt END, '|')), '\s+', ' ', 'g'))) AS part
          FROM pairs p JOIN n ON n.doc_id = p.doc_id AND n.i = p.line_no)
SELECT parts.doc_id, line_no, label, coalesce(min(page), 0)::BIGINT AS page FROM parts LEFT JOIN flat
ON flat.doc_id = parts.doc_id AND length(part) >= 3 AND contains(body, part) GROUP BY parts.doc_id, line_no, label""")
_WORDS = "regexp_extract_all(upper({x}), '[A-Z]{{4,}}')"
_GENERIC = "['STATE', 'SECRETARY', 'DIVISION', 'CORPORATIONS', 'REGISTRY', 'REGISTRAR', 'COMMISSION']"
_AUTHORITIES = with_view("authorities", f"""
p AS (SELECT doc_id, max(value) FILTER (parser = 0) AS v0, max(confidence) FILTER (parser = 0) AS s0, max(value) FILTER (parser = 1) AS v1, max(confidence) FILTER (parser = 1) AS s1
      FROM authorities GROUP BY doc_id),
w AS (SELECT *, {_WORDS.format(x='v0')} AS a, {_WORDS.format(x='v1')} AS b,
             coalesce(regexp_replace(upper(v0), '[^A-Z0-9]', '', 'g') <> regexp_replace(upper(v1), '[^A-Z0-9]', '', 'g'), false) AS differs FROM p),
c AS (SELECT *, len(list_filter(list_intersect(a, b), lambda x: NOT list_contains({_GENERIC}, x))) > 0 AND list_has_any(a, {_GENERIC}) AND list_has_any(b, {_GENERIC}) AS same FROM w),
d AS (SELECT *, v0 IS NULL OR (differs AND s1 > s0 + CASE WHEN same THEN 0 ELSE 0.02::DOUBLE END) AS second FROM c)
SELECT doc_id, CASE WHEN second THEN v1 ELSE v0 END AS value, round(CASE WHEN second THEN s1 ELSE s0 END, 4) AS confidence, differs AND NOT coalesce(same, false) AS conflict FROM d""")

QUERIES = {"span_pages": span_pages, "evidence_pages": evidence_pages, "authority_merge": authority_merge}
ORACLES = {"span_pages": _SPANS, "evidence_pages": _EVIDENCE, "authority_merge": _AUTHORITIES}
