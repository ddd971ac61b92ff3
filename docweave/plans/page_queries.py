"""Queries of page text, ingest policy and webhook events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import pages
from docweave.plans.views import view, with_view
from docweave.sources import policy
from docweave.streaming import webhooks


def group_boxes_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.group_boxes(view(spark, sf_dir, "boxes"))


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "page_candidates")
    return found.select(
        "doc_id",
        pages.readability_score(F.col("embedded")).cast("long").alias("readability"),
        pages.identity_text_score(F.col("embedded")).cast("long").alias("identity"),
    )


def select_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.select_page_text(view(spark, sf_dir, "page_candidates"))
    return found.select("doc_id", F.md5("text").alias("text_md5"), "source", "text_confidence")


def page_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.limit_pages(view(spark, sf_dir, "doc_pages"), max_pages=3, max_chars=120)
    return found.select("doc_id", "page_number", "text", F.col("total_pages").cast("long").alias("total_pages"), "truncated")


def page_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "page_candidates")
    return t.select(
        "doc_id",
        pages.embedded_text_is_sufficient(F.col("embedded")).alias("embedded"),
        pages.ocr_text_is_sufficient(F.col("rendered"), F.col("ocr_confidence")).alias("rendered"),
    )


def extraction_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extraction_metadata(view(spark, sf_dir, "doc_pages"), max_pages=3, max_chars=120)
    listed = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["page"].cast("string"), p["text_length"].cast("string"))), "|")
    return found.select("doc_id", "pages_processed", "total_pages", "truncated", listed.alias("pages"), F.array_join("warnings", "|").alias("warnings"))


def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = policy.SourcePolicy(allowed_hosts=("*.example.net", "*.example.com"), allow_http=False)
    found = policy.check_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)
    return found.select("page_id", F.col("status").cast("long").alias("status"), "reason", "normalized_url")


def file_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy.inspect_uploads(view(spark, sf_dir, "uploads"))
    return found.select("doc_id", "file_type", F.col("status").cast("long").alias("status"), "warning", "canonical_name")


def webhook_ttl_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.col("event_type").alias("body"))
    return webhooks.mark_duplicates(events).select("event_id", "accepted")


def webhook_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return events.select(
        "event_id",
        webhooks.sign(F.lit("test-secret"), at, F.col("props")).alias("signature"),
        webhooks.body_preview(F.col("props"), 40).alias("preview"),
    )


_BOXES = with_view(
    "boxes",
    """
RECURSIVE_PLACEHOLDER
SELECT doc_id, string_agg(line, chr(10) ORDER BY rid) AS text FROM
  (SELECT doc_id, rid, string_agg(text, ' ' ORDER BY x, rn) AS line FROM g GROUP BY doc_id, rid) GROUP BY doc_id""",
).replace("WITH boxes AS", "WITH RECURSIVE boxes AS").replace(
    "RECURSIVE_PLACEHOLDER",
    """o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, h, text) AS rn FROM boxes),
g AS (SELECT doc_id, rn, y, x, text, 1 AS rid, greatest(h, 10) AS s, 1 AS n FROM o WHERE rn = 1
      UNION ALL
      SELECT o.doc_id, o.rn, o.y, o.x, o.text, CASE WHEN abs(o.y - g.y) <= g.s / g.n * 0.7::DOUBLE THEN g.rid ELSE g.rid + 1 END,
             CASE WHEN abs(o.y - g.y) <= g.s / g.n * 0.7::DOUBLE THEN g.s + greatest(o.h, 10) ELSE greatest(o.h, 10) END,
             CASE WHEN abs(o.y - g.y) <= g.s / g.n * 0.7::DOUBLE THEN g.n + 1 ELSE 1 END
      FROM g JOIN o ON o.doc_id = g.doc_id AND o.rn = g.rn + 1)""",
)


def _readability(t: str) -> str:
    return (
        f"greatest(0, least(len(regexp_extract_all({t}, '[A-Za-z0-9][A-Za-z0-9''&./-]*')), 200)"
        f" + least(len(list_filter(string_split({t}, chr(10)), lambda x: trim(x) <> '')), 50) * 2 - (length({t}) - length(replace({t}, chr(65533), ''))) * 5)"
    )


def _identity(t: str) -> str:
    words = " + ".join(f"CASE WHEN contains(upper({t}), '{w}') THEN 2 ELSE 0 END" for w in pages.IDENTITY_WORDS)
    found = " + ".join(f"CASE WHEN regexp_matches(upper({t}), '{p}') THEN {w} ELSE 0 END" for p, w in pages.IDENTITY_PATTERNS)
    return f"({words} + {found})"


_SCORES = with_view("page_candidates", f"""x AS (SELECT 1)
SELECT doc_id, {_readability('embedded')}::BIGINT AS readability, {_identity('embedded')}::BIGINT AS identity FROM page_candidates""")
_SELECT = with_view("page_candidates", f"""
r AS (SELECT *, embedded = '' OR (rendered <> '' AND ({_identity('rendered')} > {_identity('embedded')}
        OR ({_identity('rendered')} = {_identity('embedded')} AND {_readability('rendered')} > {_readability('embedded')}))) AS ocr FROM page_candidates)
SELECT doc_id, md5(CASE WHEN ocr THEN rendered ELSE embedded END) AS text_md5,
       CASE WHEN ocr THEN 'rendered_ocr' ELSE 'embedded_pdf_text' END AS source, CASE WHEN ocr THEN ocr_confidence END AS text_confidence FROM r""")
_LIMITS = with_view("doc_pages", """
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, text) AS rn, count(*) OVER (PARTITION BY doc_id) AS total_pages FROM doc_pages)
SELECT doc_id, page_number, substr(text, 1, 120) AS text, total_pages, length(text) > 120 OR total_pages > 3 AS truncated FROM r WHERE rn <= 3""")
_SUFFICIENT = with_view("page_candidates", f"""x AS (SELECT 1)
SELECT doc_id, {_identity('embedded')} >= 4 AND {_readability('embedded')} >= 60 AS embedded,
       coalesce(ocr_confidence >= 0.65, false) AND {_identity('rendered')} >= 4 AND {_readability('rendered')} >= 50 AS rendered FROM page_candidates""")
_METADATA = with_view("doc_pages", """
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, text) AS rn FROM doc_pages),
g AS (SELECT doc_id, count_if(rn <= 3) AS pages_processed, count(*) AS total_pages, bool_or(rn <= 3 AND length(text) > 120) AS cut, bool_or(rn <= 3 AND trim(text) <> '') AS any_text,
             string_agg(page_number || ':' || least(length(text), 120), '|' ORDER BY rn) FILTER (rn <= 3) AS pages FROM r GROUP BY doc_id)
SELECT doc_id, pages_processed::BIGINT AS pages_processed, total_pages, cut OR total_pages > pages_processed AS truncated, pages,
       array_to_string(list_filter([CASE WHEN total_pages > pages_processed THEN 'The document exceeded the configured page limit and was truncated.' END,
         CASE WHEN cut THEN 'Extracted page text exceeded the configured character limit and was truncated.' END,
         CASE WHEN NOT any_text THEN 'No readable text was extracted from the document.' END], lambda x: x IS NOT NULL), '|') AS warnings FROM g""")
_URLS = r"""
WITH u AS (SELECT page_id, trim(url) AS v, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
  regexp_extract(trim(url), '^[^:]+://([^/?#]*)', 1) AS netloc, regexp_extract(trim(url), '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(trim(url), '^[^?#]*(\?[^#]*)', 1) AS query, strpos(trim(url), '#') AS frag FROM pages),
h AS (SELECT *, lower(regexp_extract(netloc, '^([^:]*)', 1)) AS host,
             coalesce(TRY_CAST(regexp_extract(netloc, ':([0-9]+)$', 1) AS INT), CASE scheme WHEN 'https' THEN 443 ELSE 80 END) AS port FROM u),
r AS (SELECT *, CASE WHEN v = '' OR scheme = '' THEN 'invalid' WHEN scheme <> 'https' THEN 'scheme'
  WHEN contains(netloc, '@') OR (frag > 0 AND frag < length(v)) THEN 'credentials_or_fragment' WHEN host = '' THEN 'hostname'
  WHEN port <> 443 THEN 'port' WHEN NOT (suffix(host, '.example.net') OR suffix(host, '.example.com')) THEN 'host_not_allowed' END AS reason FROM h)
SELECT page_id, CASE WHEN reason IS NULL THEN 200 WHEN reason IN ('invalid', 'hostname') THEN 400 ELSE 403 END::BIGINT AS status, reason,
  CASE WHEN reason IS NULL THEN 'https://' || host || CASE path WHEN '' THEN '/' ELSE path END || CASE WHEN length(query) > 1 THEN query ELSE '' END END AS normalized_url
FROM r"""
_FILES = with_view("uploads", r"""
t AS (SELECT *, CASE substr(hex(content), 1, 4) WHEN '2550' THEN 'pdf' WHEN 'FFD8' THEN 'jpeg' WHEN '8950' THEN 'png' WHEN '424D' THEN 'bmp'
                     WHEN '5249' THEN 'webp' WHEN '4949' THEN 'tiff' END AS k,
             CASE lower(regexp_extract(filename, '\.([A-Za-z0-9]{1,8})$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'png' THEN 'png' WHEN 'jpg' THEN 'jpeg' END AS e,
             regexp_extract(filename, '\.([A-Za-z0-9]{1,8})$', 1) AS x FROM uploads)
SELECT doc_id, k AS file_type, CASE WHEN filename = '' THEN 400 WHEN octet_length(content) = 0 THEN 422 WHEN k IS NULL THEN 415
       WHEN (e = 'pdf') <> (k = 'pdf') THEN 415 ELSE 200 END::BIGINT AS status, CASE WHEN x <> '' AND e IS NULL THEN 'unknown_extension' END AS warning,
       CASE WHEN status = 200 THEN regexp_replace(filename, '\.[A-Za-z0-9]{1,8}$', '') || '.' || CASE k WHEN 'jpeg' THEN 'jpg' WHEN 'tiff' THEN 'tif' ELSE k END END AS canonical_name FROM t""")
_DEDUPE = """
WITH RECURSIVE o AS (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT event_id, event_type, rn, t AS last, true AS accepted FROM o WHERE rn = 1
      UNION ALL
      SELECT o.event_id, o.event_type, o.rn, CASE WHEN o.t - g.last > 60000000 THEN o.t ELSE g.last END, o.t - g.last > 60000000
      FROM g JOIN o ON o.event_type = g.event_type AND o.rn = g.rn + 1)
SELECT event_id, accepted FROM g"""

QUERIES = {
    "group_boxes_lines": group_boxes_lines,
    "page_scores": page_scores,
    "select_page_text": select_page_text,
    "page_limits": page_limits,
    "page_sufficiency": page_sufficiency,
    "extraction_metadata": extraction_metadata,
    "url_policy": url_policy,
    "file_signatures": file_signatures,
    "webhook_ttl_dedupe": webhook_ttl_dedupe,
    "webhook_signatures": webhook_signatures,
}
ORACLES = {
    "group_boxes_lines": _BOXES,
    "page_scores": _SCORES,
    "select_page_text": _SELECT,
    "page_limits": _LIMITS,
    "page_sufficiency": _SUFFICIENT,
    "extraction_metadata": _METADATA,
    "url_policy": _URLS,
    "file_signatures": _FILES,
    "webhook_ttl_dedupe": _DEDUPE,
}
