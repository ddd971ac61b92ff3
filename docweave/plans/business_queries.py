"""Queries of labels, identifiers and business records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import textnorm as N
from docweave.operators import business, identifiers, labels, parties, records, sections
from docweave.plans.scoring_queries import ORACLES as _SCORING
from docweave.plans.views import view, with_view


def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "raw_values")
    return t.select(
        "doc_id",
        N.normalize_company_name(F.col("name")).alias("company_name"),
        N.normalize_identifier(F.col("ident")).alias("identifier"),
        N.normalize_entity_type(F.col("kind")).alias("entity_type"),
        N.normalize_company_status(F.col("status")).alias("company_status"),
        N.normalize_gender(F.col("sex")).alias("gender"),
        N.confidence_level(F.col("score")).alias("level"),
        N.resolve_currency(F.col("money"), F.col("country")).alias("currency"),
        N.normalize_decimal(F.col("amount")).alias("amount"),
    )


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "raw_dates")
    return t.select("doc_id", N.parse_date(F.col("raw"), F.col("country")).alias("iso"))


def label_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.label_values(view(spark, sf_dir, "business_texts"))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "label", "value", "confidence")


def additional_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.additional_fields(labels.label_values(view(spark, sf_dir, "business_texts")))
    return found.select("doc_id", "label", "value")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "business_texts").withColumns({"country_code": F.expr(_COUNTRY), "document_type": F.lit("CERTIFICATE_OF_INCORPORATION")})


_COUNTRY = "CASE doc_id % 13 WHEN 0 THEN 'NGA' WHEN 1 THEN 'USA' WHEN 6 THEN 'GBR' WHEN 8 THEN 'KEN' WHEN 10 THEN 'GHA' WHEN 12 THEN 'ZAF' END"


def typed_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers.resolve_identifiers(identifiers.identifier_candidates(_known(spark, sf_dir)))
    return found.select(
        "doc_id", "identifier_type", "number_type", "normalized_value", "confidence", "source", "ambiguous", "is_primary",
        F.col("position").cast("long").alias("position"), F.col("start").cast("long").alias("start"),
    )


def identifier_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers.identifier_conflicts(identifiers.resolve_identifiers(identifiers.identifier_candidates(_known(spark, sf_dir))))
    return found.withColumn("candidate_values", F.array_join("candidate_values", "|"))


def core_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = business.core_fields(_known(spark, sf_dir))
    names = ["company_name", "registration_number", "company_status", "incorporation_date", "registered_address", "governing_law", "entity_type"]
    return found.select("doc_id", "registration_number_type", *(F.col(f"{n}.value").alias(n) for n in names))


def business_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _records(spark, sf_dir)
    names = ["legal_company_name", "incorporation_date", "document_issue_date", "company_status", "entity_type", "issuing_authority", "jurisdiction_code"]
    joined = lambda c, part: F.array_join(F.transform(c, lambda x: x[part]), "|").alias(c)
    return found.select(
        "doc_id", "document_type", "country_code", *names, joined("identifiers", "normalized_value"), joined("parties", "name"),
        joined("conflicts", "field"), F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["field"], e["page"].cast("string"))), "|").alias("evidence_pages"), "overall_confidence", "confidence_level", F.array_join("warnings", "|").alias("warnings"),
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.business_records(view(spark, sf_dir, "business_texts"), F.lit("2026-06-03").cast("date"), hint_col="hint")


def summary_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.summary_view(_records(spark, sf_dir)).withColumns(
        {"warnings": F.array_join("warnings", "|"), "conflicts": F.array_join(F.transform("conflicts", lambda c: c["field"]), "|")}
    )


def party_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parties.extract_parties(view(spark, sf_dir, "registers"))
    return found.withColumns({"position": F.col("position").cast("long"), "roles": F.array_join("roles", "|")})


def share_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.share_capital(view(spark, sf_dir, "capital_clauses"))
    shown = lambda c: F.concat_ws("/", c["share_count"], c["share_class"], c["nominal_value_per_share"], c["currency"], c["currency_raw"])
    columns = ["issued_amount", "authorized_amount", "paid_up_amount", "stated_amount", "amount", "currency", "currency_raw", "share_count", "issued_share_count", "share_class"]
    candidates = F.array_join(F.coalesce("currency_candidates", F.expr("cast(array() as array<string>)")), "|")
    none = F.expr("cast(array() as array<string>)")
    classes = F.array_join(F.coalesce(F.transform("share_classes", shown), none), "|")
    return found.select("doc_id", *columns, candidates.alias("currency_candidates"), classes.alias("share_classes"))


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = business.merge_candidates(view(spark, sf_dir, "candidates"))
    return found.select("doc_id", "field", "value", F.round("confidence", 4).alias("confidence"), "conflict")


def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "scores")
    return t.select("doc_id", business.overall_confidence(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("n")).alias("overall"))


def excerpt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every page as an excerpt."""
    pages = view(spark, sf_dir, "doc_pages")
    excerpts = pages.select("doc_id", F.concat(F.lit("p"), "page_number").alias("field"), F.concat(F.lit("zz | "), "text").alias("excerpt"))
    return business.first_pages(excerpts.groupBy("doc_id", "field").agg(F.min("excerpt").alias("excerpt")), pages)


def excerpt_pages_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of every page: its whole text, and all from its middle on."""
    pages = view(spark, sf_dir, "doc_pages")
    middle = F.substring("text", F.floor(F.length("text") / 2).cast("int") + 1, F.length("text"))
    kinds = F.array(F.struct(F.lit("p").alias("kind"), F.col("text").alias("part")), F.struct(F.lit("m").alias("kind"), middle.alias("part")))
    parts = pages.select("doc_id", "page_number", F.explode(kinds).alias("x"))
    excerpts = parts.select(
        "doc_id", F.concat("x.kind", F.col("page_number").cast("string")).alias("field"), F.concat(F.lit("zz | "), "x.part").alias("excerpt")
    )
    return business.first_pages(excerpts, pages)


def objects_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.objects_clauses(view(spark, sf_dir, "business_texts"))
    return found.select("doc_id", F.array_join("objects", "|").alias("objects"))


def share_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.share_capital(_known(spark, sf_dir))
    return found.select("doc_id", "issued_amount", "authorized_amount", "paid_up_amount", "stated_amount", "amount", "currency")


_STRIP = r"regexp_replace({x}, '^[\s:;,.\-_\x22'']+|[\s:;,.\-_\x22'']+$', '', 'g')"
_NAME = rf"""nullif(substr(trim(regexp_replace(regexp_replace(trim(regexp_replace(name, '\s+', ' ', 'g')),
  '(?i)^(?:NAME\s+OF\s+(?:THE\s+)?COMPANY|COMPANY\s+NAME|ENTITY\s+NAME|BUSINESS\s+NAME)\s*[:#-]?\s*', ''),
  '(?i)\s+(?:IS|WAS|HAS\s+BEEN)\s+(?:HEREBY\s+)?(?:INCORPORATED|REGISTERED)\b.*$', ''), ' :;,.-_"'''), 1, 180), '')"""
_VALUES = with_view("raw_values", rf"""x AS (SELECT *, trim(regexp_replace(upper(kind), '[^A-Z0-9]+', ' ', 'g')) AS k,
  trim(regexp_replace(upper(status), '[^A-Z]+', ' ', 'g')) AS s FROM raw_values)
SELECT doc_id, {_NAME} AS company_name,
  nullif(regexp_replace(regexp_replace(trim(upper(ident), ' :;,.#'), '\s*([/-])\s*', '\1', 'g'), '[^A-Z0-9/-]', '', 'g'), '') AS identifier,
  CASE WHEN replace(k, ' ', '') LIKE '%PUBLICCOMPANYLIMITEDBYSHARES%' THEN 'PUBLIC_COMPANY_LIMITED_BY_SHARES'
       WHEN replace(k, ' ', '') LIKE '%LIMITEDLIABILITYCOMPANY%' THEN 'LIMITED_LIABILITY_COMPANY'
       WHEN regexp_matches(k, '\bLTD GTE\b') THEN 'COMPANY_LIMITED_BY_GUARANTEE' WHEN regexp_matches(k, '\bPLC\b') THEN 'PUBLIC_COMPANY_LIMITED_BY_SHARES'
       WHEN regexp_matches(k, '\bPRIVATE COMPANY\b') THEN 'PRIVATE_COMPANY_LIMITED_BY_SHARES' WHEN regexp_matches(k, '\bPARTNERSHIP\b') THEN 'PARTNERSHIP'
       WHEN regexp_matches(k, '\b(LTD|LIMITED)\b') THEN 'LIMITED_COMPANY' WHEN regexp_matches(k, '\b(INC|CORP)\b') THEN 'CORPORATION' END AS entity_type,
  CASE WHEN s LIKE '%LIQUIDATION%' THEN 'IN_LIQUIDATION' WHEN s LIKE '%STRUCK OFF%' THEN 'STRUCK_OFF'
       WHEN regexp_matches(s, '\bINACTIVE\b|\bNOT ACTIVE\b') THEN 'INACTIVE' WHEN regexp_matches(s, '\bACTIVE\b') THEN 'ACTIVE'
       WHEN regexp_matches(s, '\bREGISTERED\b') THEN 'REGISTERED' END AS company_status,
  CASE upper(trim(sex)) WHEN 'M' THEN 'MALE' WHEN 'F' THEN 'FEMALE' WHEN '' THEN NULL ELSE upper(trim(sex)) END AS gender,
  CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.65 THEN 'MEDIUM' WHEN score >= 0.4 THEN 'LOW' ELSE 'REJECT' END AS level,
  CASE money WHEN '$' THEN CASE country WHEN 'USA' THEN 'USD' WHEN 'CAN' THEN 'CAD' WHEN 'AUS' THEN 'AUD' END WHEN 'US $' THEN 'USD' WHEN 'NGN' THEN 'NGN'
       WHEN 'naira' THEN 'NGN' WHEN '€' THEN 'EUR' END AS currency,
  CASE WHEN regexp_matches(replace(amount, ',', ''), '^[0-9]+(\.[0-9]+)?$') THEN regexp_replace(replace(amount, ',', ''), '^0+([0-9])', '\1') END AS amount
FROM x""")
_DATES = with_view("raw_dates", """x AS (SELECT 1)
SELECT doc_id, CASE WHEN m BETWEEN 1 AND 12 THEN strftime(TRY_CAST(y || '-' || lpad(CAST(m AS STRING), 2, '0') || '-' || lpad(CAST(d AS STRING), 2, '0') AS DATE), '%Y-%m-%d') END AS iso
FROM (SELECT doc_id, CAST(y AS STRING) AS y,
  CASE WHEN form = 3 AND country = 'USA' AND a <= 12 THEN a WHEN form = 3 AND b <= 12 THEN b WHEN form = 3 AND a <= 12 THEN a WHEN form = 3 THEN b ELSE b END AS m,
  CASE WHEN form = 3 AND country = 'USA' AND a <= 12 THEN b WHEN form = 3 AND b <= 12 THEN a WHEN form = 3 AND a <= 12 THEN b WHEN form = 3 THEN a ELSE a END AS d FROM raw_dates)""")
_PARTED = "trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))"
for _label in N.JOINED_LABELS:
    _PARTED = f"regexp_replace({_PARTED}, '(?i)^{_label}[:#.\\-_][ :\\-._]*', '{_label} ')"
_LINES = rf"""l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM
  (SELECT doc_id, list_filter(list_transform(string_split(translate(text, '–—', '--'), chr(10)), lambda x: {_PARTED}), lambda x: x <> '') AS lines FROM business_texts))"""
_INLINE = labels.INLINE.replace("'", "''").replace("[-–—]", "-")
_KNOWN = ", ".join(f"('{n}', '{f}', {i})" for i, (n, f) in enumerate(labels.LABEL_FIELDS))
_NORMAL = "trim(regexp_replace(upper({x}), '[^A-Z0-9]+', ' ', 'g'))"


def _label_like(x: str) -> str:
    normal = _NORMAL.format(x=x)
    out = " AND ".join(f"NOT regexp_matches({x}, '{p}')" for p in labels.NO_LABEL_PATTERNS)
    title = f"(regexp_matches({x}, '[A-Z]') AND NOT regexp_matches({x}, '(?:^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]'))"
    return (
        f"({normal} IN (SELECT label FROM known) OR ({normal} NOT IN {labels.NO_LABELS} AND len(regexp_extract_all({x}, '[A-Za-z0-9]+')) BETWEEN 1 AND 7"
        f" AND length({x}) <= 60 AND regexp_matches({x}, '[A-Za-z]') AND ({x} = upper({x}) OR {title}) AND {out}))"
    )


_PAIRS = rf"""{_LINES},
known(label, field, ord) AS (VALUES {_KNOWN}),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt, regexp_matches(line, '{_INLINE}') AS inl FROM l),
p AS (SELECT doc_id, i AS line_no, trim(CASE WHEN inl THEN regexp_extract(line, '{_INLINE}', 1) ELSE line END, ' :#.-') AS label,
             trim(CASE WHEN inl THEN regexp_extract(line, '{_INLINE}', 2) ELSE nxt END, ' :#.-') AS value, CASE WHEN inl THEN 0.76::DOUBLE ELSE 0.66::DOUBLE END AS confidence
      FROM n WHERE inl OR (nxt IS NOT NULL AND {_label_like('line')} AND NOT {_label_like('nxt')} AND NOT regexp_matches(nxt, '{labels.SECTION_HEADING}'))),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(label), lower(value) ORDER BY line_no) AS k FROM p
      WHERE length(label) <= 60 AND length(value) <= 1000 AND regexp_matches(value, '[A-Za-z0-9]') AND length(regexp_replace(label, '[^A-Za-z]', '', 'g')) >= 2 AND lower(label) <> lower(value)),
pairs AS (SELECT doc_id, line_no::BIGINT AS line_no, label, value, confidence FROM v WHERE k = 1)"""
_PAIRS_SQL = with_view("business_texts", _PAIRS + "\nSELECT * FROM pairs")
_CORE = " OR ".join(f"starts_with({_NORMAL.format(x='label')}, '{p}')" for p in labels.CORE_PREFIXES)
_ADDITIONAL = with_view("business_texts", rf"""{_PAIRS},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM pairs
  WHERE NOT EXISTS (SELECT 1 FROM known WHERE starts_with({_NORMAL.format(x='pairs.label')}, known.label)) AND NOT ({_CORE}) AND NOT suffix({_NORMAL.format(x='label')}, ' SHARES')
  AND NOT regexp_matches({_NORMAL.format(x='label')}, '{labels.NOISY_LABEL}') AND NOT regexp_matches({_NORMAL.format(x='value')}, '{labels.NOISY_VALUE}'))
SELECT doc_id, label, value FROM r WHERE k <= 50""")
_KEY = "regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"
_MERGE = with_view("candidates", f"""
p AS (SELECT doc_id, field, max(value) FILTER (parser = 0) AS v0, max(confidence) FILTER (parser = 0) AS s0,
             max(value) FILTER (parser = 1) AS v1, coalesce(max(confidence) FILTER (parser = 1), 0.5::DOUBLE) AS c1,
             max(value) FILTER (parser = 2) AS v2, coalesce(max(confidence) FILTER (parser = 2), 0.5::DOUBLE) AS c2 FROM candidates GROUP BY doc_id, field),
q AS (SELECT *, coalesce({_KEY.format(x='v0')} <> {_KEY.format(x='v1')}, false) AS d1 FROM p),
r AS (SELECT *, CASE WHEN d1 AND c1 > s0 + 0.02::DOUBLE THEN v1 ELSE v0 END AS w, CASE WHEN d1 AND c1 > s0 + 0.02::DOUBLE THEN c1 ELSE s0 END AS s FROM q),
t AS (SELECT *, coalesce({_KEY.format(x='w')} <> {_KEY.format(x='v2')}, false) AS d2 FROM r)
SELECT doc_id, field, CASE WHEN d2 AND c2 > s + 0.02::DOUBLE THEN v2 ELSE w END AS value,
       round(CASE WHEN d2 AND c2 > s + 0.02::DOUBLE THEN c2 ELSE s END, 4) AS confidence, d1 OR d2 AS conflict FROM t""")
_OVERALL = with_view("scores", """x AS (SELECT 1)
SELECT doc_id, round_even(least(greatest(0.25::DOUBLE * coalesce(a, 0) + 0.15::DOUBLE * coalesce(b, 0) + 0.2::DOUBLE * coalesce(c, 0) + 0.2::DOUBLE * coalesce(d, 0)
       + 0.2::DOUBLE * n / 8, 0), 1), 3) AS overall FROM scores""")
_FLAT = r"trim(lower(regexp_replace({x}, '\s+', ' ', 'g')))"
_EXCERPTS = with_view("doc_pages", f"""
e AS (SELECT doc_id, 'p' || page_number AS field, {_FLAT.format(x="min('zz | ' || text)")} AS excerpt FROM doc_pages GROUP BY doc_id, page_number),
f AS (SELECT doc_id, page_number, {_FLAT.format(x='text')} AS body FROM doc_pages)
SELECT e.doc_id, field, min(page_number) AS page_number FROM e JOIN f ON e.doc_id = f.doc_id
WHERE length(trim(split_part(excerpt, '|', 2))) >= 4 AND contains(body, trim(split_part(excerpt, '|', 2))) GROUP BY e.doc_id, field""")
_EXCERPTS_WHOLE = with_view("doc_pages", f"""
f AS (SELECT doc_id, page_number, text, {_FLAT.format(x='text')} AS body FROM doc_pages),
e AS (SELECT doc_id, 'p' || page_number AS field, body AS part FROM f
      UNION ALL SELECT doc_id, 'm' || page_number, {_FLAT.format(x="substr(text, length(text) // 2 + 1)")} FROM f)
SELECT e.doc_id, field, min(page_number) AS page_number FROM e JOIN f ON e.doc_id = f.doc_id WHERE length(part) >= 4 AND contains(body, part) GROUP BY e.doc_id, field""")
_OBJECTS = with_view("business_texts", rf"""{_LINES},
h AS (SELECT doc_id, i FROM l WHERE regexp_matches(line, '(?i)^OBJECTS? OF THE COMPANY$')),
e AS (SELECT l.doc_id, min(l.i) AS i FROM l JOIN h ON l.doc_id = h.doc_id AND l.i > h.i WHERE regexp_matches(line, '(?i)^SHARE CAPITAL') GROUP BY l.doc_id),
o AS (SELECT l.doc_id, string_agg(regexp_replace(line, '^[0-9]+[.]\s*', ''), '|' ORDER BY l.i) AS objects
      FROM l JOIN h ON l.doc_id = h.doc_id AND l.i > h.i JOIN e ON l.doc_id = e.doc_id AND l.i < e.i GROUP BY l.doc_id)
SELECT b.doc_id, coalesce(objects, '') AS objects FROM business_texts b LEFT JOIN o ON b.doc_id = o.doc_id""")
_CAPITAL = with_view("business_texts", """x AS (SELECT doc_id, nullif(regexp_extract(text, 'Authorised Share Capital: NGN ([0-9]+) divided', 1), '') AS a FROM business_texts)
SELECT doc_id, NULL AS issued_amount, regexp_replace(a, '^0+([0-9])', '\\1') AS authorized_amount, NULL AS paid_up_amount, NULL AS stated_amount,
       regexp_replace(a, '^0+([0-9])', '\\1') AS amount, CASE WHEN a IS NOT NULL THEN 'NGN' END AS currency FROM x""")

_PARTIES = with_view("registers", """
w AS (SELECT doc_id, doc_id % 4 AS k, CAST(doc_id AS STRING) AS n, translate(CAST(doc_id AS STRING), '0123456789', 'ABCDEFGHIJ') AS w FROM registers)
SELECT doc_id, 1 AS position, 'Alex ' || w AS name, 'DIRECTOR|SHAREHOLDER' AS roles, 'ACTIVE' AS status, n AS shares, '12.5' AS share_percentage FROM w WHERE k = 0
UNION ALL SELECT doc_id, 2, 'Morgan Sample', 'DIRECTOR', 'INACTIVE', '50', NULL FROM w WHERE k = 0
UNION ALL SELECT doc_id, 3, 'Sample Holdings Limited', 'SHAREHOLDER', NULL, NULL, NULL FROM w WHERE k = 0
UNION ALL SELECT doc_id, 1, 'Example Ada' || w, 'DIRECTOR', 'ACTIVE', NULL, NULL FROM w WHERE k = 1
UNION ALL SELECT doc_id, 2, 'Example Services ' || w || ' Limited', 'SECRETARY', 'CEASED', NULL, NULL FROM w WHERE k = 1
UNION ALL SELECT doc_id, 3, 'Holder Chi', 'SHAREHOLDER', NULL, n, '25' FROM w WHERE k = 1
UNION ALL SELECT doc_id, 1, 'Robin ' || w || ' Sample', 'DIRECTOR|SECRETARY', NULL, NULL, NULL FROM w WHERE k = 3
UNION ALL SELECT doc_id, 2, 'Kim Public', 'TRUSTEE', 'ACTIVE', NULL, NULL FROM w WHERE k = 3""")
_CLASSES = with_view("capital_clauses", """
w AS (SELECT doc_id, doc_id % 5 AS k, doc_id::VARCHAR AS n, (2 * doc_id)::VARCHAR AS n2, CASE country_code WHEN 'USA' THEN 'USD' WHEN 'CAN' THEN 'CAD' END AS own FROM capital_clauses)
SELECT doc_id, CASE k WHEN 1 THEN n WHEN 2 THEN '600' END AS issued_amount, CASE k WHEN 0 THEN n2 WHEN 2 THEN '1000' END AS authorized_amount,
  CASE k WHEN 2 THEN n END AS paid_up_amount, CASE k WHEN 3 THEN '1000' || lpad((doc_id % 1000)::VARCHAR, 3, '0') END AS stated_amount,
  CASE k WHEN 0 THEN n2 WHEN 1 THEN n WHEN 2 THEN '600' WHEN 3 THEN '1000' || lpad((doc_id % 1000)::VARCHAR, 3, '0') END AS amount,
  CASE k WHEN 0 THEN 'USD' WHEN 1 THEN own WHEN 3 THEN own END AS currency, CASE WHEN k = 2 THEN 'EUR' WHEN k = 1 AND own IS NULL THEN '$' END AS currency_raw,
  CASE k WHEN 0 THEN n2 END AS share_count, CASE k WHEN 1 THEN '1' END AS issued_share_count, CASE k WHEN 0 THEN 'ORDINARY' END AS share_class,
  CASE k WHEN 2 THEN 'EUR|USD' ELSE '' END AS currency_candidates,
  CASE k WHEN 0 THEN n || '/ORDINARY/1/USD|' || n || '/PREFERENCE/1/USD' WHEN 1 THEN '1/' || n || '/' || coalesce(own, '$') ELSE '' END AS share_classes FROM w""")

# What the thirteen layouts of business_texts say, stated by layout and not read from the text.
_CORE_FIELDS = with_view("business_texts", """
w AS (SELECT doc_id, doc_id % 13 AS k, doc_id::VARCHAR AS n, lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS day FROM business_texts)
SELECT doc_id,
  CASE k WHEN 0 THEN 'CAC_RC' WHEN 1 THEN 'US_STATE_ENTITY_NUMBER' WHEN 6 THEN 'UK_COMPANY_NUMBER' WHEN 8 THEN 'KENYA_COMPANY_NUMBER' WHEN 10 THEN 'GHANA_REGISTRATION_NUMBER'
         WHEN 12 THEN 'CIPC_ENTERPRISE_NUMBER' END AS registration_number_type,
  CASE k WHEN 0 THEN 'CUSTOMER ' || n || ' GLOBAL SERVICES LIMITED' WHEN 1 THEN 'CUSTOMER ' || n || ' VENTURES LLC' WHEN 2 THEN 'CUSTOMER ' || n || ' HOLDINGS PLC'
         WHEN 3 THEN 'CUSTOMER ' || n || ' FOODS LTD' WHEN 6 THEN 'CUSTOMER ' || n || ' TRADING PLC' WHEN 11 THEN 'CORPORATION DOCUMENT' END AS company_name,
  CASE k WHEN 0 THEN (1000000 + doc_id)::VARCHAR WHEN 1 THEN (7000000 + doc_id)::VARCHAR WHEN 6 THEN (10000000 + doc_id)::VARCHAR WHEN 8 THEN 'PVT-' || lpad(n, 7, '0')
         WHEN 10 THEN 'BN-' || (100000 + doc_id) WHEN 12 THEN (2000 + doc_id % 20) || '/' || (100000 + doc_id) || '/07' END AS registration_number,
  CASE k WHEN 0 THEN 'ACTIVE' WHEN 2 THEN CASE WHEN doc_id % 5 = 0 THEN 'IN_LIQUIDATION' ELSE 'ACTIVE' END WHEN 12 THEN 'STRUCK_OFF' END AS company_status,
  CASE k WHEN 0 THEN '2020-03-' || day END AS incorporation_date,
  CASE k WHEN 0 THEN n || ' Broad Street, Lagos' WHEN 2 THEN n || ' Marina Road Particulars of Directors Annual returns as at 2023-01-' || day END AS registered_address,
  CASE k WHEN 0 THEN 'Companies and Allied Matters Act' WHEN 6 THEN 'Companies Act 2006' END AS governing_law,
  CASE k WHEN 0 THEN 'PRIVATE_COMPANY_LIMITED_BY_SHARES' WHEN 1 THEN 'LIMITED_LIABILITY_COMPANY' WHEN 2 THEN 'PUBLIC_COMPANY_LIMITED_BY_SHARES' WHEN 3 THEN 'LIMITED_COMPANY'
         WHEN 6 THEN 'PUBLIC_COMPANY_LIMITED_BY_SHARES' WHEN 10 THEN 'BUSINESS_NAME' WHEN 11 THEN 'CORPORATION' END AS entity_type
FROM w""")
_EXPECTED_IDENTIFIERS = """
w AS (SELECT doc_id, doc_id % 13 AS k, doc_id::VARCHAR AS n, text FROM business_texts),
x AS (
  SELECT doc_id, 'COMPANY_REGISTRATION_NUMBER' AS identifier_type, 'CAC_RC' AS number_type, 'RC' || (1000000 + doc_id) AS normalized_value, 0.97 AS confidence, 'RC ' || (1000000 + doc_id) AS mark,
         1 AS position, text FROM w WHERE k = 0
  UNION ALL SELECT doc_id, 'TAX_IDENTIFIER', 'NIGERIAN_TIN', (10000000 + doc_id) || '-0001', 0.94, 'Tax Identification Number', 2, text FROM w WHERE k = 0
  UNION ALL SELECT doc_id, 'DOCUMENT_REFERENCE_NUMBER', 'CAC_DOCUMENT_REFERENCE', 'CAC/2020/ABC' || n, 0.88, 'Certificate Number', 3, text FROM w WHERE k = 0
  UNION ALL SELECT doc_id, 'EMPLOYER_IDENTIFIER', 'EIN', '12-' || lpad(n, 7, '0'), 0.98, 'EIN:', 1, text FROM w WHERE k = 1
  UNION ALL SELECT doc_id, 'STATE_FORMATION_IDENTIFIER', 'US_STATE_ENTITY_NUMBER', (7000000 + doc_id)::VARCHAR, 0.91, 'Entity ID', 2, text FROM w WHERE k = 1
  UNION ALL SELECT doc_id, 'DOCUMENT_REFERENCE_NUMBER', 'US_FILING_REFERENCE', 'FN-' || n || '-2021', 0.87, 'Filing Number', 3, text FROM w WHERE k = 1
  UNION ALL SELECT doc_id, 'REGISTRY_NUMBER', 'REGISTRY_NUMBER', 'XY-' || n, 0.82, 'Registry Identifier', 1, text FROM w WHERE k = 4 AND doc_id > 9
  UNION ALL SELECT doc_id, 'COMPANY_REGISTRATION_NUMBER', 'UK_COMPANY_NUMBER', (10000000 + doc_id)::VARCHAR, 0.94, 'Company Number', 1, text FROM w WHERE k = 6
  UNION ALL SELECT doc_id, 'COMPANY_REGISTRATION_NUMBER', 'KENYA_COMPANY_NUMBER', 'PVT-' || lpad(n, 7, '0'), 0.94, 'PVT-', 1, text FROM w WHERE k = 8
  UNION ALL SELECT doc_id, 'TAX_IDENTIFIER', 'KRA_PIN', 'A' || lpad(n, 9, '0') || 'Z', 0.95, 'KRA PIN', 2, text FROM w WHERE k = 8
  UNION ALL SELECT doc_id, 'COMPANY_REGISTRATION_NUMBER', 'GHANA_REGISTRATION_NUMBER', 'BN-' || (100000 + doc_id), 0.94, 'BN-', 1, text FROM w WHERE k = 10
  UNION ALL SELECT doc_id, 'COMPANY_REGISTRATION_NUMBER', 'GHANA_REGISTRATION_NUMBER', 'BN' || (200000 + doc_id), 0.94, 'BN' || (200000 + doc_id), 2, text FROM w WHERE k = 10
  UNION ALL SELECT doc_id, 'COMPANY_REGISTRATION_NUMBER', 'CIPC_ENTERPRISE_NUMBER', (2000 + doc_id % 20) || '/' || (100000 + doc_id) || '/07', 0.97, (2000 + doc_id % 20) || '/', 1, text FROM w WHERE k = 12)"""
_TYPED = with_view("business_texts", _EXPECTED_IDENTIFIERS + """
SELECT doc_id, identifier_type, number_type, normalized_value, confidence::DOUBLE AS confidence, CASE WHEN number_type = 'REGISTRY_NUMBER' THEN 'generic_fallback' ELSE 'jurisdiction_profile' END AS source,
       doc_id % 13 = 10 AND position = 2 AS ambiguous, number_type IN ('CAC_RC', 'US_STATE_ENTITY_NUMBER', 'REGISTRY_NUMBER', 'UK_COMPANY_NUMBER', 'KENYA_COMPANY_NUMBER', 'CIPC_ENTERPRISE_NUMBER')
       OR (doc_id % 13 = 10 AND position = 1) AS is_primary, position::BIGINT AS position, (strpos(text, mark) - 1)::BIGINT AS start FROM x""")
_CLASHES = with_view("business_texts", _EXPECTED_IDENTIFIERS + """
SELECT doc_id, identifier_type, number_type, 'GHA' AS country_code, string_agg(normalized_value, '|' ORDER BY normalized_value) AS candidate_values FROM x
WHERE doc_id % 13 = 10 GROUP BY doc_id, identifier_type, number_type""")

# The whole record: type, country and language by the SQL of their own queries, the rest by layout, put together by the rules of
# the merge: authorities, coverage, confidence, warnings in their order.
_EVIDENCE_OF = {
    0: "legal_company_name entity_type company_status incorporation_date registered_office_address governing_law issuing_authority document_reference_number document_issue_date"
    " identifiers identifiers identifiers",
    1: "legal_company_name entity_type incorporation_date additional_fields additional_fields additional_fields identifiers identifiers identifiers",
    2: "legal_company_name entity_type company_status registered_office_address additional_fields",
    3: "legal_company_name entity_type objects_or_purpose share_capital additional_fields",
    4: "issuing_authority additional_fields additional_fields identifiers", 5: "additional_fields",
    6: "legal_company_name entity_type governing_law issuing_authority additional_fields identifiers", 8: "additional_fields additional_fields identifiers identifiers",
    10: "entity_type issuing_authority additional_fields additional_fields identifiers identifiers", 11: "legal_company_name entity_type issuing_authority",
    12: "company_status company_status additional_fields identifiers",
}
_PAGES_OF = " ".join(f"WHEN {k} THEN '{'|'.join(f'{x}:1' for x in v.split())}'" for k, v in _EVIDENCE_OF.items())
_RECORDS = f"""
WITH c AS ({_SCORING['classify_documents']}), j AS ({_SCORING['detect_jurisdiction']}), l AS ({_SCORING['detect_language']}), f AS ({_CORE_FIELDS}),
i AS (SELECT doc_id, string_agg(normalized_value, '|' ORDER BY position) AS identifiers, max(confidence) AS top FROM ({_TYPED}) GROUP BY doc_id),
r AS (
  SELECT f.doc_id, f.doc_id % 13 AS k, lpad((f.doc_id % 28 + 1)::VARCHAR, 2, '0') AS day, c.document_type, c.confidence AS type_score, c.ambiguous AS type_ambiguous, j.country_code, j.source,
         j.confidence AS country_score, j.registry_name, j.subdivision AS jurisdiction_code, l.code AS language, l.ambiguous AS language_ambiguous, f.company_name AS legal_company_name,
         f.company_status, f.entity_type, f.registered_address, coalesce(i.identifiers, '') AS identifiers, coalesce(i.top, 0) AS top
  FROM f JOIN c ON c.doc_id = f.doc_id JOIN j ON j.doc_id = f.doc_id JOIN l ON l.doc_id = f.doc_id LEFT JOIN i ON i.doc_id = f.doc_id),
a AS (
  SELECT *, CASE k WHEN 0 THEN '2020-03-' || day WHEN 1 THEN '2021-04-' || day END AS incorporation_date, CASE k WHEN 0 THEN '2020-04-' || day END AS document_issue_date,
         CASE k WHEN 0 THEN 'CORPORATE AFFAIRS COMMISSION' WHEN 4 THEN 'SECRETARY OF STATE' WHEN 6 THEN 'COMPANIES HOUSE' WHEN 10 THEN 'Registrar-General''s Department'
                WHEN 11 THEN 'State of Florida Secretary of State' ELSE registry_name END AS issuing_authority,
         CASE k WHEN 0 THEN 0.94 WHEN 1 THEN 0.98 WHEN 2 THEN 0.98 WHEN 3 THEN 0.94 WHEN 6 THEN 0.98 WHEN 11 THEN 0.8 ELSE 0 END::DOUBLE AS name_score FROM r),
o AS (
  SELECT *, round_even(0.25::DOUBLE * type_score + 0.15::DOUBLE * coalesce(country_score, 0) + 0.2::DOUBLE * name_score + 0.2::DOUBLE * top::DOUBLE
      + 0.2::DOUBLE * ((legal_company_name IS NOT NULL)::INT + (entity_type IS NOT NULL)::INT + (incorporation_date IS NOT NULL)::INT + (registered_address IS NOT NULL)::INT
                       + (issuing_authority IS NOT NULL)::INT + (company_status IS NOT NULL)::INT + (identifiers <> '')::INT) / 8, 3) AS overall_confidence FROM a)
SELECT doc_id, document_type, country_code, legal_company_name, incorporation_date, document_issue_date, company_status, entity_type, issuing_authority, jurisdiction_code, identifiers,
  '' AS parties, CASE WHEN k = 10 THEN 'COMPANY_REGISTRATION_NUMBER' ELSE '' END AS conflicts, CASE WHEN k = 4 AND identifiers = '' THEN 'issuing_authority:1|additional_fields:1|additional_fields:1' ELSE CASE k {_PAGES_OF} ELSE '' END END AS evidence_pages, overall_confidence,
  CASE WHEN overall_confidence >= 0.85 THEN 'HIGH' WHEN overall_confidence >= 0.65 THEN 'MEDIUM' WHEN overall_confidence >= 0.4 THEN 'LOW' ELSE 'REJECT' END AS confidence_level,
  array_to_string(list_filter([
    CASE WHEN document_type = 'UNKNOWN_BUSINESS_DOCUMENT' THEN 'The business document type could not be reliably determined; generic extraction was used.'
         WHEN type_ambiguous THEN 'The business document type is ambiguous; review the classification alternatives.' END,
    CASE source WHEN 'document_text_conflict' THEN 'The supplied country hint conflicts with the country indicated by registry evidence.'
                WHEN 'country_hint' THEN 'The country is based only on the caller hint and was not confirmed by OCR text.'
                WHEN 'country_hint_unprofiled' THEN 'The supplied country has no registered extraction profile; generic rules will be used.'
                WHEN 'undetermined' THEN 'The country of incorporation could not be reliably determined.' END,
    CASE WHEN k = 11 THEN 'The state or subnational incorporation jurisdiction is ambiguous.' END,
    CASE WHEN language IS NULL THEN 'The document language could not be reliably determined.' WHEN language_ambiguous THEN 'The document language is ambiguous.' END,
    CASE WHEN k = 2 THEN 'No company parties were found in the status report.' END,
    CASE WHEN legal_company_name IS NULL THEN 'The legal company name could not be reliably extracted.' END,
    CASE WHEN identifiers = '' THEN 'No reliable registration, registry, tax, employer, or document identifier was extracted.' END,
    CASE WHEN issuing_authority IS NULL THEN 'The issuing authority could not be reliably determined.' END], lambda x: x IS NOT NULL), '|') AS warnings
FROM o"""

QUERIES = {
    "parties": party_records,
    "share_classes": share_classes,
    "summary_view": summary_view,
    "objects_clauses": objects_clauses,
    "share_capital": share_capital,
    "normalize_values": normalize_values,
    "parse_dates": parse_dates,
    "label_value_pairs": label_value_pairs,
    "additional_fields_anti": additional_fields,
    "typed_identifiers": typed_identifiers,
    "identifier_conflicts": identifier_conflicts,
    "core_fields": core_fields,
    "business_records": business_records,
    "merge_candidates": merge_candidates,
    "overall_confidence": overall_confidence,
    "excerpt_page_contains_join": excerpt_pages,
    "excerpt_pages_whole": excerpt_pages_whole,
}
ORACLES = {
    "business_records": _RECORDS,
    "core_fields": _CORE_FIELDS,
    "typed_identifiers": _TYPED,
    "identifier_conflicts": _CLASHES,
    "parties": _PARTIES,
    "share_classes": _CLASSES,
    "objects_clauses": _OBJECTS,
    "share_capital": _CAPITAL,
    "normalize_values": _VALUES,
    "parse_dates": _DATES,
    "label_value_pairs": _PAIRS_SQL,
    "additional_fields_anti": _ADDITIONAL,
    "merge_candidates": _MERGE,
    "overall_confidence": _OVERALL,
    "excerpt_page_contains_join": _EXCERPTS,
    "excerpt_pages_whole": _EXCERPTS_WHOLE,
}
