"""Queries of the passport, licence, voter and bank parsers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import identity, mrz, nin, passport_fields
from docweave.plans.views import view, with_view


def mrz_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mrz.parse_mrz(view(spark, sf_dir, "passports"))


def country_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mrz.country_listing(spark)
    return found.select(
        "country_code",
        "country_name",
        F.array_join("mrz_code_aliases", "|").alias("aliases"),
        F.size("supported_identity_documents").cast("long").alias("n_documents"),
        "passport_personal_number_label",
    )


def drivers_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.parse_drivers_license(view(spark, sf_dir, "licenses"), country_col="country")


def ghana_voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.parse_ghana_voter(view(spark, sf_dir, "ghana_voters"))


def nigeria_voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.parse_nigeria_voter(view(spark, sf_dir, "nigeria_voters"))


def bank_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.parse_bank_statement(view(spark, sf_dir, "statements"))


def nin_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nin.parse_nin(view(spark, sf_dir, "nin_documents")).withColumn("score", F.col("score").cast("long"))


def passport_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passport_fields.visual_fields(view(spark, sf_dir, "data_pages"))


_NIN = with_view("nin_documents", """
w AS (SELECT doc_id, doc_id % 4 AS k, CAST(doc_id AS STRING) AS n, translate(CAST(doc_id AS STRING), '0123456789', 'ABCDEFGHIJ') AS w FROM nin_documents),
f AS (SELECT doc_id, CASE k WHEN 1 THEN 'NIN_CARD' WHEN 2 THEN 'UNKNOWN' ELSE 'NIN_SLIP' END AS document_type,
  CASE k WHEN 0 THEN CAST(10000000000 + doc_id AS STRING) WHEN 1 THEN lpad(n, 4, '1') || '5678901' WHEN 3 THEN CAST(20000000000 + doc_id AS STRING) END AS nin,
  CASE k WHEN 0 THEN 'S7Y0' || n || 'AB12' END AS tracking_id, CASE k WHEN 0 THEN 'SAMPLE' || w WHEN 1 THEN 'TESTER' || w WHEN 3 THEN 'BEFORE' || w END AS surname,
  CASE k WHEN 0 THEN 'HOLDER' WHEN 1 THEN 'ADA' WHEN 3 THEN 'ADA' END AS first_name, CASE k WHEN 0 THEN 'PERSON' END AS middle_name, CAST(NULL AS STRING) AS other_names,
  CASE k WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 3 THEN 'F' END AS gender, CASE k WHEN 1 THEN '01 JAN 1990' WHEN 3 THEN CAST(doc_id % 28 + 1 AS STRING) || '-02-1991' END AS date_of_birth,
  CASE k WHEN 1 THEN '05 MAR 2021' END AS date_issued, CASE k WHEN 0 THEN n || ' Example Street, Garden Area' END AS address,
  CASE k WHEN 0 THEN 'HOLDER PERSON SAMPLE' || w WHEN 1 THEN 'ADA TESTER' || w WHEN 3 THEN 'ADA BEFORE' || w END AS full_name,
  CASE k WHEN 0 THEN 20 WHEN 1 THEN 15 WHEN 2 THEN 0 ELSE 14 END::BIGINT AS score FROM w)
SELECT *, nin IS NOT NULL AS good_enough, nin IS NOT NULL AS success, nin IS NOT NULL AS nin_format_valid FROM f""")
_PAGES = with_view("data_pages", """
w AS (SELECT doc_id, doc_id % 3 AS k, translate(CAST(doc_id AS STRING), '0123456789', 'ABCDEFGHIJ') AS w FROM data_pages)
SELECT doc_id, CASE k WHEN 0 THEN 'SAMPLE' || w END AS surname, CASE k WHEN 0 THEN 'ADA TESTER' END AS given_names,
  CASE k WHEN 0 THEN '20' || CAST(20 + doc_id % 5 AS STRING) || '-01-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') WHEN 1 THEN '2019-02-15' END AS date_of_issue FROM w""")

_DIGIT = (
    "list_sum(list_transform(range(1, length({v}) + 1), lambda i: greatest(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({v}, i, 1)) - 1, 0)"
    " * CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END)) % 10"
)


def _digit(v: str) -> str:
    return f"CAST(CAST({_DIGIT.format(v=v)} AS INT) AS STRING)"


_LINE2 = r"'^[A-Z0-9<]{9}[0-9][A-Z]{3}[0-9]{6}[0-9][MF<][0-9]{6}[0-9][A-Z0-9<]{14}[0-9][0-9]$'"

# The view has two zone lines a document, so that the pair is given; names hold no digits.
_MRZ = with_view(
    "passports",
    f"""
a AS (SELECT doc_id, rpad(substr(regexp_replace(split_part(text, chr(10), 2), '[^A-Z0-9<]', '', 'g'), 1, 44), 44, '<') AS l1,
             rpad(substr(regexp_replace(split_part(text, chr(10), 3), '[^A-Z0-9<]', '', 'g'), 1, 44), 44, '<') AS l2 FROM passports),
b AS (SELECT doc_id, substr(l1, 1, 5) || translate(substr(l1, 6), '015', 'OIS') AS l1, l2,
             CASE WHEN substr(l1, 3, 3) IN ('GHA', 'GH4', '6HA') OR substr(l2, 11, 3) = 'GHA' THEN 'GHA'
                  WHEN substr(l1, 3, 3) IN ('NGA', 'NGE', 'NG4', 'N6A', 'N64', 'NGR') OR substr(l2, 11, 3) = 'NGA' THEN 'NGA' END AS profile FROM a),
c AS (SELECT doc_id, profile, CASE WHEN profile IS NULL THEN l1 ELSE substr(l1, 1, 2) || profile || substr(l1, 6) END AS l1,
             regexp_replace(l2, '^[68]', 'B') AS l2, regexp_matches(l2, {_LINE2}) AS shape2 FROM b),
alts(ch, ord, alt) AS (VALUES ('2',1,'5'),('5',1,'2'),('5',2,'S'),('8',1,'B'),('8',2,'3'),('B',1,'8'),('B',2,'6'),('0',1,'O'),('0',2,'D'),
                              ('O',1,'0'),('6',1,'B'),('6',2,'8'),('S',1,'5')),
tries AS (SELECT doc_id, i, ord, substr(l2, 1, i - 1) || alt || substr(l2, i + 1, 9 - i) AS num, substr(l2, 10, 1) AS d
          FROM (SELECT *, unnest(range(1, 10)) AS i FROM c) x JOIN alts ON substr(l2, i, 1) = ch),
fits AS (SELECT doc_id, arg_min(num, i * 10 + ord) AS num FROM tries WHERE {_digit('num')} = d AND regexp_matches(num, '^[A-Z]') GROUP BY doc_id),
r AS (SELECT c.doc_id, profile, l1, shape2 AND regexp_matches(l1, '^[A-Z<][A-Z<][A-Z][A-Z][A-Z].*<<') AS shape,
             CASE WHEN {_digit("substr(l2, 1, 9)")} = substr(l2, 10, 1) THEN l2 ELSE coalesce(num, substr(l2, 1, 9)) || substr(l2, 10) END AS l2
      FROM c LEFT JOIN fits ON c.doc_id = fits.doc_id),
v AS (SELECT *, substr(l2, 1, 10) || substr(l2, 14, 7) || substr(l2, 22, 22) AS whole, replace(substr(l2, 29, 14), '<', '') AS personal,
             trim(translate(split_part(substr(l1, 6), '<<', 1), '<', ' ')) AS s, trim(translate(split_part(substr(l1, 6), '<<', 2), '<', ' ')) AS g FROM r),
k AS (SELECT *, regexp_matches(l2, {_LINE2}) AND {_digit("substr(l2, 1, 9)")} = substr(l2, 10, 1) AND {_digit("substr(l2, 14, 6)")} = substr(l2, 20, 1)
                AND {_digit("substr(l2, 22, 6)")} = substr(l2, 28, 1) AND {_digit("substr(l2, 29, 14)")} = substr(l2, 43, 1)
                AND {_digit("whole")} = substr(l2, 44, 1) AS digits,
             NOT (coalesce(profile, '') = 'NGA' AND NOT regexp_matches(personal, '^[0-9]*$')) AS nin FROM v),
o AS (SELECT *, shape AND digits AND nin AS ok FROM k)
SELECT doc_id, ok AS success,
       CASE WHEN ok THEN NULL WHEN NOT shape THEN 'invalid or incomplete zone' WHEN NOT digits THEN 'check digits do not fit' ELSE 'invalid personal number' END AS reason,
       CASE WHEN ok THEN replace(substr(l1, 1, 2), '<', '') END AS document_type,
       CASE WHEN ok THEN coalesce(profile, replace(substr(l1, 3, 3), '<', '')) END AS issuing_country,
       CASE WHEN ok THEN CASE profile WHEN 'GHA' THEN 'Ghana' WHEN 'NGA' THEN 'Nigeria' END END AS country_name,
       CASE WHEN ok THEN s END AS surname, CASE WHEN ok THEN g END AS given_names,
       CASE WHEN ok THEN replace(substr(l2, 1, 9), '<', '') END AS passport_number, CASE WHEN ok THEN substr(l2, 11, 3) END AS nationality,
       CASE WHEN ok THEN CASE WHEN CAST(substr(l2, 14, 2) AS INT) > 40 THEN '19' ELSE '20' END || substr(l2, 14, 2) || '-' || substr(l2, 16, 2) || '-' || substr(l2, 18, 2) END AS date_of_birth,
       CASE WHEN ok THEN CASE substr(l2, 21, 1) WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE substr(l2, 21, 1) END END AS gender,
       CASE WHEN ok THEN CASE WHEN CAST(substr(l2, 22, 2) AS INT) > 40 THEN '19' ELSE '20' END || substr(l2, 22, 2) || '-' || substr(l2, 24, 2) || '-' || substr(l2, 26, 2) END AS date_of_expiry,
       CASE WHEN ok THEN personal END AS personal_number,
       CASE WHEN ok THEN substr(rpad(substr(l1, 1, 5) || rtrim(replace(s, ' ', '<') || '<<' || replace(g, ' ', '<'), '<'), 44, '<'), 1, 44) END AS line1,
       CASE WHEN ok THEN l2 END AS line2
FROM o""",
)

_LISTING = """
SELECT * FROM (VALUES ('GHA', 'Ghana', '6HA|GH4|GHA', 5::BIGINT, 'personal_number'), ('NGA', 'Nigeria', 'N64|N6A|NG4|NGA|NGE|NGR', 6::BIGINT, 'nin'))
  AS t(country_code, country_name, aliases, n_documents, passport_personal_number_label)
"""


def _first(p: str, col: str = "text") -> str:
    return f"nullif(trim(regexp_replace(regexp_extract({col}, '(?i){p}', 1), '\\s+', ' ', 'g'), ' :;,.|-'), '')"


_DATE = "([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})"
_GENDER = f"CASE upper({_first(chr(92) + 'b(?:SEX|GENDER)[:' + chr(92) + 's-]*(MALE|FEMALE|M|F)' + chr(92) + 'b')})"
_GENDER_SQL = _GENDER + " WHEN 'M' THEN 'MALE' WHEN 'F' THEN 'FEMALE' WHEN 'MALE' THEN 'MALE' WHEN 'FEMALE' THEN 'FEMALE' END"

_LICENSES = with_view(
    "licenses",
    rf"""
f AS (SELECT doc_id, country,
  CASE WHEN country = 'NGA' THEN {_first(r"\b(?:DLN|LICENSE\s*(?:NO|NUMBER)|LICENCE\s*(?:NO|NUMBER))[:\s-]*([A-Z0-9-]{6,30})")}
       ELSE {_first(r"\b(?:LICENSE\s*(?:NO|NUMBER)|LICENCE\s*(?:NO|NUMBER))[:\s-]*([A-Z0-9-]{6,30})")} END AS license_number,
  {_first(r"\b(?:NAME|FULL\s*NAME|NAMES)[:\s-]*([A-Z][A-Z ,''-]{3,80})")} AS full_name,
  {_first(r"\b(?:DOB|DATE\s*OF\s*BIRTH)[:\s-]*" + _DATE)} AS date_of_birth,
  {_first(r"\b(?:ISSUE\s*DATE|DATE\s*ISSUED)[:\s-]*" + _DATE)} AS issue_date,
  {_first(r"\b(?:EXPIRY\s*DATE|EXPIRES|EXP)[:\s-]*" + _DATE)} AS expiry_date,
  {_first(r"\b(?:CLASS|CATEGORY)[:\s-]*([A-Z0-9]{1,4})\b")} AS license_class,
  {_GENDER_SQL} AS gender,
  CASE WHEN country = 'NGA' THEN {_first(r"\bADDRESS[:\s-]*([A-Z0-9 ,''#./-]{5,120})")} END AS address
  FROM licenses WHERE country IN ('NGA', 'GHA'))
SELECT *, license_number IS NOT NULL OR full_name IS NOT NULL AS success, NULL AS message FROM f
UNION ALL
SELECT doc_id, country, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, 'Driver''s license OCR is not implemented for ' || country
FROM licenses WHERE country NOT IN ('NGA', 'GHA')""",
)

_VOTERS = with_view(
    "ghana_voters",
    rf"""
f AS (SELECT doc_id,
  {_first(r"\b(?:VOTER\s*ID|ID\s*NO|CARD\s*NO)[:\s-]*([A-Z0-9-]{6,30})")} AS voter_id,
  {_first(r"\b(?:NAME|FULL\s*NAME)[:\s-]*([A-Z][A-Z ,''-]{3,80})")} AS full_name,
  {_first(r"\b(?:DATE\s*OF\s*BIRTH|DOB)[:\s-]*" + _DATE)} AS date_of_birth,
  {_GENDER_SQL} AS gender,
  {_first(r"\bPOLLING\s*STATION[:\s-]*([A-Z0-9 ,''-]{3,80})")} AS polling_station
  FROM ghana_voters)
SELECT *, voter_id IS NOT NULL OR full_name IS NOT NULL AS success FROM f""",
)

_SPAN = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{1,2}-[A-Za-z]{3,9}-[0-9]{4}"
_GREY = r"TIME\s+PERIOD:?\s+ACCOUNT\s+NUMBER\s+BANK\s+NAME\s+[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\s*(?:to|→)\s*[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\s+"


def _raw(p: str, g: int = 1, col: str = "text") -> str:
    return f"nullif(trim(regexp_replace(regexp_extract({col}, '(?i){p}', {g}), '[ \\t\\r\\f\\v]+', ' ', 'g')), '')"


_STATEMENTS = with_view(
    "statements",
    rf"""
l AS (SELECT doc_id, text, regexp_replace(text, '\s+', ' ', 'g') AS flat,
             list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM statements),
h AS (SELECT *, list_position(list_transform(lines, lambda x: replace(upper(x), ' ', '') = 'BANKSTATEMENT'), true) AS head FROM l),
f AS (SELECT doc_id, flat, lines, head,
  {_raw(r"(?:Account\s*(?:No|Number))\s*[:\-]?\s*([0-9xX*]{10,})")} AS acc, {_raw(_GREY + r"([0-9xX*]{5,20})\s+", 1, "flat")} AS grey,
  {_raw(r"(?:Account\s*Name)\s*[:\-]?\s*([A-Z][A-Z .''\-]{3,90})")} AS name1,
  coalesce(upper({_raw(r"\bHello\s+([A-Z][A-Z\s.''\-]{3,90}),")}),
           CASE WHEN head > 0 AND len(lines) > head THEN trim(regexp_replace(regexp_replace(upper(lines[head + 1]), '(SAMPLE|CUSTOMER|HOLDER|PERSON|TEST)', ' \1 ', 'g'), '[ \t]+', ' ', 'g')) END) AS name2,
  {_raw(r"(?:Opening\s*Balance)\s*[:\-]?\s*(?:NGN|₦)?\s*(-?[0-9,]+\.[0-9]{2})")} AS opening_balance,
  {_raw(r"(?:Closing\s*Balance|Balance\s+as\s+at\s+[A-Za-z]+\s+[0-9]{1,2},\s*[0-9]{4})\s*[:\-]?\s*(?:NGN|₦)?\s*(-?[0-9,]+\.[0-9]{2})")} AS closing_balance,
  {_raw("(" + _SPAN + r")\s*(?:to|→)\s*(" + _SPAN + ")", 1)} AS start_date, {_raw("(" + _SPAN + r")\s*(?:to|→)\s*(" + _SPAN + ")", 2)} AS end_date,
  {_raw(_GREY + r"[0-9xX*]{5,20}\s+([A-Za-z][A-Za-z\s&.\-]+?)\s+CURRENCY", 1, "flat")} AS grey_bank
  FROM h)
SELECT doc_id, coalesce(acc, grey) AS account_number,
  CASE WHEN name2 IS NOT NULL AND (name1 IS NULL OR (name2 LIKE '% %' AND name1 NOT LIKE '% %')
            OR len(string_split(name2, ' ')) > len(string_split(name1, ' '))) THEN name2 ELSE name1 END AS account_name,
  opening_balance, closing_balance, start_date, end_date,
  coalesce(grey_bank, CASE WHEN upper(flat) LIKE '%UNITED BANK FOR AFRICA%' OR regexp_matches(flat, '(?i)\bUBA\b') THEN 'United Bank for Africa' END) AS bank_name,
  CASE WHEN head > 0 AND regexp_matches(lines[head + 2], '^[0-9]+SAMPLESTREETLAGOS$')
       THEN replace(lines[head + 2], 'SAMPLESTREETLAGOS', ' SAMPLE STREET LAGOS') END AS address
FROM f""",
)

_NIGERIA = with_view("nigeria_voters", """
w AS (SELECT doc_id, translate(CAST(doc_id AS STRING), '0123456789', 'ABCDEFGHIJ') AS w, lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') AS d FROM nigeria_voters)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '24-03-07-012' END AS code, CASE WHEN doc_id % 4 <> 0 THEN '90F5B0C2' || lpad(CAST(doc_id AS STRING), 8, '0') END AS vin,
  CASE WHEN doc_id % 2 = 0 THEN 'LAGOS MAINLAND WARD' ELSE 'CROSS RIVER CALABAR' END
    || CASE WHEN doc_id % 5 = 0 THEN ' DOE' || w || '. 1SAMPLEHOLDER' || w ELSE '' END AS delimitation,
  CASE WHEN doc_id % 5 <> 0 THEN 'DOE' || w || ', SAMPLE HOLDER ' || w END AS full_name, CASE WHEN doc_id % 2 = 0 THEN d || '-12-1990' ELSE d || '/12/1990' END AS date_of_birth,
  CASE WHEN doc_id % 2 = 1 THEN 'FEMALE' END AS gender, 'TRADER' AS occupation, CAST(doc_id AS STRING) || ' SAMPLE STREET, LAGOS' AS address,
  doc_id % 4 <> 0 OR doc_id % 5 <> 0 AS success FROM w""")

QUERIES = {
    "nin_documents": nin_documents,
    "passport_pages": passport_pages,
    "nigeria_voters": nigeria_voters,
    "mrz_records": mrz_records,
    "country_listing": country_listing,
    "drivers_licenses": drivers_licenses,
    "ghana_voters": ghana_voters,
    "bank_statements": bank_statements,
}
ORACLES = {
    "nin_documents": _NIN,
    "passport_pages": _PAGES,
    "nigeria_voters": _NIGERIA,
    "mrz_records": _MRZ,
    "country_listing": _LISTING,
    "drivers_licenses": _LICENSES,
    "ghana_voters": _VOTERS,
    "bank_statements": _STATEMENTS,
}
