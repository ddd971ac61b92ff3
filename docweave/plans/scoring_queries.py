"""Queries of the scored rule matching, and the same as relational SQL over rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import rules as R
from docweave.functions.profiles import BUILT_IN
from docweave.operators import scoring
from docweave.plans.views import view, with_view


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.classify(view(spark, sf_dir, "business_texts"))
    return found.select(
        "doc_id", "document_type", "confidence", "ambiguous", F.array_join("matched_terms", "|").alias("matched_terms")
    )


def business_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.classify(view(spark, sf_dir, "business_texts"))
    return found.select("doc_id", scoring.looks_like_business_document(found).alias("business"))


def classification_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.classify(view(spark, sf_dir, "business_texts"))
    # The outer form infers no filter on the array, which would be pushed down and score every document again.
    rows = found.select("doc_id", F.posexplode_outer("alternatives").alias("rank", "a")).where("rank is not null")
    return rows.select(
        "doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "a.document_type", "a.confidence", "a.confidence_level"
    )


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.detect_language(view(spark, sf_dir, "business_texts"))
    return found.withColumn("n_matched", F.size("matched").cast("long")).drop("matched")


def detect_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.detect_jurisdiction(view(spark, sf_dir, "business_texts"), hint_col="hint")
    return found.withColumn("matched_terms", F.array_join("matched_terms", "|")).withColumn("subdivision", F.col("subdivision.code"))


def detect_subdivision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.detect_subdivision(view(spark, sf_dir, "business_texts"))
    return found.withColumn("alternatives", F.array_join("alternatives", "|"))


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _signature_rules() -> str:
    rows = []
    for i, s in enumerate(R.SIGNATURES):
        for j, r in enumerate(s.rules):
            # RE2 has no lookahead: the heading rule asks for both patterns.
            one, two = (
                (r.pattern, "") if not r.pattern.startswith("(?=") else [p[5:-1] for p in r.pattern.replace(")(?=", ")\0(?=").split("\0")]
            )
            rows.append(f"({i},{_q(s.kind)},{s.high},{s.least},{j},{_q(r.label)},{_q(one)},{_q(two)},{r.weight},{r.anchor})")
        rows += [f"({i},{_q(s.kind)},{s.high},{s.least},-1,'',{_q(p)},'',-20,false)" for p in s.against]
    return ", ".join(rows)


def _classified() -> str:
    joined = "upper(text)"
    for phrase in R.JOINED_PHRASES:
        joined = f"replace({joined}, '{phrase.replace(' ', '')}', '{phrase}')"
    return f"""
rules(ord, kind, high, least, j, label, p, p2, weight, anchor) AS (VALUES {_signature_rules()}),
t AS (SELECT doc_id, trim(regexp_replace(translate({joined}, '–—', '--'), '\\s+', ' ', 'g')) AS t FROM business_texts),
hits AS (SELECT doc_id, t, rules.*, regexp_matches(t, p, 's') AND (p2 = '' OR regexp_matches(t, p2, 's')) AS hit FROM t, rules),
sums AS (SELECT doc_id, ord, kind, high, least, greatest(0, sum(CASE WHEN hit THEN weight ELSE 0 END)) AS raw,
                bool_or(hit AND anchor) AS anchored, regexp_matches(any_value(t), '{R.COMPANY_CONTEXT}') AS context,
                coalesce(string_agg(label, '|' ORDER BY j) FILTER (hit AND j >= 0), '') AS terms
         FROM hits GROUP BY doc_id, ord, kind, high, least),
conf AS (SELECT *, round(CASE WHEN anchored THEN least(raw::DOUBLE / high, 1.0) ELSE least(raw::DOUBLE / high, 0.58::DOUBLE) END
                         * CASE WHEN context THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END, 4) AS confidence FROM sums),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, raw DESC, ord) AS rn FROM conf),
best AS (SELECT *, kind = '{R.COMBINED}' AND (terms LIKE '%{R.COMBINED_TERMS[0]}%' OR terms LIKE '%{R.COMBINED_TERMS[1]}%') AS combined,
                raw >= least AND confidence >= 0.40 AS known FROM ranked WHERE rn = 1),
others AS (SELECT r.*, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.rn) AS pos FROM ranked r JOIN best b ON r.doc_id = b.doc_id
           WHERE r.rn > 1 AND NOT (b.combined AND r.kind IN {R.COMBINED_PARTS})),
runner AS (SELECT doc_id, max(confidence) AS confidence FROM others WHERE confidence >= 0.40 GROUP BY doc_id)"""


def _classify_sql() -> str:
    return with_view(
        "business_texts",
        f"""{_classified()}
SELECT b.doc_id, CASE WHEN known THEN kind ELSE '{R.UNKNOWN_DOCUMENT}' END AS document_type,
       CASE WHEN known THEN b.confidence ELSE least(0.39::DOUBLE, b.confidence) END AS confidence,
       coalesce(b.confidence - r.confidence <= 0.08::DOUBLE, false) AS ambiguous, terms AS matched_terms
FROM best b LEFT JOIN runner r ON b.doc_id = r.doc_id""",
    )


def _alternatives_sql() -> str:
    return with_view(
        "business_texts",
        f"""{_classified()},
listed AS (SELECT doc_id, kind, confidence, 0 AS pos FROM best WHERE NOT known UNION ALL
           SELECT o.doc_id, o.kind, o.confidence, pos FROM others o JOIN best b ON o.doc_id = b.doc_id
           WHERE pos <= CASE WHEN known THEN 3 ELSE 2 END)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank, kind AS document_type,
       round_even(confidence, 3) AS confidence,
       CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.65 THEN 'MEDIUM' WHEN confidence >= 0.4 THEN 'LOW'
            ELSE 'REJECT' END AS confidence_level
FROM listed WHERE confidence > 0""",
    )


def _language_sql() -> str:
    # RE2's word boundaries are ASCII, so accents go from text and patterns alike.
    plain = str.maketrans("ÉÈÃÇÓÜ", "EEACOU")
    rows = ", ".join(
        f"({_q(code)},{_q(name)},{j},{_q(p.translate(plain))},{w})" for code, name, ps in R.LANGUAGES for j, (p, w) in enumerate(ps)
    )
    return with_view(
        "business_texts",
        f"""
rules(code, name, j, p, w) AS (VALUES {rows}),
t AS (SELECT doc_id, trim(regexp_replace(translate(upper(text), 'ÉÈÃÇÓÜ', 'EEACOU'), '\\s+', ' ', 'g')) AS t FROM business_texts),
s AS (SELECT doc_id, code, name, sum(CASE WHEN regexp_matches(t, p) THEN w ELSE 0 END) / 10 AS score,
             count(*) FILTER (regexp_matches(t, p)) AS n_matched
      FROM t, rules GROUP BY doc_id, code, name),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM s
      WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, code DESC))
SELECT doc_id, CASE WHEN score >= 2 THEN code END AS code, CASE WHEN score >= 2 THEN name END AS name,
       CASE WHEN score < 2 THEN least(score / 5, 0.39::DOUBLE)
            WHEN second > 0 AND score - second < 1 THEN least(0.45::DOUBLE + score / 12, 0.59::DOUBLE)
            ELSE least(0.98::DOUBLE, 0.45::DOUBLE + score / 12) END AS confidence,
       n_matched, score >= 2 AND second > 0 AND score - second < 1 AS ambiguous
FROM r WHERE rn = 1""",
    )


def _markers(states_only: bool) -> str:
    if states_only:
        usa = next(p for p in BUILT_IN if p.code == "USA")
        return ", ".join(
            f"({_q(s.code)},{_q(s.name)},{_q(s.registry)},{s.high},{s.least},{_q(m.pattern)},{m.weight},{_q(m.label)},{i * 10 + j})"
            for i, s in enumerate(usa.subdivisions)
            for j, m in enumerate(s.markers)
        )
    return ", ".join(
        f"({_q(p.code)},{_q(p.name)},{_q(p.registry)},{p.high},{p.least},{j},{_q(m.label)},{_q(m.pattern)},{m.weight})"
        for p in BUILT_IN
        for j, m in enumerate(p.markers)
    )


_DETECTION = "trim(regexp_replace(translate(upper(text), '–—', '--'), '\\s+', ' ', 'g'))"


def _jurisdiction_sql() -> str:
    return with_view(
        "business_texts",
        f"""
rules(code, name, registry, high, least, j, label, p, w) AS (VALUES {_markers(False)}),
states(sc, sn, sr, sh, sl, p, w, label, ord) AS (VALUES {_markers(True)}),
t AS (SELECT doc_id, {_DETECTION} AS t, CASE hint WHEN 'Nigeria' THEN 'NGA' WHEN 'US' THEN 'USA' ELSE upper(hint) END AS requested
      FROM business_texts),
hits AS (SELECT doc_id, states.* FROM t, states WHERE regexp_matches(t, states.p)),
strongest AS (SELECT doc_id, max(w) AS w, arg_max(label, w * 10000 - ord) AS label FROM hits GROUP BY doc_id),
scored AS (SELECT doc_id, sc, sr, round(least(sum(w)::DOUBLE / sh, 1.0), 4) AS conf, list(label ORDER BY ord) AS terms FROM hits
           GROUP BY doc_id, sc, sr, sh, sl HAVING sum(w) >= sl),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, sc DESC) AS rn, max(conf) OVER (PARTITION BY doc_id) - conf <= 0.08::DOUBLE AS near FROM scored),
sub AS (SELECT doc_id, max(sc) FILTER (rn = 1) AS sc, max(sr) FILTER (rn = 1) AS sr, any_value(terms) FILTER (rn = 1) AS terms, count(*) FILTER (near) > 1 AS ambiguous
        FROM placed GROUP BY doc_id),
s AS (SELECT t.doc_id, requested, code, name, registry, high, least,
             sum(CASE WHEN regexp_matches(t, p) THEN rules.w ELSE 0 END)
               + CASE WHEN code = 'USA' THEN coalesce(any_value(strongest.w), 0) ELSE 0 END AS raw,
             list_concat(coalesce(list(rules.label ORDER BY j) FILTER (regexp_matches(t, p)), []),
                         CASE WHEN code = 'USA' AND any_value(strongest.label) IS NOT NULL THEN [any_value(strongest.label)] ELSE [] END) AS terms
      FROM rules, t LEFT JOIN strongest ON t.doc_id = strongest.doc_id
      GROUP BY t.doc_id, requested, code, name, registry, high, least),
r AS (SELECT *, round(least(raw::DOUBLE / high, 1.0), 4) AS conf,
             row_number() OVER (PARTITION BY doc_id ORDER BY round(least(raw::DOUBLE / high, 1.0), 4) DESC, raw DESC, code DESC) AS rn
      FROM s),
b AS (SELECT r.*, raw >= least AS found, a.name AS a_name, a.registry AS a_registry FROM r
      LEFT JOIN (SELECT DISTINCT code, name, registry FROM rules) a ON a.code = r.requested WHERE rn = 1),
e AS (SELECT b.*, sub.sc, sub.sr, sub.terms AS sub_terms, sub.ambiguous FROM b
      LEFT JOIN sub ON sub.doc_id = b.doc_id AND CASE WHEN found THEN code ELSE requested END = 'USA')
SELECT doc_id, CASE WHEN found THEN code ELSE requested END AS country_code, CASE WHEN found THEN name ELSE a_name END AS country_name,
       CASE WHEN sc IS NOT NULL AND NOT ambiguous THEN sr WHEN found THEN registry ELSE a_registry END AS registry_name, sc AS subdivision,
       CASE WHEN found AND requested = code THEN 'country_hint_and_document' WHEN found AND requested <> code THEN 'document_text_conflict'
            WHEN found THEN 'document_text' WHEN a_name IS NOT NULL THEN 'country_hint'
            WHEN requested IS NOT NULL THEN 'country_hint_unprofiled' ELSE 'undetermined' END AS source,
       CASE WHEN found AND requested = code THEN greatest(0.90::DOUBLE, conf) WHEN found THEN conf WHEN a_name IS NOT NULL THEN 0.65::DOUBLE
            WHEN requested IS NOT NULL THEN 0.45::DOUBLE ELSE 0::DOUBLE END AS confidence,
       requested AS requested_country_code, CASE WHEN found THEN code END AS detected_country_code,
       array_to_string(list_concat(CASE WHEN found THEN terms ELSE [] END,
         list_filter(coalesce(sub_terms, []), lambda x: NOT (found AND list_contains(terms, x)))), '|') AS matched_terms,
       coalesce(found AND requested <> code, false) AS conflict
FROM e""",
    )


def _subdivision_sql() -> str:
    return with_view(
        "business_texts",
        f"""
rules(code, name, registry, high, least, p, w, label, ord) AS (VALUES {_markers(True)}),
t AS (SELECT doc_id, {_DETECTION} AS t FROM business_texts),
s AS (SELECT doc_id, code, name, registry, round(least(sum(w)::DOUBLE / high, 1.0), 4) AS confidence
      FROM t, rules WHERE regexp_matches(t, p) GROUP BY doc_id, code, name, registry, high, least HAVING sum(w) >= least),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, code DESC) AS rn,
             max(confidence) OVER (PARTITION BY doc_id) AS top FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS k FROM r WHERE rn > 1 AND top - confidence <= 0.08::DOUBLE),
l AS (SELECT doc_id, string_agg(code, '|' ORDER BY k) FILTER (k <= 3) AS alternatives FROM c GROUP BY doc_id)
SELECT r.doc_id, code, name, registry AS registry_name, confidence, l.doc_id IS NOT NULL AS ambiguous,
       coalesce(alternatives, '') AS alternatives
FROM r LEFT JOIN l ON r.doc_id = l.doc_id WHERE rn = 1""",
    )


QUERIES = {
    "business_documents": business_documents,
    "classify_documents": classify_documents,
    "classification_alternatives": classification_alternatives,
    "detect_language": detect_language,
    "detect_jurisdiction": detect_jurisdiction,
    "detect_subdivision": detect_subdivision,
}
ORACLES = {
    "business_documents": f"SELECT doc_id, document_type <> '{R.UNKNOWN_DOCUMENT}' AND confidence >= 0.4 AS business FROM ({_classify_sql()})",
    "classify_documents": _classify_sql(),
    "classification_alternatives": _alternatives_sql(),
    "detect_language": _language_sql(),
    "detect_jurisdiction": _jurisdiction_sql(),
    "detect_subdivision": _subdivision_sql(),
}
