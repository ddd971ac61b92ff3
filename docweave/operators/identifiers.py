"""Typed business identifiers: candidates of all patterns, one per value, type conflicts resolved."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.profiles import GENERIC_PATTERNS, IDENTIFIER_TYPES, REGISTRY_OF_PROFILES, Pattern
from docweave.functions.textnorm import bound, collapse, identifier_key

NO_VALUES = ("NONE", "NULL", "UNKNOWN", "NOTAVAILABLE", "PENDING")


def normalize_value(value: Column, kind: Column, number_type: Column) -> Column:
    """Upper case, plain dashes, tight separators; an EIN as NN-NNNNNNN, ACN and ABN as digits, RC 123 as RC123."""
    text = F.regexp_replace(F.translate(F.upper(value), "–—−", "---"), r"^[\s:#.,;]+|[\s:#.,;]+$", "")
    text = collapse(F.regexp_replace(text, r"\s*([/-])\s*", "$1"))

    def shown(text: Column, digits: Column) -> Column:
        employer = ((kind == "EMPLOYER_IDENTIFIER") | number_type.isin("EIN", "FEIN")) & (F.length(digits) == 9)
        return (
            F.when(employer, F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 7)))
            .when(number_type.isin("ACN", "ABN"), digits)
            .when(F.regexp_like(text, F.lit(r"^(?:RC|BN|IT|LLP|LP)\s+\d{4,12}$")), F.replace(text, F.lit(" "), F.lit("")))
            .otherwise(text)
        )

    return F.nullif(bound(text, lambda t: bound(F.regexp_replace(t, r"\D", ""), lambda d: shown(t, d))), F.lit(""))


def plausible(value: Column) -> Column:
    """4 to 40 letters and digits, with a digit, not a word for nothing."""
    fits = lambda key: F.length(key).between(4, 40) & ~key.isin(*NO_VALUES) & F.regexp_like(key, F.lit(r"\d"))
    return bound(identifier_key(value), fits)


_RAW = "array<struct<k:int,m:string,v:string,p:string,start:int>>"
#: Matches of one pattern as (number of the pattern, match, value, prefix, start). Offsets add up from the text between.
_MATCHES = """if(regexp_like(_text, {r}), aggregate(sequence(0, size(regexp_extract_all(_text, {r}, 0)) - 1),
  named_struct('at', 0, 'found', cast(array() as {raw}),
    'w', regexp_extract_all(_text, {r}, 0), 'v', regexp_extract_all(_text, {r}, {value}), 'p', {prefix}, 'b', split(_text, {r}, -1)),
  (acc, i) -> named_struct('at', acc.at + length(acc.b[i]) + length(acc.w[i]),
    'found', array_append(acc.found, named_struct('k', {k}, 'm', acc.w[i], 'v', acc.v[i], 'p', acc.p[i], 'start', acc.at + length(acc.b[i]))),
    'w', acc.w, 'v', acc.v, 'p', acc.p, 'b', acc.b),
  acc -> acc.found), cast(array() as {raw}))"""


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(k: int, p: Pattern) -> str:
    """SQL of the matches of pattern number k in the column _text; a prefix is put before values that lack it."""
    r = _quoted("(?im)" + p.regex)
    named = "(?<prefix>" in p.regex
    prefix = f"regexp_extract_all(_text, {r}, 1)" if named else f"transform(regexp_extract_all(_text, {r}, 0), x -> '')"
    return _MATCHES.format(r=r, raw=_RAW, k=k, value=2 if named else 1, prefix=prefix)


def identifier_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", country_col: str = "country_code") -> DataFrame:
    """One row per plausible match of the generic patterns and of those of the document's country, on the raw text."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(country_col).alias("_country"))
    known: list[dict] = []
    groups = []

    def numbered(patterns: Iterable[Pattern], country: str | None, first: int) -> str:
        found = []
        for i, p in enumerate(patterns):
            found.append(_matches(len(known), p))
            known.append(
                {
                    "kind": p.kind, "number_type": p.number_type, "country": country, "authority": p.authority, "confidence": p.confidence,
                    "source": "jurisdiction_profile" if country else "generic_fallback", "label": p.label, "order": first + i,
                }
            )
        return f"concat({', '.join(found)})" if found else f"cast(array() as {_RAW})"

    for profile in REGISTRY_OF_PROFILES.list():
        own = numbered((*profile.identifiers, *profile.registration), profile.code, 0)
        groups.append(f"if(_country = {_quoted(profile.code)}, {own}, cast(array() as {_RAW}))")
    groups.append(numbered(GENERIC_PATTERNS, None, 1000))
    schema = "array<struct<kind:string,number_type:string,country:string,authority:string,confidence:double,source:string,label:string,order:int>>"
    table = F.from_json(F.lit(json.dumps(known)), schema)
    # The outer form, since for the inner one the matches would be made once more, in a filter.
    rows = base.select("doc_id", F.explode_outer(F.concat(*map(F.expr, groups))).alias("x")).where("x is not null").select("doc_id", "x.*", F.get(table, F.col("x.k")).alias("of"))
    prefixed = (F.col("p") != "") & ~F.startswith(F.upper("v"), F.upper("p"))
    rows = rows.withColumn("shown", F.when(prefixed, F.concat("p", F.lit(" "), "v")).otherwise(F.col("v")))
    found = rows.select(
        "doc_id",
        F.col("of.kind").alias("identifier_type"),
        F.col("of.number_type").alias("number_type"),
        F.btrim(collapse(F.col("shown")), F.lit(":#.,;")).alias("value"),
        normalize_value(F.col("shown"), F.col("of.kind"), F.col("of.number_type")).alias("normalized_value"),
        F.col("of.country").alias("country_code"),
        F.col("of.authority").alias("issuing_authority"),
        F.col("of.confidence").alias("confidence"),
        F.col("of.source").alias("source"),
        F.col("of.label").alias("pattern_label"),
        "start",
        (F.col("start") + F.length("m")).alias("end"),
        F.col("of.order").alias("order"),
    )
    return found.where(plausible(F.col("normalized_value")))


def resolve_identifiers(candidates: DataFrame) -> DataFrame:
    """The identifiers of each document, one per value: the best (profile, confidence) across types, first of equals.

    Confidence is the highest of the same type; ambiguous says that other types claimed the value too, unless the
    winner is the profile's and beats generic ones by .1. position is the order of the listing, is_primary marks the
    first company, business or registry number.
    """
    key = identifier_key(F.col("normalized_value"))
    own = F.when(F.col("source") == "jurisdiction_profile", 1).otherwise(0)
    keyed = candidates.withColumns({"_key": key, "_own": own})
    best = lambda *by: Window.partitionBy("doc_id", *by).orderBy(F.desc("_own"), F.desc("confidence"), "order", "start")
    same_type = Window.partitionBy("doc_id", "_key", "identifier_type")
    per_type = (
        keyed.withColumns(
            {"_n": F.row_number().over(best("_key", "identifier_type")), "_top": F.max("confidence").over(same_type), "matches": F.count(F.lit(1)).over(same_type)}
        )
        .where("_n = 1")
        .withColumn("confidence", F.col("_top"))
    )
    value = Window.partitionBy("doc_id", "_key")
    ranked = per_type.withColumns({"_n": F.row_number().over(best("_key")), "_types": F.count(F.lit(1)).over(value)})
    rest = F.max(F.when(F.col("_n") > 1, F.col("confidence"))).over(value)
    rivals = F.max(F.when(F.col("_n") > 1, F.col("_own"))).over(value)
    clear = (F.col("_own") == 1) & (F.col("_rivals") == 0) & (F.col("confidence") >= F.col("_rest") + 0.1)
    kinds = F.array(*map(F.lit, IDENTIFIER_TYPES))
    listed = Window.partitionBy("doc_id").orderBy(F.array_position(kinds, F.col("identifier_type")), "number_type", "normalized_value")
    registration = F.col("identifier_type").isin("COMPANY_REGISTRATION_NUMBER", "BUSINESS_REGISTRATION_NUMBER", "REGISTRY_NUMBER", "STATE_FORMATION_IDENTIFIER")
    return (
        ranked.withColumns({"_rest": rest, "_rivals": rivals})
        .where("_n = 1")
        .withColumn("ambiguous", (F.col("_types") > 1) & ~clear)
        .withColumn("position", F.row_number().over(listed))
        .withColumn("is_primary", registration & (F.sum(registration.cast("int")).over(listed) == 1))
        .drop("_key", "_own", "_n", "_top", "_types", "_rest", "_rivals", "order")
    )


def identifier_conflicts(identifiers: DataFrame) -> DataFrame:
    """Designations (type, number type, country, jurisdiction) with two or more values in a document; OTHER is left out.

    jurisdiction is a column of identifiers, if they have it: the subdivision that a document was found to be of.
    """
    keys = ["doc_id", "identifier_type", "number_type", "country_code", *(c for c in ("jurisdiction",) if c in identifiers.columns)]
    return (
        identifiers.where("identifier_type <> 'OTHER'")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("normalized_value")).alias("candidate_values"))
        .where(F.size("candidate_values") > 1)
    )


def identifiers_on_pages(identifiers: DataFrame, pages: DataFrame) -> DataFrame:
    """Add page_number: the first page whose span in the joined text overlaps the identifier's match.

    Pages lie one line feed apart. The page table has doc_id, page_number and text.
    """
    order = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    spans = pages.select(
        "doc_id", "page_number", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)).alias("_from"), F.length("text").alias("_size")
    )
    inside = (F.col("start") < F.col("_from") + F.col("_size")) & (F.col("end") > F.col("_from"))
    joined = identifiers.alias("i").join(spans.alias("p"), (F.col("i.doc_id") == F.col("p.doc_id")) & inside, "left")
    keys = [F.col(f"i.{c}") for c in identifiers.columns]
    return joined.groupBy(*keys).agg(F.min("p.page_number").alias("page_number"))
