"""Whole records of company documents: all parsers merged, judged and summarised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import rules as R
from docweave.functions.literals import may_match
from docweave.functions.profiles import REGISTRY_OF_PROFILES
from docweave.functions.textnorm import (
    bound,
    collapse,
    confidence_level,
    none_if_empty,
    normalize_business_text,
    normalize_company_name,
    normalize_company_status,
    normalize_entity_type,
    parse_date,
    unique_clean,
)
from docweave.operators.business import COVERAGE, authorities_compatible, core_fields, overall_confidence
from docweave.operators.identifiers import identifier_candidates, identifier_conflicts, resolve_identifiers
from docweave.operators.labels import additional_fields, canonical_field, label_values
from docweave.operators.parties import extract_parties
from docweave.operators.provenance import flat_pages, joined_text, normal_pages, page_of_parts, page_of_phrase, page_of_span, page_spans
from docweave.operators.scoring import classify, detect_jurisdiction, detect_language, jurisdiction_warnings
from docweave.operators.sections import objects_clauses, share_capital
from docweave.session import materialize

# The fields with their column among the core fields, authorities, roles, sentences for reviewers.
FIELDS = {
    "legal_company_name": "company_name", "trading_name": None, "entity_type": "entity_type", "company_status": "company_status",
    "incorporation_date": "incorporation_date", "registration_date": "registration_date", "document_issue_date": "document_date",
    "registered_office_address": "registered_address", "principal_business_address": "head_office_address",
    "governing_law": "governing_law", "contact_email": "contact_email", "contact_phone": "contact_phone", "issuing_authority": None,
    "document_reference_number": None, "country_of_incorporation": None, "jurisdiction_of_incorporation": None,
}
LABELLED = (
    "legal_company_name", "trading_name", "principal_business_address", "issuing_authority", "document_reference_number",
    "country_of_incorporation", "jurisdiction_of_incorporation", "document_issue_date", "incorporation_date", "company_status",
    "entity_type", "business_activities",
)
AUTHORITIES = (
    r"(?i)\bCORPORATE\s+AFFAIRS\s+COMMISSION\b", r"(?i)\bOFFICE\s+OF\s+THE\s+REGISTRAR\s+OF\s+COMPANIES\b",
    r"(?i)\bREGISTRAR[ -]GENERAL(?:'S)?\s+DEPARTMENT\b", r"(?i)\bCOMPANIES\s+HOUSE\b",
    r"(?i)\b(?:[A-Z][A-Z ]{2,30}\s+)?SECRETARY\s+OF\s+STATE\b", r"(?i)\bAUSTRALIAN\s+SECURITIES\s+AND\s+INVESTMENTS\s+COMMISSION\b",
    r"(?i)\bCOMPANIES\s+AND\s+INTELLECTUAL\s+PROPERTY\s+COMMISSION\b",
)
AUTHORITY_LINE = r"\b(?:REGISTRY|REGISTRAR(?:\s+OF\s+COMPANIES)?|SECRETARY\s+OF\s+STATE|COMMISSION)\b$"
NO_AUTHORITY = r"IDENTIFIER|NUMBER|REFERENCE"
ROLE_LISTS = {
    "directors": ("DIRECTOR",), "shareholders": ("SHAREHOLDER", "SUBSCRIBER"),
    "beneficial_owners": ("BENEFICIAL_OWNER", "PERSON_WITH_SIGNIFICANT_CONTROL"),
}
COMPANY_NUMBERS = ("COMPANY_REGISTRATION_NUMBER", "BUSINESS_REGISTRATION_NUMBER", "STATE_FORMATION_IDENTIFIER", "REGISTRY_NUMBER")
SAID = {
    "type_unknown": "The business document type could not be reliably determined; generic extraction was used.",
    "type_ambiguous": "The business document type is ambiguous; review the classification alternatives.",
    "type_hint_unsupported": "The document type hint is unsupported and was ignored.",
    "type_hint_only": "The document type is based only on the caller hint and was not confirmed by OCR text.",
    "type_hint_conflict": "The document type hint conflicts with the type detected from OCR text.",
    "state_hint_invalid": "The jurisdiction hint is invalid for the selected country and was ignored.",
    "state_hint_conflict": "The jurisdiction hint conflicts with the state or province detected from OCR text.",
    "state_hint_only": "The incorporation jurisdiction is based only on the caller hint.",
    "language_unknown": "The document language could not be reliably determined.",
    "language_ambiguous": "The document language is ambiguous.",
    "no_objects": "No objects or purpose clauses were found in the memorandum.",
    "no_parties": "No company parties were found in the status report.",
    "name": "The legal company name could not be reliably extracted.",
    "identifiers": "No reliable registration, registry, tax, employer, or document identifier was extracted.",
    "authority": "The issuing authority could not be reliably determined.",
    "formed_in_future": "The extracted incorporation or registration date is in the future.",
    "issued_in_future": "The extracted document issue date is in the future.",
    "formed_after_issue": "The incorporation or registration date is later than the document issue date.",
    "day_or_month": "A numeric date is day/month ambiguous; review its field evidence.",
}
MEMORANDUM, STATUS_REPORT = "MEMORANDUM_AND_ARTICLES_OF_ASSOCIATION", "COMPANY_STATUS_REPORT"
HINT_CONFIDENCE, STATE_HINT_CONFIDENCE, MARGIN = 0.55, 0.60, 0.02
_EVIDENCE = "array<struct<field:string,value:string,method:string,confidence:double,page:int,text:string,selected:boolean>>"


def key(value: Column) -> Column:
    """What makes two texts the same value: letters and digits."""
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def merge_field(core: Column, labelled: Column, authority: bool = False) -> Column:
    """(value, confidence, method, excerpt, conflict) of two candidates: the first unless the other differs and is MARGIN better.

    Of authorities that are compatible the better one counts, by whatever margin, and they are no conflict.
    """
    differs = F.coalesce(key(core["value"]) != key(labelled["value"]), F.lit(False))
    same = F.lit(False) if not authority else authorities_compatible(core["value"], labelled["value"])
    margin = F.when(same, 0.0).otherwise(MARGIN)
    second = core["value"].isNull() | (differs & (labelled["confidence"] > core["confidence"] + margin))
    part = lambda c: F.when(second, labelled[c]).otherwise(core[c]).alias(c)
    return F.struct(part("value"), part("confidence"), part("method"), part("excerpt"), (differs & ~same).alias("conflict"))


def known_value(field: str, value: Column, country: Column) -> Column:
    """A labelled value in the form its field has."""
    if field in ("legal_company_name", "trading_name"):
        return normalize_company_name(value)
    if field in ("document_issue_date", "incorporation_date"):
        return parse_date(value, country)
    if field == "company_status":
        return normalize_company_status(value)
    if field == "entity_type":
        return normalize_entity_type(value)
    if field == "business_activities":
        return none_if_empty(collapse(value))
    return none_if_empty(F.btrim(collapse(value), F.lit(" :;,.-")))


def printed_authority(text: Column) -> Column:
    """An authority named in the text, else one of its first 20 lines that ends as an authority's name does."""
    like = lambda x: F.regexp_like(F.upper(x), F.lit(AUTHORITY_LINE)) & ~F.regexp_like(F.upper(x), F.lit(NO_AUTHORITY)) & F.length(x).between(4, 100)

    def of(normal: Column, upper: Column) -> Column:
        named = [none_if_empty(collapse(F.regexp_extract(F.when(may_match(upper, p), normal), p, 0))) for p in AUTHORITIES]
        lines = F.slice(F.filter(F.split(normal, "\n"), lambda x: x != ""), 1, 20)
        return F.coalesce(*named, collapse(F.get(F.filter(lines, like), F.lit(0))))

    return bound(normalize_business_text(text), lambda normal: bound(F.upper(normal), lambda upper: of(normal, upper)))


def reconcile_type(kind: Column, confidence: Column, hint: Column) -> Column:
    """(document_type, confidence, source, warning): a hint decides only where the text tells nothing."""
    asked = none_if_empty(F.btrim(F.regexp_replace(F.upper(hint), "[^A-Z0-9]+", "_"), F.lit("_")))
    known = F.coalesce(asked.isin(*(s.kind for s in R.SIGNATURES)), F.lit(False))
    unknown = kind == R.UNKNOWN_DOCUMENT
    warning = (
        F.when(asked.isNull(), F.lit(None).cast("string"))
        .when(~known, SAID["type_hint_unsupported"])
        .when(unknown, SAID["type_hint_only"])
        .when(asked != kind, SAID["type_hint_conflict"])
    )
    takes = known & unknown
    return F.struct(
        F.when(takes, asked).otherwise(kind).alias("document_type"),
        F.when(takes, HINT_CONFIDENCE).otherwise(confidence).alias("confidence"),
        F.when(takes, "request_hint").otherwise("document_text").alias("source"),
        warning.alias("warning"),
    )


def reconcile_subdivision(found: Column, country: Column, hint: Column) -> Column:
    """(code, name, registry_name, confidence, source, ambiguous, warning): a valid hint counts where none was found."""
    plain = lambda x: F.trim(F.regexp_replace(F.upper(x), "[^A-Z0-9]+", " "))
    asked = none_if_empty(plain(hint))
    rows = {}
    for p in REGISTRY_OF_PROFILES.list():
        for s in p.subdivisions:
            for name in (s.code, s.name, *s.aliases):
                words = " ".join("".join(c if c.isalnum() else " " for c in name.upper()).split())
                rows.setdefault(f"{p.code}:{words}", F.struct(F.lit(s.code).alias("code"), F.lit(s.name).alias("name"), F.lit(s.registry).alias("registry_name")))
    table = F.create_map(*(x for k, v in rows.items() for x in (F.lit(k), v)))
    wanted = F.try_element_at(table, F.concat_ws(":", country, asked))
    warning = (
        F.when(asked.isNull(), F.lit(None).cast("string"))
        .when(wanted.isNull(), SAID["state_hint_invalid"])
        .when(found["code"] != wanted["code"], SAID["state_hint_conflict"])
        .when(found["code"].isNull(), SAID["state_hint_only"])
    )
    part = lambda c: F.coalesce(found[c], wanted[c]).alias(c)
    return F.struct(
        part("code"),
        part("name"),
        part("registry_name"),
        F.coalesce(found["confidence"], F.when(wanted.isNotNull(), STATE_HINT_CONFIDENCE)).alias("confidence"),
        F.when(found["ambiguous"], "document_text_ambiguous").when(found["code"].isNotNull(), "document_text").when(wanted.isNotNull(), "request_hint").alias("source"),
        F.coalesce(found["ambiguous"], F.lit(False)).alias("ambiguous"),
        warning.alias("warning"),
    )


def _lists(docs: DataFrame) -> DataFrame:
    """Per document (column _row): labelled pairs, additional fields, parties, identifiers and their conflicts, as arrays."""
    named = label_values(docs, "_row", "text")
    by_line = named.withColumn("field", canonical_field(F.col("label")))
    array = lambda *columns: F.array_sort(F.collect_list(F.struct(*columns)))
    pairs = by_line.where("field is not null").groupBy("doc_id").agg(array("line_no", "field", "value", "excerpt", "confidence").alias("pairs"))
    others = additional_fields(named).groupBy("doc_id").agg(array("rank", "label", "value", "confidence", "excerpt").alias("additional_fields"))
    found = extract_parties(docs, "_row", "text")
    parties = found.groupBy("doc_id").agg(array("position", "name", "roles", "status", "shares", "share_percentage").alias("parties"))
    numbers = resolve_identifiers(identifier_candidates(docs, "_row", "text"))
    columns = ["identifier_type", "number_type", "value", "normalized_value", "country_code", "issuing_authority", "confidence", "source", "is_primary", "pattern_label"]
    identifiers = numbers.groupBy("doc_id").agg(array("position", *columns, "start", "end", "ambiguous").alias("identifiers"))
    clashes = identifier_conflicts(numbers).groupBy("doc_id").agg(
        array(F.col("identifier_type").alias("field"), F.col("candidate_values")).alias("identifier_conflicts")
    )
    out = docs.select(F.col("_row").alias("doc_id"), flat_pages(F.col("_pages")).alias("_flat"), normal_pages(F.col("_pages")).alias("_normal"), page_spans(F.col("_pages")).alias("_spans"))
    for part in (pairs, others, parties, identifiers, clashes):
        out = out.join(part, "doc_id", "left")
    return out.withColumnRenamed("doc_id", "_row")


def business_records(
    docs: DataFrame,
    today: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    hint_col: str | None = None,
    type_hint_col: str | None = None,
    state_hint_col: str | None = None,
    pages_col: str | None = None,
) -> DataFrame:
    """One record per row of docs: type, country, subdivision, language, merged fields, lists, evidence, conflicts, warnings.

    Rows are told apart by id and text, so rows that share an id have a record each, and repeated rows equal ones. A
    null or empty text gives a record without success. Every field is the core parser's unless a labelled value
    differs and is clearly better. The texts are read once for the fields of the row and once for each list.

    pages_col, an array of page texts, takes the place of text_col: the text is then the pages joined. Evidence,
    additional fields and identifiers have the number of the page they stand on; without pages the text is page 1.
    """
    hint = lambda c: F.lit(None).cast("string") if c is None else F.col(c)
    pages = F.array(F.coalesce(F.col(text_col), F.lit(""))) if pages_col is None else F.coalesce(F.col(pages_col), F.array().cast("array<string>"))
    text = F.trim(F.coalesce(F.col(text_col), F.lit(""))) if pages_col is None else joined_text(pages)
    cuts = F.lit("") if pages_col is None else F.array_join(F.transform(pages, lambda p: F.length(F.coalesce(p, F.lit(""))).cast("string")), ",")
    base = docs.select(
        F.struct(F.col(id_col).alias("id"), F.md5(text).alias("hash"), cuts.alias("cuts"), hint(hint_col).alias("h"), hint(type_hint_col).alias("t"), hint(state_hint_col).alias("s")).alias("_row"),
        text.alias("text"),
        pages.alias("_pages"),
        hint(hint_col).alias("_hint"),
    )
    distinct = base.dropDuplicates(["_row"])
    typed = classify(distinct, "_row", "text", ("text", "_pages", "_hint")).withColumnRenamed("doc_id", "_row")
    kind = reconcile_type(F.col("document_type"), F.col("confidence"), F.col("_row.t"))
    typed = typed.select("_row", "text", "_pages", "_hint", F.struct(kind.alias("k"), "alternatives", "matched_terms", "ambiguous").alias("classification"))
    typed = typed.withColumn("document_type", F.col("classification.k.document_type"))
    placed = detect_jurisdiction(typed, "_row", "text", "_hint", ("text", "_pages", "classification", "document_type")).withColumnRenamed("doc_id", "_row")
    place = F.struct("country_code", "country_name", "registry_name", "source", "confidence", "requested_country_code", "detected_country_code", "matched_terms", "conflict")
    state = reconcile_subdivision(F.col("subdivision"), F.col("country_code"), F.col("_row.s"))
    placed = placed.select("_row", "text", "_pages", "classification", "document_type", "country_code", place.alias("jurisdiction"), state.alias("subdivision"))
    # Written once: the fields and each of the lists start from here, and the optimizer need not unfold what came before.
    placed = materialize(placed, "placed")
    spoken = detect_language(placed, "_row", "text", ("text", "classification", "document_type", "country_code", "jurisdiction", "subdivision"))
    language = F.struct("code", "name", "confidence", "ambiguous").alias("document_language")
    spoken = spoken.select(F.col("doc_id").alias("_row"), "text", "classification", "document_type", "country_code", "jurisdiction", "subdivision", language)
    spoken = spoken.withColumn("_authority", printed_authority(F.col("text")))
    carried = ("text", "classification", "jurisdiction", "subdivision", "document_language", "_authority")
    fields = materialize(core_fields(spoken, "_row", "text", carried), "fields").withColumnRenamed("doc_id", "_row")
    core = [c for c in fields.columns if c not in ("_row", *carried, "country_code", "document_type")]
    fields = fields.select("_row", *carried, "country_code", "document_type", F.struct(*core).alias("core"))
    carried = (*(c for c in carried if c != "_authority"), "_authority", "document_type", "core")
    capital = share_capital(fields, "_row", "text", "country_code", ("country_code", *carried)).withColumnRenamed("doc_id", "_row")
    own = [c for c in capital.columns if c not in ("_row", "country_code", *carried)]
    money = F.when(F.coalesce("issued_amount", "authorized_amount", "paid_up_amount", "stated_amount").isNotNull(), F.struct(*own))
    capital = capital.select("_row", "country_code", *carried, money.alias("share_capital"))
    rows = objects_clauses(capital, "_row", "text", ("country_code", *carried, "share_capital")).withColumnRenamed("doc_id", "_row")
    rows = rows.withColumnRenamed("objects", "objects_or_purpose").drop("text")

    lists = materialize(_lists(placed.select("_row", "text", "_pages", "country_code")), "lists")
    merged = _merged(rows.join(lists, "_row"), today)
    answers = base.select("_row").join(merged, "_row")
    return answers.withColumn("doc_id", F.col("_row.id")).select("doc_id", *(c for c in merged.columns if c != "_row"))


def of_roles_in(roles: tuple[str, ...]) -> Column:
    """The parties with one of the roles."""
    return F.filter("parties", lambda p: F.arrays_overlap(p["roles"], F.array(*map(F.lit, roles))))


def _merged(rows: DataFrame, today: Column) -> DataFrame:
    country = F.col("country_code")
    for name in ("pairs", "additional_fields", "parties", "identifiers", "identifier_conflicts"):
        kind = rows.schema[name].dataType.simpleString()
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.expr("array()").cast(kind)))
    on_page = lambda i: F.coalesce(page_of_span(F.col("_spans"), i["start"], i["end"]), page_of_phrase(F.col("_flat"), i["value"]))
    rows = rows.withColumns(
        {
            "identifiers": F.transform("identifiers", lambda i: i.withField("page", on_page(i))),
            "additional_fields": F.transform("additional_fields", lambda a: a.withField("page", F.coalesce(page_of_parts(F.col("_flat"), a["excerpt"]), page_of_parts(F.col("_normal"), a["excerpt"])))),
        }
    )
    nothing = "struct<value:string,confidence:double,method:string,excerpt:string>"

    def labelled(field: str) -> Column:
        named = F.transform(
            F.filter("pairs", lambda p: p["field"] == field),
            lambda p: F.struct(known_value(field, p["value"], country).alias("value"), p["confidence"].alias("confidence"), F.lit("generic_label_value").alias("method"), p["excerpt"].alias("excerpt")),
        )
        return F.get(F.filter(named, lambda p: p["value"].isNotNull()), F.lit(0)).cast(nothing)

    rows = rows.withColumns({f"_l_{f}": labelled(f) for f in LABELLED})
    named = F.struct(F.col("_authority").alias("value"), F.lit(0.88).alias("confidence"), F.lit("generic_label_value").alias("method"), F.col("_authority").alias("excerpt"))
    rows = rows.withColumn("_l_issuing_authority", F.coalesce("_l_issuing_authority", F.when(F.col("_authority").isNotNull(), named)))

    def own(field: str) -> Column:
        column = FIELDS.get(field, "nature_of_business")
        if column is None:
            return F.lit(None).cast(nothing)
        c = F.col(f"core.{column}")
        return F.when(c.isNotNull(), F.struct(c["value"].alias("value"), c["confidence"].alias("confidence"), c["method"].alias("method"), c["excerpt"].alias("excerpt"))).cast(nothing)

    other = lambda f: F.col(f"_l_{f}") if f in LABELLED else F.lit(None).cast(nothing)
    rows = rows.withColumns({f"_m_{f}": merge_field(own(f), other(f), f == "issuing_authority") for f in FIELDS})
    value = lambda f: F.col(f"_m_{f}.value")
    state = F.col("subdivision")
    first_reference = F.get(F.filter("identifiers", lambda i: i["identifier_type"] == "DOCUMENT_REFERENCE_NUMBER"), F.lit(0))["value"]
    registry = F.coalesce(F.when(~state["ambiguous"], state["registry_name"]), F.col("jurisdiction.registry_name"))
    final = {f: value(f) for f in FIELDS} | {
        "country_of_incorporation": F.coalesce("jurisdiction.country_name", "country_code", value("country_of_incorporation")),
        "jurisdiction_of_incorporation": F.coalesce(state["name"], value("jurisdiction_of_incorporation")),
        "issuing_authority": F.coalesce(value("issuing_authority"), registry),
        "document_reference_number": F.coalesce(value("document_reference_number"), first_reference),
    }
    rows = rows.withColumns(final).withColumns(
        {
            "jurisdiction_code": state["code"],
            "incorporation_or_registration_date": F.coalesce("incorporation_date", "registration_date"),
            "business_activities": unique_clean(F.array_compact(F.array(F.col("core.nature_of_business.value"), F.col("_l_business_activities.value")))),
            **{n: of_roles_in(roles) for n, roles in ROLE_LISTS.items()},
        }
    )

    flat = F.col("_flat")
    # Excerpts are lines as the parsers read them: where the page as printed has none, the page as read may.
    phrase = lambda c: F.coalesce(page_of_phrase(flat, c), page_of_phrase(F.col("_normal"), c))
    of_parts = lambda c: F.coalesce(page_of_parts(flat, c), page_of_parts(F.col("_normal"), c))

    def shown(field: str, c: Column, page: Column, always: bool = False) -> Column:
        chosen = F.lit(True) if always else F.coalesce(key(c["value"]) == key(F.col(field)), F.lit(False))
        text = F.substring(collapse(c["excerpt"]), 1, 240)
        return F.when(c["value"].isNotNull(), F.struct(F.lit(field).alias("field"), c["value"].alias("value"), c["method"].alias("method"), F.round(c["confidence"], 3).alias("confidence"), page.alias("page"), text.alias("text"), chosen.alias("selected")))

    of_core = lambda f: shown(f, own(f), phrase(own(f)["excerpt"]), f == "business_activities")
    of_label = lambda f: shown(f, F.col(f"_l_{f}"), of_parts(F.col(f"_l_{f}.excerpt")), f == "business_activities")
    parts = [of_core(f) for f in (*(f for f in FIELDS if FIELDS[f]), "business_activities")] + [of_label(f) for f in LABELLED]
    as_struct = lambda field, value, method, confidence, page, text: F.struct(F.lit(field).alias("field"), value.alias("value"), method.alias("method"), confidence.alias("confidence"), page.cast("int").alias("page"), text.alias("text"), F.lit(True).alias("selected"))
    null = F.lit(None).cast("string")
    parts.append(F.when(F.size("objects_or_purpose") > 0, as_struct("objects_or_purpose", F.array_join("objects_or_purpose", " | "), F.lit("objects_section"), F.lit(0.88), of_parts(F.array_join("objects_or_purpose", "|")), null)))
    parts.append(F.when(F.col("share_capital").isNotNull(), as_struct("share_capital", F.col("share_capital.amount"), F.lit("share_capital_clause"), F.lit(0.90), of_parts(F.col("share_capital.amount_text")), F.substring("share_capital.amount_text", 1, 240))))
    roles = F.array_distinct(F.flatten(F.transform("parties", lambda p: p["roles"])))
    named = lambda r: F.array_join(F.transform(F.filter("parties", lambda p: F.array_contains(p["roles"], r)), lambda p: p["name"]), "|")
    of_roles = F.transform(roles, lambda r: as_struct("parties", named(r), F.concat(F.lower(r), F.lit("_section")), F.lit(0.80), of_parts(named(r)), null))
    of_numbers = F.transform("identifiers", lambda i: as_struct("identifiers", i["normalized_value"], i["pattern_label"], F.round(i["confidence"], 3), i["page"], null))
    of_others = F.transform("additional_fields", lambda a: as_struct("additional_fields", F.concat_ws(": ", a["label"], a["value"]), F.lit("generic_label_value"), F.round(a["confidence"], 3), a["page"], F.substring(a["excerpt"], 1, 240)))
    evidence = F.concat(F.array_compact(F.array(*parts)).cast(_EVIDENCE), *(x.cast(_EVIDENCE) for x in (of_roles, of_others, of_numbers)))
    clash = lambda f: F.when(F.col(f"_m_{f}.conflict"), F.struct(F.lit(f).alias("field"), value(f).alias("selected_value"), F.array(own(f)["value"], other(f)["value"]).alias("candidate_values"), F.lit("highest_confidence_evidence").alias("resolution")))
    clashes = F.array_compact(F.array(*(clash(f) for f in FIELDS if FIELDS[f] and f in LABELLED)))
    of_types = F.transform("identifier_conflicts", lambda c: F.struct(c["field"].alias("field"), F.lit(None).cast("string").alias("selected_value"), c["candidate_values"].alias("candidate_values"), F.lit("multiple_distinct_values_for_same_identifier_designation").alias("resolution")))
    rows = rows.withColumns({"evidence": evidence, "conflicts": F.concat(clashes, of_types)})
    have = lambda c: (F.size(c) > 0 if c == "identifiers" else F.col(c).isNotNull()).cast("int")
    scores = lambda f: F.array_max(F.transform(F.filter("evidence", lambda e: e["field"] == f), lambda e: e["confidence"]))
    score = overall_confidence(
        F.col("classification.k.confidence"), F.col("jurisdiction.confidence"), scores("legal_company_name"), scores("identifiers"), reduce(lambda a, b: a + b, map(have, COVERAGE))
    )
    chosen = F.filter("evidence", lambda e: e["selected"])
    per_field = F.map_from_entries(
        F.transform(
            F.array_sort(F.array_distinct(F.transform(chosen, lambda e: e["field"]))),
            lambda f: F.struct(f, F.array_max(F.transform(F.filter(chosen, lambda e: e["field"] == f), lambda e: e["confidence"]))),
        )
    )
    rows = rows.withColumns({"overall_confidence": score, "field_confidence": per_field, "warnings": record_warnings(today)})
    success = F.col("_row.hash") != F.md5(F.lit(""))
    lists = ("identifiers", "parties", *ROLE_LISTS, "share_capital", "business_activities", "objects_or_purpose", "additional_fields")
    return rows.select(
        "_row", success.alias("success"), F.when(~success, "No OCR text was available for business-document parsing.").alias("message"),
        "document_type", F.col("classification.k.confidence").alias("document_type_confidence"), F.col("classification.k.source").alias("document_type_source"),
        F.col("classification.alternatives").alias("alternatives"), "jurisdiction", F.when(state["code"].isNotNull(), state).alias("subdivision"), "country_code",
        "jurisdiction_code", "document_language", *FIELDS, "incorporation_or_registration_date", *lists, "overall_confidence",
        confidence_level(F.col("overall_confidence")).alias("confidence_level"), "field_confidence", "evidence", "conflicts", "warnings",
    )


def record_warnings(today: Column) -> Column:
    """What a reviewer should see, in order: hints, type, country, language, sections, conflicts, missing and odd values."""
    say = lambda condition, name: F.when(F.coalesce(condition, F.lit(False)), SAID[name])
    unknown = F.col("document_type") == R.UNKNOWN_DOCUMENT
    formed = F.coalesce("incorporation_date", "registration_date").try_cast("date")
    issued = F.col("document_issue_date").try_cast("date")
    dated = F.filter("evidence", lambda e: e["field"].isin("incorporation_date", "registration_date", "document_issue_date"))
    small = lambda e, g: F.regexp_extract(F.coalesce(e["text"], F.lit("")), r"\b(\d{1,2})[./-](\d{1,2})[./-]\d{2,4}\b", g).try_cast("int") <= 12
    either = F.exists(dated, lambda e: F.coalesce(small(e, 1) & small(e, 2), F.lit(False)))
    j = F.col("jurisdiction")
    head = [
        F.col("classification.k.warning"), say(unknown, "type_unknown"), say(~unknown & F.col("classification.ambiguous"), "type_ambiguous"),
        F.col("subdivision.warning"),
    ]
    clash = F.transform("conflicts", lambda c: F.when(c["resolution"] == "highest_confidence_evidence", F.concat(F.lit("Conflicting values were extracted for "), c["field"], F.lit("; the strongest evidence was selected."))))
    middle = [
        say(F.col("document_language.code").isNull(), "language_unknown"), say(F.col("document_language.ambiguous"), "language_ambiguous"),
        say((F.col("document_type") == MEMORANDUM) & (F.size("objects_or_purpose") == 0), "no_objects"),
        say((F.col("document_type") == STATUS_REPORT) & (F.size("parties") == 0), "no_parties"),
    ]
    tail = [
        say(F.col("legal_company_name").isNull(), "name"), say(F.size("identifiers") == 0, "identifiers"), say(F.col("issuing_authority").isNull(), "authority"),
        say(formed > today, "formed_in_future"), say(issued > today, "issued_in_future"), say(formed > issued, "formed_after_issue"),
        say((F.coalesce("country_code", F.lit("")) != "USA") & either, "day_or_month"),
    ]
    country = jurisdiction_warnings(j["country_code"], j["source"], j["conflict"], F.col("subdivision.ambiguous"))
    return F.array_distinct(F.array_compact(F.concat(F.array(*head), country, F.array(*middle), clash, F.array(*tail))))


def summary_view(records: DataFrame) -> DataFrame:
    """The concise view of business_records(): data and field_details as JSON without empty values, no evidence lists.

    Role lists are left out beside the parties, the joint date beside the date it repeats, and a normalised number
    where it is the number itself. field_details holds each field's confidence and its selected evidence.
    """
    some = lambda c: F.when(F.size(c) > 0, F.col(c) if isinstance(c, str) else c)
    numbers = F.transform(
        "identifiers",
        lambda i: F.struct(
            i["identifier_type"].alias("type"), i["number_type"].alias("number_type"), i["value"].alias("value"),
            F.when(i["normalized_value"] != i["value"], i["normalized_value"]).alias("normalized_value"), i["issuing_authority"].alias("issuing_authority"),
            i["country_code"].alias("country_code"), i["confidence"].alias("confidence"), i["source"].alias("source"), i["is_primary"].alias("is_primary"), i["page"].alias("page"),
        ),
    )
    people = F.transform("parties", lambda p: F.struct(*(p[c].alias(c) for c in ("name", "roles", "status", "shares", "share_percentage"))))
    others = F.transform("additional_fields", lambda a: F.struct(a["label"].alias("label"), a["value"].alias("value"), a["confidence"].alias("confidence"), a["page"].alias("page")))
    joint = F.col("incorporation_or_registration_date")
    repeated = F.coalesce((joint == F.col("incorporation_date")) | (joint == F.col("registration_date")), F.lit(False))
    data = F.struct(
        *FIELDS, "country_code", "jurisdiction_code", F.when(~repeated, joint).alias("incorporation_or_registration_date"),
        some(numbers).alias("identifiers"), some(people).alias("parties"), "share_capital", some("business_activities").alias("business_activities"),
        some("objects_or_purpose").alias("objects_or_purpose"), some(others).alias("additional_fields"),
    )
    detail = F.map_from_entries(
        F.transform(
            F.map_entries(F.map_filter("field_confidence", lambda k, v: ~k.isin("identifiers", "additional_fields"))),
            lambda e: F.struct(
                e["key"],
                F.struct(
                    e["value"].alias("confidence"),
                    F.get(F.transform(F.filter("evidence", lambda x: (x["field"] == e["key"]) & x["selected"]), lambda x: F.struct(x["method"].alias("method"), x["page"].alias("page"), x["text"].alias("text"))), F.lit(0)).alias("evidence"),
                ),
            ),
        )
    )
    place = F.struct(*(F.col(f"jurisdiction.{c}").alias(c) for c in ("country_code", "country_name", "registry_name", "source", "confidence")), "subdivision")
    return records.select(
        "doc_id", "success", "message", F.lit("summary").alias("response_detail"), "document_type", "document_type_confidence", "overall_confidence",
        F.to_json(place).alias("jurisdiction"), F.to_json(data).alias("data"), F.to_json(detail).alias("field_details"), "warnings", "conflicts",
    )


def document_types(spark) -> DataFrame:
    """The document types that classification knows, with their order."""
    return spark.createDataFrame([(i, s.kind) for i, s in enumerate(R.SIGNATURES)], "position int, code string")
