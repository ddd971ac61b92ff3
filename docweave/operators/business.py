"""Core fields of business documents, merge of candidates, confidence, and the whole record."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.literals import may_match
from docweave.functions.profiles import REGISTRY_OF_PROFILES
from docweave.functions.textnorm import (
    bound,
    collapse,
    collapse_untidy,
    first_group,
    none_if_empty,
    normalize_business_text,
    normalize_company_name,
    normalize_company_status,
    normalize_entity_type,
    normalize_identifier,
    parse_date,
)
from docweave.operators.labels import labelled, labelled_at

# Labels and patterns of the core fields, in order of precedence; confidences.
NAME_PHRASES = (
    r"(?is)(?:THIS\s+IS\s+TO|I\s+HEREBY|HEREBY)\s+CERTIF(?:Y|IES)\s+THAT\s+([A-Z0-9][A-Z0-9 &'(),.\-/]{2,180}?)\s+(?:IS|WAS|HAS\s+BEEN)\s+"
    r"(?:(?:THIS|THAT)\s+DAY\s+)?(?:HEREBY\s+)?(?:INCORPORATED|REGISTERED)",
    r"(?is)\bCERTIFICATE\s+OF\s+(?:INCORPORATION|REGISTRATION)\s+(?:OF|FOR)\s+([A-Z0-9][A-Z0-9 &'(),.\-/]{2,180})",
    r"(?is)\bMEMORANDUM(?:\s+AND\s+ARTICLES)?\s+OF\s+ASSOCIATION\s+OF\s+([A-Z0-9][A-Z0-9 &'(),.\-/]{2,180})",
)
NAME_LABELS = (
    r"NAME\s+OF\s+(?:THE\s+)?COMPANY", r"REGISTERED\s+(?:COMPANY\s+)?NAME", r"LEGAL\s+(?:COMPANY|ENTITY)\s+NAME",
    r"COMPANY\s+NAME", r"ENTITY\s+NAME", r"BUSINESS\s+NAME",
)
NO_NAMES = (
    "CERTIFICATE OF", "STATUS REPORT", "MEMORANDUM", "ARTICLES OF ASSOCIATION", "CORPORATE AFFAIRS COMMISSION",
    "REGISTRAR OF COMPANIES", "REGISTRAR-GENERAL", "FEDERAL REPUBLIC", "REPUBLIC OF", "COMPANIES HOUSE",
    "BUSINESS REGISTRATION SERVICE",
)
LEGAL_SUFFIX = r"(?i)\b(?:LIMITED|LTD\.?|PLC|LTD\s*/?\s*GTE|LLC|L\.L\.C\.?|INCORPORATED|INC\.?|CORPORATION|CORP\.?|LLP)\b"
FORM_ONLY = (
    r"(?i)^(?:(?:(?:PRIVATE|PUBLIC)\s+)?COMPANY\s+LIMITED\s+BY\s+(?:SHARES|GUARANTEE)|LIMITED\s+LIABILITY\s+(?:COMPANY|PARTNERSHIP)"
    r"|INCORPORATED\s+TRUSTEES?)$"
)
NARRATIVE = r"(?i)^(?:IS|WAS|HAS\s+BEEN|HEREBY|THIS\s+DAY|THAT\s+DAY)\b.*\b(?:INCORPORATED|REGISTERED)\b"
TITLE = r"(?i)CERTIFICATE|STATUS\s+REPORT|MEMORANDUM|ARTICLES\s+OF\s+ASSOCIATION"
TYPE_LABELS = (r"COMPANY\s+TYPE", r"ENTITY\s+TYPE", r"TYPE\s+OF\s+COMPANY", r"CLASS\s+OF\s+COMPANY")
TYPE_PHRASES = (
    r"(?i)\bPRIVATE\s+COMPANY\s+LIMITED\s+BY\s+SHARES\b", r"(?i)\bPUBLIC\s+COMPANY\s+LIMITED\s+BY\s+SHARES\b",
    r"(?i)\bCOMPANY\s+LIMITED\s+BY\s+GUARANTEE\b", r"(?i)\bLIMITED\s+LIABILITY\s+(?:COMPANY|PARTNERSHIP)\b",
    r"(?i)\bUNLIMITED\s+COMPANY\b", r"(?i)\bINCORPORATED\s+TRUSTEES?\b", r"(?i)\bBUSINESS\s+NAME\b",
)
STATUS_LABELS = (r"COMPANY\s+STATUS", r"ENTITY\s+STATUS", r"REGISTRATION\s+STATUS", r"CURRENT\s+STATUS", r"STATUS")
STATUS_PHRASE = r"(?i)\b(?:COMPANY|ENTITY|REGISTRATION)\s+(?:IS\s+)?(ACTIVE|INACTIVE|DISSOLVED|STRUCK\s+OFF|IN\s+LIQUIDATION)\b"
DATES = {
    "incorporation_date": (
        (r"DATE\s+OF\s+INCORPORATION", r"INCORPORATION\s+DATE", r"DATE\s+INCORPORATED"),
        (r"(?i)\bINCORPORATED\s+ON\s+([^\n.;]{5,50})", r"(?i)\bINCORPORATED\s+THIS\s+([^\n.;]{5,60})"),
    ),
    "registration_date": (
        (r"DATE\s+OF\s+REGISTRATION", r"REGISTRATION\s+DATE", r"DATE\s+REGISTERED"),
        (r"(?i)\bREGISTERED\s+ON\s+([^\n.;]{5,50})",),
    ),
    "document_date": (
        (r"DATE\s+OF\s+REPORT", r"REPORT\s+DATE", r"DOCUMENT\s+DATE", r"GENERATED\s+(?:ON|DATE)", r"PRINTED\s+(?:ON|DATE)", r"AS\s+AT"),
        (),
    ),
}
ISSUED = (
    r"(?i)\bGIVEN\s+UNDER\s+MY\s+HAND[^\n.]{0,100}?\bTHIS\s+([^\n.]{5,55})",
    r"(?i)\bDATED\s+(?:AT\s+[A-Z ]+\s+)?(?:THIS\s+)?([^\n.]{5,55})",
)
ADDRESSES = {
    "registered_address": (
        r"REGISTERED\s+OFFICE\s+ADDRESS", r"REGISTERED\s+ADDRESS", r"REGISTERED\s+OFFICE", r"ADDRESS\s+OF\s+(?:THE\s+)?REGISTERED\s+OFFICE",
    ),
    "head_office_address": (r"HEAD\s+OFFICE\s+ADDRESS", r"PRINCIPAL\s+PLACE\s+OF\s+BUSINESS", r"BUSINESS\s+ADDRESS"),
}
TAX_LABELS = (r"TAX\s+IDENTIFICATION\s+NUMBER", r"TAX\s+ID(?:ENTIFICATION)?\s+NUMBER", "TIN")
NATURE_LABELS = (r"NATURE\s+OF\s+BUSINESS", r"PRINCIPAL\s+(?:BUSINESS\s+)?ACTIVITY", r"LINE\s+OF\s+BUSINESS")
COMPANY_EMAIL_LABELS = (r"REGISTERED\s+EMAIL(?:\s+ADDRESS)?", r"COMPANY\s+EMAIL")
EMAIL_LABELS = (r"EMAIL(?:\s+ADDRESS)?",)
COMPANY_PHONE_LABELS = (r"COMPANY\s+PHONE", r"REGISTERED\s+PHONE(?:\s+NUMBER)?")
PHONE_LABELS = (r"PHONE(?:\s+NUMBER)?", "TELEPHONE", "MOBILE")
#: Every label of a core field.
ALL_LABELS = (
    *NAME_LABELS, *TYPE_LABELS, *STATUS_LABELS, *TAX_LABELS, *NATURE_LABELS, *COMPANY_EMAIL_LABELS, *EMAIL_LABELS, *COMPANY_PHONE_LABELS, *PHONE_LABELS,
    *(x for labels in ADDRESSES.values() for x in labels), *(x for labels, _ in DATES.values() for x in labels),
)
ADDRESS_WORDS = (
    r"\d|\b(?:STREET|ROAD|AVENUE|CLOSE|DRIVE|LANE|PLOT|SUITE|FLOOR|BUILDING|DISTRICT|STATE|CITY|LGA|POSTAL|OFFICE)\b"
)
LAWS = (
    r"(?i)\bCOMPANIES\s+AND\s+ALLIED\s+MATTERS\s+ACT(?:\s*,?\s*20\d{2})?\b",
    r"(?i)\bCOMPANIES\s+ACT(?:\s*,?\s*(?:NO\.?\s*)?\d{1,4}(?:\s+OF)?\s*20\d{2}|\s+20\d{2})\b",
    r"(?i)\bCANADA\s+BUSINESS\s+CORPORATIONS\s+ACT\b",
    r"(?i)\bCORPORATIONS\s+ACT\s+2001\b",
    r"(?i)\b(?:GENERAL\s+)?CORPORATION\s+LAW\b",
)
GENERIC_NUMBERS = (
    (r"(?i)\b(?:COMPANY|REGISTRATION|REGISTERED|ENTITY|CORPORATION|FILE|DOCUMENT)\s+(?:NO\.?|NUMBER|ID)\s*[:#-]?\s*([A-Z0-9][A-Z0-9/-]{3,30})\b", 1, 0.85),
    (r"(?i)\b((?:RC|BN|IT|LLP|LP)\s*[:#-]?\s*\d{4,12})\b", 1, 0.84),
)
OFFICER_HEADING = (
    r"(?i)^(?:PARTICULARS\s+OF\s+)?(?:DIRECTORS?|SHAREHOLDERS?|SUBSCRIBERS?|BENEFICIAL\s+OWNERS?"
    r"|PERSONS?\s+WITH\s+SIGNIFICANT\s+CONTROL|PSC\s+DETAILS|SECRETARY)\b"
)
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
GENERIC_AUTHORITY_WORDS = ("STATE", "SECRETARY", "DIVISION", "CORPORATIONS", "REGISTRY", "REGISTRAR", "COMMISSION")
#: Fields whose presence counts as coverage of a record.
COVERAGE = (
    "legal_company_name", "entity_type", "incorporation_date", "registration_date", "registered_office_address", "issuing_authority",
    "company_status", "identifiers",
)


def _match(value: Column, excerpt: Column, method: str, confidence: float) -> Column:
    """(value, excerpt, method, confidence), null without a value."""
    return F.when(
        value.isNotNull(),
        F.struct(value.alias("value"), excerpt.alias("excerpt"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")),
    )


def looks_like_company_name(value: Column) -> Column:
    def plausible(name: Column, upper: Column) -> Column:
        found = F.length(name).between(3, 180) & (F.regexp_count(upper, F.lit("[A-Z]")) >= 3)
        for marker in NO_NAMES:
            found = found & ~F.contains(upper, F.lit(marker))
        return found & ~F.regexp_like(name, F.lit(FORM_ONLY)) & ~F.regexp_like(name, F.lit(NARRATIVE))

    return F.coalesce(bound(normalize_company_name(value), lambda name: bound(F.upper(name), lambda upper: plausible(name, upper))), F.lit(False))


def looks_like_address(value: Column) -> Column:
    return (F.length(value) >= 8) & F.regexp_like(F.upper(value), F.lit(ADDRESS_WORDS))


def _seen(pattern: str) -> Column:
    """The column _text, if its upper case _upper has the words of the pattern, else null."""
    return F.when(may_match(F.col("_upper"), pattern), F.col("_text"))


def _company_name(text: Column, lines: Column, kind: Column, label: Column) -> Column:
    found = []
    for pattern in NAME_PHRASES:
        name = bound(normalize_company_name(F.regexp_extract(_seen(pattern), pattern, 1)), lambda n: F.when(looks_like_company_name(n), n))
        found.append(bound(name, lambda n, p=pattern: _match(n, F.regexp_extract(text, p, 0), "certificate_or_title_phrase", 0.94)))
    found.append(_match(normalize_company_name(label["value"]), label["excerpt"], "company_name_label", 0.98))
    # A line with a legal suffix, best near a title; the first of the best.
    titles = F.filter(F.transform(lines, lambda x, i: F.when(F.regexp_like(x, F.lit(TITLE)), i)), lambda i: i.isNotNull())

    def score(line: Column, i: Column, name: Column) -> Column:
        near = F.array_min(F.transform(titles, lambda t: F.abs(t - i)))
        points = (
            F.lit(20)
            + F.when(F.length(name) <= 100, 5).otherwise(0)
            + F.coalesce(F.greatest(F.lit(0), F.lit(12) - near), F.lit(0))
            + F.when((kind == "COMPANY_STATUS_REPORT") & (i < 25), 3).otherwise(0)
        )
        good = F.regexp_like(name, F.lit(LEGAL_SUFFIX)) & looks_like_company_name(line)
        return F.when(good, F.struct((-points).alias("rank"), i.alias("i"), name.alias("name")))

    # A name's suffix is one of its line, unless the name was cut.
    may = lambda x: F.regexp_like(x, F.lit(LEGAL_SUFFIX)) | (F.length(x) > 180)
    scored = F.transform(lines, lambda x, i: F.when(may(x), bound(normalize_company_name(x), lambda n: score(x, i, n))))
    best = F.get(F.array_sort(F.array_compact(scored)), F.lit(0))["name"]
    return F.coalesce(*found, _match(best, best, "legal_name_line", 0.80))


def _registration_number(text: Column, country: Column) -> Column:
    """(value, excerpt, method, confidence) and the number's type."""
    matches, kinds = [], []
    for profile in REGISTRY_OF_PROFILES.list():
        for p in profile.registration:
            regex = "(?i)" + p.regex
            number = normalize_identifier(F.regexp_extract(text, regex, 2 if "(?<prefix>" in regex else 1))
            hit = F.when(country == profile.code, number)
            matches.append(_match(hit, F.regexp_extract(text, regex, 0), "jurisdiction_identifier_pattern", p.confidence))
            kinds.append(F.when(hit.isNotNull(), F.lit(p.number_type)))
    for regex, group, confidence in GENERIC_NUMBERS:
        number = normalize_identifier(F.regexp_replace(F.regexp_extract(text, regex, group), "[:#]", ""))
        matches.append(_match(number, F.regexp_extract(text, regex, 0), "generic_identifier_pattern", confidence))
        kinds.append(F.when(number.isNotNull(), F.lit("REGISTRATION_NUMBER")))
    return F.struct(F.coalesce(*matches).alias("match"), F.coalesce(*kinds).alias("kind"))


def _date(text: Column, name: str, country: Column) -> Column:
    label, phrases = F.col(f"_{name}"), DATES[name][1]
    found = [_match(parse_date(label["value"], country), label["excerpt"], f"{name}_label", 0.96)]
    for p in phrases:
        found.append(_match(parse_date(first_group(_seen(p), p), country), F.regexp_extract(text, p, 0), f"{name}_label_phrase", 0.84))
    return F.coalesce(*found)


def core_fields(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with a struct (value, excerpt, method, confidence) for each core field, null if not found.

    docs has country_code and document_type beside the text. Every field takes the first of its ways that yields a
    valid value. Null texts have no fields. keep: columns to pass on.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), *keep, "country_code", "document_type", normalize_business_text(F.col(text_col)).alias("_text"),
    )
    base = base.withColumns({"_lines": F.filter(F.split("_text", "\n"), lambda x: x != ""), "_upper": F.upper("_text")})
    text, lines, country, kind = F.col("_text"), F.col("_lines"), F.col("country_code"), F.col("document_type")
    officers = F.array_position(F.transform(lines, lambda x: F.regexp_like(x, F.lit(OFFICER_HEADING))), True)
    scope = F.when(officers > 0, F.slice(lines, F.lit(1), (officers - 1).cast("int"))).otherwise(lines)
    base = base.withColumns({"_scope": scope, "_among": labelled_at(lines, ALL_LABELS)})
    scope, among = F.col("_scope"), F.col("_among")
    phone = lambda v: F.length(F.regexp_replace(v, r"\D", "")) >= 7
    # Every labelled value is a column of its own, computed once, before its parts are used.
    of = partial(labelled, among=among)
    found = {
        "name": of(lines, NAME_LABELS, looks_like_company_name),
        "number": _registration_number(text, country),
        "type": of(lines, TYPE_LABELS, lambda v: normalize_entity_type(v).isNotNull()),
        "name_line": F.get(F.filter(lines, lambda x: F.regexp_like(x, F.lit(LEGAL_SUFFIX)) & looks_like_company_name(x)), F.lit(0)),
        "status": of(lines, STATUS_LABELS, lambda v: normalize_company_status(v).isNotNull()),
        "tax": of(lines, TAX_LABELS, lambda v: v.rlike("(?i)[A-Z0-9]{5,}")),
        "nature": of(lines, NATURE_LABELS, lambda v: F.length(F.regexp_replace(F.upper(v), "[^A-Z]", "")) >= 4, more=2),
        "email1": of(lines, COMPANY_EMAIL_LABELS, lambda v: v.rlike(EMAIL)),
        "email2": of(scope, EMAIL_LABELS, lambda v: v.rlike(EMAIL)),
        "phone1": of(lines, COMPANY_PHONE_LABELS, phone),
        "phone2": of(scope, PHONE_LABELS, phone),
        **{n: of(lines, labels, looks_like_address, more=3) for n, labels in ADDRESSES.items()},
        **{n: of(lines, labels, lambda v: parse_date(v, country).isNotNull()) for n, (labels, _) in DATES.items()},
    }
    staged = base.withColumns({f"_{n}": c for n, c in found.items()})
    part = lambda n: F.col(f"_{n}")
    entity = F.coalesce(
        _match(normalize_entity_type(part("type")["value"]), part("type")["excerpt"], "entity_type_label", 0.94),
        *(_match(normalize_entity_type(first_group(_seen(p), p, 0)), F.regexp_extract(text, p, 0), "entity_type_phrase", 0.86) for p in TYPE_PHRASES),
        _match(normalize_entity_type(part("name_line")), part("name_line"), "legal_suffix_inference", 0.62),
    )
    status = F.coalesce(
        _match(normalize_company_status(part("status")["value"]), part("status")["excerpt"], "company_status_label", 0.94),
        _match(normalize_company_status(first_group(text, STATUS_PHRASE)), F.regexp_extract(text, STATUS_PHRASE, 0), "company_status_phrase", 0.82),
    )
    certificate = F.startswith(kind, F.lit("CERTIFICATE"))
    issued = [
        _match(F.when(certificate, parse_date(first_group(_seen(p), p), country)), F.regexp_extract(text, p, 0), "certificate_issue_phrase", 0.82)
        for p in ISSUED
    ]

    def address(name: str) -> Column:
        clean = F.regexp_replace(collapse(F.translate(part(name)["value"], "|", " ")), r"\s*,\s*", ", ")
        clean = F.regexp_replace(clean, r"(,\s*){2,}", ", ")
        return _match(none_if_empty(F.substring(F.btrim(clean, F.lit(" :;,.#-")), 1, 500)), part(name)["excerpt"], f"{name}_label", 0.92)

    def contact(name: str) -> Column:
        both = (part(f"{name}1"), part(f"{name}2"))
        return F.coalesce(*(_match(x["value"], x["excerpt"], f"{name}_label", 0.90) for x in both))

    tax, nature, number = part("tax"), part("nature"), part("number")
    return staged.select(
        "doc_id",
        *keep,
        "country_code",
        "document_type",
        _company_name(text, lines, kind, part("name")).alias("company_name"),
        number["match"].alias("registration_number"),
        number["kind"].alias("registration_number_type"),
        entity.alias("entity_type"),
        status.alias("company_status"),
        _date(text, "incorporation_date", country).alias("incorporation_date"),
        _date(text, "registration_date", country).alias("registration_date"),
        F.coalesce(_date(text, "document_date", country), *issued).alias("document_date"),
        address("registered_address").alias("registered_address"),
        address("head_office_address").alias("head_office_address"),
        F.coalesce(*(_match(collapse(first_group(_seen(p), p, 0)), F.regexp_extract(text, p, 0), "governing_law_pattern", 0.90) for p in LAWS)).alias("governing_law"),
        _match(F.coalesce(normalize_identifier(tax["value"]), tax["value"]), tax["excerpt"], "tax_identifier_label", 0.90).alias("tax_identification_number"),
        contact("email").alias("contact_email"),
        contact("phone").alias("contact_phone"),
        _match(nature["value"], nature["excerpt"], "business_activity_label", 0.90).alias("nature_of_business"),
    )


def authorities_compatible(left: Column, right: Column) -> Column:
    """Whether two authorities may be one: they share a word that says which, and each has a word that says what it is.

    Words are runs of four or more letters; what they are is GENERIC_AUTHORITY_WORDS. Nulls have no words.
    """
    generic = F.array(*map(F.lit, GENERIC_AUTHORITY_WORDS))
    words = lambda c: F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit("[A-Z]{4,}"), F.lit(0))
    shared = F.array_except(F.array_intersect(words(left), words(right)), generic)
    return (F.size(shared) > 0) & F.arrays_overlap(words(left), generic) & F.arrays_overlap(words(right), generic)


def merge_candidates(candidates: DataFrame, margin: float = 0.02) -> DataFrame:
    """(doc_id, field, value, confidence, conflict, candidate_values) from (doc_id, field, value, confidence, parser).

    Parsers are folded in order: the first value stays until a later one differs and scores over margin higher. A
    value equal in letters and digits changes nothing, whatever its score. Values that differ are a conflict, recorded
    either way, but for issuing authorities that may be one (authorities_compatible()): the better of them stays. A null confidence counts .5; null and empty values are no candidates. A field of a document has few
    candidates by nature, one for each parser.
    """
    rows = candidates.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("parser", (-F.coalesce("confidence", F.lit(0.5))).alias("minus"), "value")))
    key = lambda v: F.regexp_replace(F.upper(v), "[^A-Z0-9]", "")
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("score"), F.lit(False).alias("conflict"))

    def step(acc: Column, c: Column) -> Column:
        differs = acc["value"].isNotNull() & (key(acc["value"]) != key(c["value"]))
        same = (F.col("field") == "issuing_authority") & authorities_compatible(acc["value"], c["value"])
        takes = acc["value"].isNull() | (differs & (-c["minus"] > acc["score"] + F.when(same, 0.0).otherwise(margin)))
        return F.struct(
            F.when(takes, c["value"]).otherwise(acc["value"]).alias("value"),
            F.when(takes, -c["minus"]).otherwise(acc["score"]).alias("score"),
            (acc["conflict"] | F.coalesce(differs & ~same, F.lit(False))).alias("conflict"),
        )

    merged = rows.groupBy("doc_id", "field").agg(ordered.alias("c")).withColumn("m", F.aggregate("c", start, step))
    return merged.select(
        "doc_id",
        "field",
        F.col("m.value").alias("value"),
        F.col("m.score").alias("confidence"),
        F.col("m.conflict").alias("conflict"),
        F.array_distinct(F.transform("c", lambda x: x["value"])).alias("candidate_values"),
    )


def overall_confidence(classification: Column, jurisdiction: Column, name: Column, identifier: Column, covered: Column) -> Column:
    """.25 type + .15 country + .20 name + .20 best identifier + .20 coverage of eight fields, clamped, to 3 places."""
    part = lambda c: F.coalesce(c, F.lit(0.0))
    total = 0.25 * part(classification) + 0.15 * part(jurisdiction) + 0.20 * part(name) + 0.20 * part(identifier) + 0.20 * covered / len(COVERAGE)
    return F.bround(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 3)


def field_candidates(records: DataFrame, fields: tuple[str, ...], parser: int = 0) -> DataFrame:
    """Core fields as rows (doc_id, field, value, confidence, parser) for merge_candidates()."""
    parts = F.array(
        *(F.struct(F.lit(f).alias("field"), F.col(f"{f}.value").alias("value"), F.col(f"{f}.confidence").alias("confidence")) for f in fields)
    )
    return (
        records.select("doc_id", F.explode_outer(parts).alias("x"))
        .select("doc_id", "x.*", F.lit(parser).alias("parser"))
        .where("value is not null")
    )


def first_pages(excerpts: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, field, page_number): the first page with a part of the excerpt, parts being 4 or more characters.

    Merged by document: texts that are made on the way are larger than the tables they are made of, whose size would
    have them broadcast.
    """
    flat = lambda c: F.lower(collapse_untidy(c))
    parts = F.filter(F.transform(F.split("excerpt", r"\|"), flat), lambda x: F.length(x) >= 4)
    found = excerpts.withColumn("_parts", parts).join(pages.select("doc_id", "page_number", flat(F.col("text")).alias("_page")).hint("merge"), "doc_id")
    hit = F.exists("_parts", lambda x: F.contains(F.col("_page"), x))
    return found.where(hit).groupBy("doc_id", "field").agg(F.min("page_number").alias("page_number"))


def ranked_fields(merged: DataFrame) -> DataFrame:
    """Merged fields of a document by confidence, best first."""
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "field")))
