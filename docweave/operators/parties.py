"""Parties of company documents: directors, shareholders, owners and other roles, from lines in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.textnorm import bound, collapse, none_if_empty, normalize_business_text

# Roles with their headings in order of precedence, wording that ends a section or is no name.
ROLE_HEADINGS = (
    ("DIRECTOR", r"DIRECTORS?|PARTICULARS\s+OF\s+DIRECTORS?"),
    ("SHAREHOLDER", r"SHAREHOLDERS?|SHAREHOLDING|RETURN\s+OF\s+ALLOTMENT"),
    ("BENEFICIAL_OWNER", r"BENEFICIAL\s+OWNERS?"),
    ("PERSON_WITH_SIGNIFICANT_CONTROL", r"PERSONS?\s+WITH\s+SIGNIFICANT\s+CONTROL|SIGNIFICANT\s+CONTROLLERS?|\bPSC\b"),
    ("SECRETARY", r"COMPANY\s+SECRETAR(?:Y|IES)|SECRETAR(?:Y|IES)"),
    ("SUBSCRIBER", r"SUBSCRIBERS?|SUBSCRIBERS?\s+TO\s+THE\s+MEMORANDUM"),
    ("PROPRIETOR", r"PROPRIETORS?|BUSINESS\s+OWNERS?"),
    ("PARTNER", r"PARTNERS?"),
    ("TRUSTEE", r"TRUSTEES?"),
)
SECTION_STOP = (
    r"(?i)^(?:COMPANY|GENERAL|REGISTRATION|ADDRESS|SHARE\s+CAPITAL|OBJECTS?|NATURE\s+OF\s+BUSINESS|ANNUAL\s+RETURNS?|CHARGES?"
    r"|MORTGAGES?|ARTICLES?|MEMORANDUM|DECLARATION|CERTIFICATION|GENERATED|DISCLAIMER|FILING\s+HISTORY)\b"
)
NAME_STOP_WORDS = (
    "ADDRESS", "APPOINTED", "BUSINESS", "CEASED", "COMPANY", "DATE", "DESIGNATION", "DIRECTOR", "DIRECTORS", "EMAIL", "FIRST",
    "FORENAME", "GENDER", "IDENTIFICATION", "NAME", "NATIONALITY", "NATURE", "NUMBER", "OCCUPATION", "OTHER", "PARTICULARS",
    "PHONE", "ROLE", "SECRETARY", "SHAREHOLDER", "SHAREHOLDERS", "SHARES", "STATUS", "SUBSCRIBER", "SURNAME", "TRUSTEE", "TYPE",
)
NO_PARTIES = (
    "UNITED KINGDOM", "UNITED STATES", "UNITED STATES OF AMERICA", "FEDERAL REPUBLIC OF NIGERIA", "REPUBLIC OF GHANA",
    "SOUTH AFRICA", "NIGERIA", "GHANA", "CANADA", "AUSTRALIA",
)
ADDRESS_WORD = (
    r"\b(?:STREET|ROAD|AVENUE|CLOSE|DRIVE|LANE|BOULEVARD|HIGHWAY|PLOT|SUITE|FLOOR|BUILDING|ESTATE|DISTRICT|POSTAL|POSTCODE|ZIP|LGA)\b"
)
PERSONAL_NUMBER = r"\b(?:NIN|BVN|PASSPORT|IDENTIFICATION|DATE\s+OF\s+BIRTH)\b"
NO_NAME_START = r"^(?:NATIONALITY|ADDRESS|STATUS|EMAIL|PHONE|APPOINTED|CEASED)\b"
LEGAL_SUFFIX = r"\b(?:LIMITED|LTD|LLC|INCORPORATED|INC|PLC|CORPORATION|CORP)\b"
HEADER_WORDS = (
    "ADDRESS", "FULL", "NAME", "NAMES", "NUMBER", "ROLE", "SHAREHOLDER", "SHARES", "SIGNATURE", "STATUS", "SUBSCRIBER",
    "SUBSCRIBERS", "TYPE",
)
BULLET = r"^(?:[•*]|\(?\d+[.)])\s*"
PROSE = (
    r"\b(?:SUBJECT\s+TO|GENERAL\s+AUTHORITY|TAKE\s+DECISIONS?|DECISION-MAKING|MEETINGS?|QUORUM|DELEGAT(?:E|ION)|APPOINTING"
    r"|APPOINTMENT|REMUNERATION|EXPENSES?|CORPORATE\s+AFFAIRS\s+COMMISSION|IS\s+RESPONSIBLE|ARE\s+RESPONSIBLE|MAY\s+APPOINT"
    r"|MUST\s+ENSURE)\b"
)
METADATA_LINE = (
    r"(?i)^\s*(?:STATUS|SHARES?|ALLOTMENT|SHARE\s*PERCENTAGE|PERCENTAGE|SHAREHOLDING|NATIONALITY|ADDRESS|EMAIL|PHONE|TELEPHONE"
    r"|APPOINTED|CEASED)\s*[:.-]"
)
AFTER_NAME = (
    r"(?i)\s+\b(?:ACTIVE|INACTIVE|CEASED|RESIGNED|APPOINTED|NATIONALITY|ADDRESS|EMAIL|PHONE|SHARES?|PERCENTAGE|DIRECTOR"
    r"|SHAREHOLDER|SECRETARY|SUBSCRIBER|PROPRIETOR|PARTNER|TRUSTEE)\b"
)
INLINE_ROLE = (
    r"(?i)^(DIRECTOR|SHAREHOLDER|BENEFICIAL\s+OWNER|PERSON\s+WITH\s+SIGNIFICANT\s+CONTROL|PSC|COMPANY\s+SECRETARY|SECRETARY"
    r"|SUBSCRIBER|PROPRIETOR|PARTNER|TRUSTEE)\s*[:.-]\s*(.+)$"
)
INLINE_ROLES = {
    "BENEFICIAL OWNER": "BENEFICIAL_OWNER", "PERSON WITH SIGNIFICANT CONTROL": "PERSON_WITH_SIGNIFICANT_CONTROL",
    "PSC": "PERSON_WITH_SIGNIFICANT_CONTROL", "COMPANY SECRETARY": "SECRETARY",
}
ROLE_RECORD = r"(?i)^\s*(?:(?:\d+(?:\.[A-Z]|[A-Z]|[.)])?|[A-Z]\d+)\s+)?ROLE\s*TYPE\s*[:.-]?\s*([A-Z ]+)\s*$"
RECORD_ROLES = {
    "DIRECTOR": "DIRECTOR", "SECRETARY": "SECRETARY", "COMPANYSECRETARY": "SECRETARY", "SECRETARYCOMPANY": "SECRETARY",
    "SHAREHOLDER": "SHAREHOLDER", "SUBSCRIBER": "SUBSCRIBER", "BENEFICIALOWNER": "BENEFICIAL_OWNER",
    "PSC": "PERSON_WITH_SIGNIFICANT_CONTROL", "PERSONWITHSIGNIFICANTCONTROL": "PERSON_WITH_SIGNIFICANT_CONTROL",
}
RECORD_LABELS = {
    "full_name": r"FULL\s+NAME|NAME", "company_name": r"COMPANY\s+NAME|CORPORATE\s+NAME", "surname": r"SURNAME|LAST\s+NAME",
    "first_name": r"FIRST\s+NAME|FORENAME", "other_name": r"OTHER\s+NAMES?|MIDDLE\s+NAMES?",
}
NOTHING = ("NIL", "NONE", "N/A", "NA", "NOT APPLICABLE")
#: Lines to a section and to a registry record; lines that show whether a section lists people; parties of a document.
SECTION_LINES, RECORD_LINES, SHOWN_LINES, MOST_PARTIES = 100, 60, 12, 100
_MARKS = " |:;,.-"
_ANY_HEADING = f"(?i)^(?:{'|'.join(p for _, p in ROLE_HEADINGS)})\\s*[:.-]?$"
_ORDER = {role: i for i, (role, _) in enumerate(ROLE_HEADINGS)}


def _like(value: Column, pattern: str) -> Column:
    return F.regexp_like(value, F.lit(pattern))


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def looks_like_party_name(value: Column) -> Column:
    """At least two words that are no labels; no digits unless a company form follows; no address, country or heading."""
    fits = bound(collapse(value), lambda name: bound(F.upper(name), lambda upper: _is_name(name, upper)))
    return F.coalesce(fits, F.lit(False))


def _is_name(name: Column, upper: Column) -> Column:
    words = F.filter(F.regexp_extract_all(upper, F.lit(r"[A-Z][A-Z'&.-]*"), F.lit(0)), lambda w: ~w.isin(*NAME_STOP_WORDS))
    excluded = (
        F.contains(name, F.lit("@")) | _like(upper, PERSONAL_NUMBER) | upper.isin(*NO_PARTIES) | _like(upper, ADDRESS_WORD)
        | _like(upper, NO_NAME_START) | _like(name, _ANY_HEADING) | _like(name, SECTION_STOP)
    )
    shaped = (F.size(words) >= 2) & (_like(upper, LEGAL_SUFFIX) | ~_like(name, r"\d"))
    return F.length(name).between(4, 140) & shaped & ~excluded


def party_name(line: Column) -> Column:
    """The name that a line of a list begins with, null if it has none."""
    plain = F.regexp_replace(F.trim(line), r"^\s*(?:\d+[.)-]?|[A-Z][.)])\s*", "")
    plain = F.regexp_replace(plain, r"(?i)^(?:FULL\s+)?NAME\s*[:.-]\s*", "")
    return bound(plain, _first_name)


def _first_name(plain: Column) -> Column:
    cells = F.filter(F.transform(F.split(plain, r"\s*\|\s*|\t+|\s{2,}"), lambda x: F.btrim(x, F.lit(_MARKS))), lambda x: x != "")
    first = F.coalesce(F.get(cells, F.lit(0)), plain)
    name = F.btrim(F.split(first, AFTER_NAME, 2)[0], F.lit(_MARKS))
    return bound(name, lambda n: F.when(looks_like_party_name(n), n))


def party_facts(line: Column) -> dict[str, Column]:
    """Status, number of shares and their percentage on a line, null if not printed."""
    percent = none_if_empty(F.regexp_extract(line, r"\b(\d{1,3}(?:\.\d+)?)\s*%", 1))
    shares = (
        r"(?i)(?:\b(?:SHARES?|ALLOTMENT)\s*[:.-]?\s*(\d{1,3}(?:[ ,]\d{3})+|\d+)\b|\b(\d{1,3}(?:[ ,]\d{3})+|\d+)\s+SHARES?\b)"
    )
    printed = F.concat(F.regexp_extract(line, shares, 1), F.regexp_extract(line, shares, 2))
    return {
        "status": none_if_empty(F.regexp_extract(F.upper(line), r"\b(ACTIVE|INACTIVE|CEASED|RESIGNED)\b", 1)),
        "shares": none_if_empty(F.regexp_replace(printed, "[ ,]", "")),
        "share_percentage": F.when(percent.cast("double") <= 100, percent),
    }


def _is_prose(line: Column, role: Column) -> Column:
    def prose(text: Column) -> Column:
        upper = F.upper(text)
        director = (role == "DIRECTOR") & _like(upper, r"^(?:ALTERNATE\s+)?DIRECTORS?\b")
        long = (F.size(F.split(text, " ")) > 12) | _like(text, "[.;]$")
        return (text != "") & (_like(text, BULLET) | director | long | _like(upper, PROSE))

    return bound(collapse(line), prose)


def _is_header(line: Column) -> Column:
    words = F.trim(F.regexp_replace(F.upper(line), "[^A-Z]+", " "))
    return (words != "") & F.forall(F.split(words, " "), lambda w: w.isin(*HEADER_WORDS))


def _record_value(line: Column, below: Column, labels: str) -> Column:
    """What follows a label on a line, or stands below it; null for nothing, addresses and numbers."""
    pattern = rf"(?i)^\s*(?:{labels})(?:\s*[:#.-]\s*|\s+)(.*)$"
    clean = lambda x: F.btrim(x, F.lit(_MARKS))
    inline = clean(F.regexp_extract(line, pattern, 1))
    value = F.substring(collapse(F.when(inline != "", inline).otherwise(clean(F.coalesce(below, F.lit(""))))), 1, 140)
    usable = lambda v: (v != "") & ~F.upper(v).isin(*NOTHING) & ~_like(v, r"@|\d")
    return F.when(_like(line, pattern), bound(value, lambda v: F.when(usable(v), v)))


def _sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line with the last heading and the last registry record above it."""
    lines = F.filter(F.split(normalize_business_text(F.col(text_col), columns=True), "\n"), lambda x: x != "")
    flat = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines).alias("i", "line"))
    line = F.col("line")
    role = F.coalesce(*(F.when(_like(line, f"(?i)^(?:{p})\\s*[:.-]?$"), F.lit(r)) for r, p in ROLE_HEADINGS))
    code = F.regexp_replace(F.upper(F.regexp_extract(line, ROLE_RECORD, 1)), "[^A-Z]", "")
    marked = flat.withColumns(
        {
            "heading": F.when(role.isNotNull() | _like(line, SECTION_STOP), F.struct(F.col("i").alias("at"), role.alias("role"))),
            "record": F.when(_like(line, ROLE_RECORD), F.struct(F.col("i").alias("at"), _lookup(RECORD_ROLES, code).alias("role"))),
        }
    )
    by_line = Window.partitionBy("doc_id").orderBy("i")
    above = by_line.rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumns(
        {
            "under": F.last("heading", ignorenulls=True).over(above),
            "inside": F.last("record", ignorenulls=True).over(above),
            "below": F.lead("line").over(by_line),
            "below_is_record": F.lead("record").over(by_line).isNotNull(),
        }
    )


def extract_parties(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, name, roles, status, shares, share_percentage): the named parties of each document.

    They come from registry records (ROLE TYPE), then from lines that begin with a role, then from the lists under
    role headings, in the headings' order. A list is taken only if its first telling line is a name, and ends at
    prose. Facts on a name's line and on the labelled lines after it belong to it, the last of a kind counts. Names
    equal in letters and digits are one party with all its roles and the first of each fact; a document has at most
    MOST_PARTIES. Personal numbers, addresses and contacts are never read. A document without parties has no row, nor
    has a null text; rows that share an id count as one document.
    """
    lines = _sections(docs, id_col, text_col)
    line, i = F.col("line"), F.col("i")
    section = Window.partitionBy("doc_id", "under.at")
    nth = i - F.col("under.at")
    in_section = F.col("heading").isNull() & F.col("under.role").isNotNull() & (nth <= SECTION_LINES)
    lines = lines.withColumns(
        {
            "name": F.when(in_section, party_name(line)),
            "is_fact": _like(line, METADATA_LINE),
            "prose": F.when(in_section, _is_prose(line, F.col("under.role"))).otherwise(False),
            **party_facts(line),
        }
    )
    early = in_section & (nth <= SHOWN_LINES)
    telling = early & ~F.col("is_fact") & ~_is_header(line) & (F.col("prose") | F.col("name").isNotNull())
    lines = lines.withColumns(
        {
            "opening": F.min(F.when(telling, F.struct("i", "prose"))).over(section),
            "has_record": F.max(early & F.col("record").isNotNull()).over(section),
            "prose_at": F.min(F.when(F.col("prose"), i)).over(section),
        }
    )
    listed = in_section & ~F.col("has_record") & ~F.col("opening.prose") & F.coalesce(i < F.col("prose_at"), F.lit(True))
    names_one = F.coalesce(listed, F.lit(False)) & ~F.col("is_fact") & F.col("name").isNotNull()
    running = section.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"names_one": names_one, "seq": F.sum(names_one.cast("int")).over(running)})
    belongs = F.coalesce(listed, F.lit(False)) & (F.col("names_one") | (F.col("is_fact") & (F.col("seq") > 0)))

    facts = [F.col(c) for c in ("status", "shares", "share_percentage")]
    no = F.lit(None).cast("string")
    order = F.create_map(*(x for role, n in _ORDER.items() for x in (F.lit(role), F.lit(n))))

    def part(kind: int, role: Column, at: Column, seq: Column, name: Column, parts: list[Column], facts: list[Column]) -> Column:
        rank = F.coalesce(F.try_element_at(order, role), F.lit(99)) if kind == 2 else F.lit(0)
        return F.struct(
            F.lit(kind).alias("kind"), rank.alias("rank"), at.alias("at"), seq.alias("seq"), role.alias("role"), name.alias("name"),
            *(p.alias(n) for p, n in zip(parts, RECORD_LABELS, strict=True)),
            *(f.alias(n) for f, n in zip(facts, ("status", "shares", "share_percentage"), strict=True)),
        )

    below = F.when(~F.col("below_is_record") & (i - F.col("inside.at") < RECORD_LINES), F.col("below"))
    in_record = F.col("record").isNull() & F.col("inside.role").isNotNull() & (i - F.col("inside.at") <= RECORD_LINES)
    record_parts = [_record_value(line, below, labels) for labels in RECORD_LABELS.values()]
    printed = F.regexp_replace(F.upper(F.regexp_extract(line, INLINE_ROLE, 1)), r"\s+", " ")
    rest = F.regexp_extract(line, INLINE_ROLE, 2)
    inline_name = F.when(_like(line, INLINE_ROLE), party_name(rest))
    none = [no] * len(RECORD_LABELS)
    parts = F.array(
        F.when(in_record, part(0, F.col("inside.role"), F.col("inside.at"), F.lit(0).cast("long"), no, record_parts, facts)),
        F.when(
            inline_name.isNotNull(),
            part(1, F.coalesce(_lookup(INLINE_ROLES, printed), printed), i, F.lit(0).cast("long"), inline_name, none, list(party_facts(rest).values())),
        ),
        F.when(belongs, part(2, F.col("under.role"), F.col("under.at"), F.col("seq"), F.when(F.col("names_one"), F.col("name")), none, facts)),
    )
    rows = lines.select("doc_id", "i", F.explode(F.array_compact(parts)).alias("p")).select("doc_id", "i", "p.*")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), i))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), i))
    single = rows.groupBy("doc_id", "kind", "rank", "at", "seq", "role").agg(
        *(first(c).alias(c) for c in ("name", *RECORD_LABELS)), *(last(c).alias(c) for c in ("status", "shares", "share_percentage"))
    )
    person = none_if_empty(F.concat_ws(" ", "surname", "first_name", "other_name"))
    recorded = F.coalesce("company_name", "full_name", person)
    name = F.when(F.col("kind") == 0, F.when(looks_like_party_name(recorded), recorded)).otherwise(F.col("name"))
    single = single.withColumn("name", name).withColumn("key", F.regexp_replace(F.upper("name"), "[^A-Z0-9]", ""))
    place = F.struct("kind", "rank", "at", "seq")
    earliest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    merged = (
        single.where("name is not null and key <> ''")
        .groupBy("doc_id", "key")
        .agg(
            F.min(place).alias("place"), earliest("name"), F.array_sort(F.collect_set("role")).alias("roles"),
            *(earliest(c) for c in ("status", "shares", "share_percentage")),
        )
    )
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    return (
        merged.withColumn("position", position)
        .where(F.col("position") <= MOST_PARTIES)
        .select("doc_id", "position", "name", "roles", "status", "shares", "share_percentage")
    )
