"""Label/value pairs and labelled fields over the lines of a document."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.textnorm import bound, collapse, normalize_business_text, normalize_label

# Labels of known fields, in order of precedence, and wording that is no label or no field.
KNOWN_LABELS = (
    ("legal_company_name", "LEGAL COMPANY NAME", "LEGAL ENTITY NAME", "NAME OF COMPANY", "COMPANY NAME", "ENTITY NAME", "REGISTERED NAME"),
    ("trading_name", "TRADING NAME", "TRADE NAME", "DBA", "DOING BUSINESS AS"),
    ("principal_business_address", "PRINCIPAL BUSINESS ADDRESS", "PRINCIPAL PLACE OF BUSINESS", "HEAD OFFICE ADDRESS", "BUSINESS ADDRESS"),
    ("issuing_authority", "ISSUING AUTHORITY", "ISSUED BY", "REGISTRY AUTHORITY", "REGISTERING AUTHORITY", "REGISTRAR NAME"),
    ("document_reference_number", "DOCUMENT REFERENCE NUMBER", "DOCUMENT REFERENCE", "REFERENCE NUMBER", "REFERENCE NO", "CERTIFICATE NUMBER", "CERTIFICATE NO"),
    ("country_of_incorporation", "COUNTRY OF INCORPORATION", "COUNTRY OF FORMATION", "COUNTRY OF REGISTRATION", "REGISTERED COUNTRY"),
    ("jurisdiction_of_incorporation", "JURISDICTION OF INCORPORATION", "STATE OF INCORPORATION", "FORMATION STATE", "REGISTERED IN"),
    ("document_issue_date", "DOCUMENT ISSUE DATE", "ISSUE DATE", "DATE OF ISSUE", "CERTIFICATE DATE"),
    ("incorporation_date", "DATE OF FORMATION", "FORMATION DATE", "DATE OF INCORPORATION", "INCORPORATION DATE"),
    ("company_status", "COMPANY STATUS", "ENTITY STATUS", "REGISTRATION STATUS", "STATUS"),
    ("entity_type", "COMPANY TYPE", "ENTITY TYPE", "TYPE OF COMPANY"),
    ("business_activities", "BUSINESS ACTIVITIES", "NATURE OF BUSINESS", "PRINCIPAL ACTIVITY", "LINE OF BUSINESS"),
)
CORE_PREFIXES = (
    "ADDRESS OF REGISTERED", "COMPANY NAME", "ENTITY NAME", "NAME OF COMPANY", "REGISTERED NAME", "REGISTRATION NUMBER",
    "COMPANY NUMBER", "ENTITY NUMBER", "DATE OF INCORPORATION", "DATE OF REGISTRATION", "REGISTERED OFFICE",
    "COMPANY STATUS", "ENTITY STATUS", "TAX IDENTIFICATION", "EMPLOYER IDENTIFICATION", "ENTITY ID", "STATE FILING",
    "REGISTRY IDENTIFIER", "REGISTRY NUMBER", "DOCUMENT REFERENCE", "CERTIFICATE NUMBER", "DIRECTOR", "SHAREHOLDER",
    "BENEFICIAL OWNER", "SHARE CAPITAL", "PAID UP CAPITAL", "PAID-UP CAPITAL", "OBJECTS OF THE COMPANY", "OBJECTS", "NAME",
    "PERCENTAGE", "SHARES",
)
NO_LABELS = ("OF", "THE", "AND", "NAME", "STATUS", "PERCENTAGE")
NO_LABEL_PATTERNS = (
    r"\d",
    r"(?i)\b(?:ACTIVE|INACTIVE|CEASED|RESIGNED|DISSOLVED)\b$",
    r"(?i)\b(?:LIMITED|LTD|LLC|PLC|INCORPORATED|INC|CORPORATION|CORP|REGISTRY|REGISTRAR|COMMISSION|SECRETARY\s+OF\s+STATE"
    r"|CERTIFICATE|ARTICLES|MEMORANDUM)\b",
    r"(?i)^(?:FEDERAL\s+REPUBLIC|REPUBLIC\s+OF|STATE\s+OF|DIVISION\s+OF|THIS\s+IS\s+TO\s+CERTIFY|OBJECTS?\s+OF|SHAREHOLDERS?"
    r"|DIRECTORS?|BENEFICIAL\s+OWNERS?)\b",
    r"[.;]$",
)
SECTION_HEADING = (
    r"(?i)^(?:OBJECTS?(?:\s+OF\s+THE\s+COMPANY)?|SHARE\s+CAPITAL|DIRECTORS?|SHAREHOLDERS?|BENEFICIAL\s+OWNERS?|SUBSCRIBERS?"
    r"|MEMORANDUM|ARTICLES)\s*[:.-]?$"
)
INLINE = r"^([A-Za-z][A-Za-z0-9 &'()./-]{1,60}?)\s*(?:[:#]|\s[-–—]\s)\s*(.+)$"
#: Each inline pair has one of them.
INLINE_MARKS = (":", "#", "-", "–", "—")
NOISY_LABEL = (
    r"^(?:EMAIL(?: ADDRESS)?|PHONE(?: NUMBER)?|TELEPHONE|MOBILE|RESIDENTIAL ADDRESS|CONTACT ADDRESS|SIGNATURES?|SIGNED BY"
    r"|WITNESS(?: DETAILS)?|PRESENTED BY|DETAILS|PARTICULARS|OTHER INFORMATION|PERSONAL INFORMATION|SIGNATORY DETAILS"
    r"|DIRECTORS?|SHAREHOLDERS?|SUBSCRIBERS?|BENEFICIAL OWNERS?|PERSONS? WITH SIGNIFICANT CONTROL)$"
)
NOISY_VALUE = (
    r"^(?:DIRECTORS?|SHAREHOLDERS?|SUBSCRIBERS?|BENEFICIAL OWNERS?|PERSONS? WITH SIGNIFICANT CONTROL|SIGNATURES?"
    r"|REGISTRAR|REGISTRAR GENERAL)$"
)
NEW_LABEL = (
    r"(?i)^(?:COMPANY|ENTITY|BUSINESS|REGISTERED|HEAD\s+OFFICE|REGISTRATION|INCORPORATION|DOCUMENT|REPORT|NATURE\s+OF\s+BUSINESS"
    r"|PRINCIPAL\s+ACTIVITY|STATUS|DATE|EMAIL|PHONE|TELEPHONE|TIN|TAX|SHARE|DIRECTORS?|SHAREHOLDERS?|SECRETARY|SUBSCRIBERS?"
    r"|OBJECTS?)\b"
)
_MARKS = " :#.-"
#: label, field and order of all known labels.
LABEL_FIELDS = tuple((normal, field) for field, *labels in KNOWN_LABELS for normal in labels)
_BEGINS = f"^({'|'.join(x for x, _ in LABEL_FIELDS)})"


def lines_of(text: Column) -> Column:
    """The normalised lines of a document."""
    return F.filter(F.split(normalize_business_text(text), "\n"), lambda x: x != "")


def looks_like_label(line: Column) -> Column:
    """A known label, or 1 to 7 words in capitals or title case without digits and legal wording."""
    normal = normalize_label(line)
    words = F.regexp_count(line, F.lit("[A-Za-z0-9]+"))
    # Title case: every word begins with a capital and goes on in small letters.
    title = F.regexp_like(line, F.lit(r"[A-Z]")) & ~F.regexp_like(line, F.lit(r"(?:^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]"))
    shaped = F.regexp_like(line, F.lit("[A-Za-z]")) & ((line == F.upper(line)) | title)
    plain = ~normal.isin(*NO_LABELS) & (words >= 1) & (words <= 7) & (F.length(line) <= 60) & shaped
    for pattern in NO_LABEL_PATTERNS:
        plain = plain & ~F.regexp_like(line, F.lit(pattern))
    return normal.isin(*(x[0] for x in LABEL_FIELDS)) | plain


def canonical_field(label: Column) -> Column:
    """The field of a label: an exact known label, else the first that it begins with."""
    normal = normalize_label(label)
    fields = F.create_map(*(F.lit(x) for pair in LABEL_FIELDS for x in pair))
    return F.coalesce(F.try_element_at(fields, normal), F.try_element_at(fields, F.regexp_extract(normal, _BEGINS, 1)))


def label_values(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, label, value, excerpt, confidence): inline pairs (.76) and a label over its value (.66).

    Equal pairs, whatever their case, are kept once, at their first line. Labels are at most 60 characters with two
    letters, values at most 1000 with a letter or digit. Null texts have no pairs.
    """
    # What is asked more than once of a line or pair is a part of an exploded row: a filter would work it out again.
    marked = lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(m)) for m in INLINE_MARKS))
    is_inline = lambda x: marked(x) & F.regexp_like(x, F.lit(INLINE))
    lines = docs.select(F.col(id_col).alias("doc_id"), lines_of(F.col(text_col)).alias("_lines")).select(
        "doc_id", F.posexplode(F.zip_with("_lines", F.slice(F.concat("_lines", F.array(F.lit(None).cast("string"))), F.lit(2), F.size("_lines")), lambda a, b: F.struct(a.alias("line"), b.alias("next"), is_inline(a).alias("inline")))).alias("line_no", "_l")
    )
    line, below = F.col("_l.line"), F.col("_l.next")
    inline = F.col("_l.inline")
    adjacent = (
        ~inline & below.isNotNull() & looks_like_label(line) & ~looks_like_label(below) & ~F.regexp_like(below, F.lit(SECTION_HEADING))
    )
    clean = lambda v: F.btrim(collapse(v), F.lit(_MARKS))
    pair = F.struct(
        clean(F.when(inline, F.regexp_extract(line, INLINE, 1)).otherwise(line)).alias("label"),
        clean(F.when(inline, F.regexp_extract(line, INLINE, 2)).otherwise(below)).alias("value"),
        F.substring(F.when(inline, line).otherwise(F.concat(line, F.lit(" | "), below)), 1, 1200).alias("excerpt"),
        F.when(inline, 0.76).otherwise(0.66).alias("confidence"),
    )
    pairs = lines.where(inline | adjacent).select("doc_id", "line_no", F.explode_outer(F.array(pair)).alias("p")).select("doc_id", "line_no", "p.*")
    valid = (
        (F.length("label") <= 60)
        & F.col("value").rlike("[A-Za-z0-9]")
        & (F.length("value") <= 1000)
        & (F.length(F.regexp_replace("label", "[^A-Za-z]", "")) >= 2)
        & (F.lower("label") != F.lower("value"))
    )
    first = F.row_number().over(Window.partitionBy("doc_id", F.lower("label"), F.lower("value")).orderBy("line_no"))
    return pairs.where(valid).withColumn("_n", first).where("_n = 1").drop("_n")


def additional_fields(pairs: DataFrame, limit: int = 50) -> DataFrame:
    """The pairs that are neither known or core fields nor layout or personal fragments; the first limit a document."""
    label, value = normalize_label(F.col("label")), normalize_label(F.col("value"))
    core = label.rlike(f"^(?:{'|'.join(CORE_PREFIXES)})| SHARES$")
    noisy = (
        label.rlike(NOISY_LABEL)
        | value.rlike(NOISY_VALUE)
        | ((label == "OF A") & value.rlike(r"\b(?:PRIVATE|PUBLIC)\s+COMPANY\b"))
        | (label.isin("REGISTRAR", "THE REGISTRAR") & value.rlike(r"\bGENERAL\b"))
    )
    kept = pairs.where(~label.rlike(_BEGINS) & ~core & ~noisy)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limit)


def looks_like_heading(line: Column) -> Column:
    letters = F.regexp_like(line, F.lit("[A-Z]"))
    return (F.length(line) <= 70) & letters & (line == F.upper(line)) & ~F.regexp_like(line, F.lit(r"\d"))


def _continued(found: Column, line: Column) -> Column:
    """A value with one more line, unless that is a label or heading or one before it was."""
    goes = found["open"] & F.coalesce(~F.regexp_like(line, F.lit(NEW_LABEL)) & ~looks_like_heading(line), F.lit(False))
    more = lambda part, by: F.when(goes, F.concat(found[part], F.lit(by), line)).otherwise(found[part]).alias(part)
    return F.struct(more("value", " "), more("excerpt", " | "), goes.alias("open"), found["next"].alias("next"))


def labelled_at(lines: Column, labels: tuple[str, ...]) -> Column:
    """Where lines begin with one of the labels, from 0: the lines that labelled() need look at."""
    pattern = rf"(?i)^\s*(?:{'|'.join(f'(?:{x})' for x in labels)})"
    return F.filter(F.transform(lines, lambda x, i: F.when(F.regexp_like(x, F.lit(pattern)), i)), lambda i: i.isNotNull())


def labelled(lines: Column, labels: tuple[str, ...], valid: Callable[[Column], Column], more: int = 0, among: Column | None = None) -> Column:
    """(value, excerpt) of the first line that begins with a label and has a valid value; null without one.

    The value follows on the line, else it is the next line unless that is a label. Up to more further lines are
    added until a label or heading. among: a column of labelled_at() for these labels or more, of lines that begin
    as these do.
    """
    pattern = rf"(?i)^\s*(?:{'|'.join(f'(?:{x})' for x in labels)})\s*(?:[:#.-]\s*|\s+)?(.*)$"
    marks = F.lit(_MARKS)

    def from_(line: Column, i: Column, inline: Column) -> Column:
        below = F.get(lines, i + 1)
        takes = (inline == "") & below.isNotNull() & ~F.regexp_like(below, F.lit(NEW_LABEL))
        value = F.when(inline != "", inline).when(takes, below).otherwise("")
        excerpt = F.when(takes, F.concat(line, F.lit(" | "), below)).otherwise(line)
        found = F.struct(value.alias("value"), excerpt.alias("excerpt"), F.lit(True).alias("open"), (i + 1 + takes.cast("int")).alias("next"))
        for k in range(more):
            found = bound(found, lambda f, k=k: _continued(f, F.get(lines, f["next"] + k)))
        return bound(found, lambda f: F.struct(F.btrim(f["value"], marks).alias("value"), f["excerpt"].alias("excerpt")))

    # Only lines with the label are looked at further, until the first valid value.
    among = labelled_at(lines, labels) if among is None else among
    at = F.filter(among, lambda i: F.regexp_like(F.get(lines, i), F.lit(pattern)))
    value_at = lambda i: bound(F.get(lines, i), lambda x: from_(x, i, F.btrim(F.regexp_extract(x, pattern, 1), marks)))
    found = F.filter(F.transform(at, value_at), lambda x: (x["value"] != "") & F.coalesce(valid(x["value"]), F.lit(False)))
    return F.get(found, F.lit(0))
