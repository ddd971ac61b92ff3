"""Normalisers of document text as Column functions. A null argument gives null unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, phrases, codes and patterns, in order of precedence.
MONTHS = {
    "JAN": 1, "JANUARY": 1, "FEB": 2, "FEBRUARY": 2, "MAR": 3, "MARCH": 3, "APR": 4, "APRIL": 4, "MAY": 5, "JUN": 6,
    "JUNE": 6, "JUL": 7, "JULY": 7, "AUG": 8, "AUGUST": 8, "SEP": 9, "SEPT": 9, "SEPTEMBER": 9, "OCT": 10, "OCTOBER": 10,
    "NOV": 11, "NOVEMBER": 11, "DEC": 12, "DECEMBER": 12,
}
JOINED_ENTITY_TYPES = (
    "PUBLIC_COMPANY_LIMITED_BY_SHARES", "PRIVATE_COMPANY_LIMITED_BY_SHARES", "COMPANY_LIMITED_BY_GUARANTEE",
    "LIMITED_LIABILITY_COMPANY", "LIMITED_LIABILITY_PARTNERSHIP", "UNLIMITED_COMPANY", "INCORPORATED_TRUSTEE",
)
ENTITY_TYPES = (
    ("COMPANY_LIMITED_BY_GUARANTEE", r"\b(?:COMPANY\s+)?LIMITED\s+BY\s+GUARANTEE\b|\bLTD\s*/?\s*GTE\b"),
    ("PUBLIC_COMPANY_LIMITED_BY_SHARES", r"\bPUBLIC\s+(?:LIMITED\s+)?COMPANY\b|\bPLC\b"),
    ("PRIVATE_COMPANY_LIMITED_BY_SHARES", r"\bPRIVATE\s+(?:LIMITED\s+)?COMPANY\b"),
    ("LIMITED_LIABILITY_COMPANY", r"\bLIMITED\s+LIABILITY\s+COMPANY\b|\bLLC\b"),
    ("LIMITED_LIABILITY_PARTNERSHIP", r"\bLIMITED\s+LIABILITY\s+PARTNERSHIP\b|\bLLP\b"),
    ("UNLIMITED_COMPANY", r"\bUNLIMITED\s+COMPANY\b"),
    ("INCORPORATED_TRUSTEE", r"\bINCORPORATED\s+TRUSTEE"),
    ("BUSINESS_NAME", r"\bBUSINESS\s+NAME\b|\bSOLE\s+PROPRIETOR"),
    ("PARTNERSHIP", r"\bPARTNERSHIP\b"),
    ("COMPANY_LIMITED_BY_SHARES", r"\bLIMITED\s+BY\s+SHARES\b"),
    ("LIMITED_COMPANY", r"\b(?:LTD|LIMITED)\b"),
    ("CORPORATION", r"\b(?:INC|INCORPORATED|CORPORATION|CORP)\b"),
)
COMPANY_STATUSES = (
    ("IN_LIQUIDATION", r"\b(?:IN\s+)?LIQUIDATION\b|\bWINDING\s+UP\b"),
    ("DISSOLVED", r"\bDISSOLVED\b"),
    ("STRUCK_OFF", r"\bSTRUCK\s+OFF\b"),
    ("INACTIVE", r"\bINACTIVE\b|\bNOT\s+ACTIVE\b"),
    ("ACTIVE", r"\bACTIVE\b|\bLIVE\b|\bIN\s+GOOD\s+STANDING\b"),
    ("REGISTERED", r"\bREGISTERED\b"),
)
JOINED_LABELS = (
    "COMPANY NAME", "ENTITY NAME", "BUSINESS NAME", "REGISTRATION NUMBER", "REGISTRATION NO", "REGISTERED NUMBER",
    "COMPANY NUMBER", "DATE OF INCORPORATION", "DATE OF REGISTRATION", "REGISTRATION DATE", "REGISTERED ADDRESS",
    "REGISTERED OFFICE", "HEAD OFFICE ADDRESS", "COMPANY TYPE", "ENTITY TYPE", "FIRST NAME", "OTHER NAME", "FULL NAME",
    "COMPANY STATUS", "ENTITY STATUS", "SHARE CAPITAL", "NATURE OF BUSINESS", "PRINCIPAL ACTIVITY",
    "TOTAL NUMBER OF SHARES", "SHARE PERCENTAGE", "PERSONS WITH SIGNIFICANT CONTROL", "TAX IDENTIFICATION NUMBER",
)
NAME_LABEL = (
    r"(?i)^(?:NAME\s+OF\s+(?:THE\s+)?COMPANY|LEGAL\s+(?:COMPANY|ENTITY)\s+NAME|COMPANY\s+NAME|ENTITY\s+NAME"
    r"|BUSINESS\s+NAME)\s*[:#-]?\s*"
)
NAME_TAIL = r"(?i)\s+(?:IS|WAS|HAS\s+BEEN)\s+(?:HEREBY\s+)?(?:INCORPORATED|REGISTERED)\b.*$"
CURRENCY_CODES = {
    "NGN": "NGN", "NAIRA": "NGN", "₦": "NGN", "N": "NGN", "GHS": "GHS", "GH₵": "GHS", "CEDI": "GHS", "CEDIS": "GHS",
    "USD": "USD", "US$": "USD", "GBP": "GBP", "£": "GBP", "EUR": "EUR", "€": "EUR", "KES": "KES", "KSH": "KES",
    "ZAR": "ZAR", "R": "ZAR", "CAD": "CAD", "C$": "CAD", "CA$": "CAD", "AUD": "AUD", "A$": "AUD", "AU$": "AUD",
}


def collapse(value: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def collapse_untidy(value: Column) -> Column:
    """collapse() for texts that mostly need none: a look at the bytes tells most of them, and only the others are rewritten.

    Plain ASCII with no two spaces in a row and no other white space is as collapse() would leave it, but for its ends.
    """
    tidy = F.octet_length(value) == F.char_length(value)
    for mark in ("  ", "\n", "\t", "\r", "\f", "\x0b"):
        tidy = tidy & ~F.contains(value, F.lit(mark))
    return F.when(tidy, F.trim(value)).otherwise(collapse(value))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once and named, however often it is used: keeps plans and their work small."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def none_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def first_group(value: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return none_if_empty(F.regexp_extract(value, pattern, group))


def first_rule(value: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The code of the first rule whose pattern is found."""
    return F.coalesce(*(F.when(F.regexp_like(value, F.lit(p)), F.lit(code)) for code, p in rules))


def first_match(value: Column, pattern: str, group: int = 1) -> Column:
    """First group of a case-insensitive match, collapsed and without punctuation at its ends."""
    return none_if_empty(F.btrim(collapse(F.regexp_extract(value, f"(?i){pattern}", group)), F.lit(" :;,.|-")))


def plain_dashes(value: Column) -> Column:
    return F.translate(value, "–—", "--")


def normalize_business_text(value: Column, columns: bool = False) -> Column:
    """Line ends to \\n, dashes and no-break spaces plain, pipes to spaces; joined labels parted; no empty lines.

    Null gives an empty text. A joined label counts if a mark of :#.-_ follows or it is all upper case. With columns,
    runs of spaces and pipes, which part the cells of tables, stay.
    """
    spelled = lambda label: "[^A-Za-z]*".join(label.replace(" ", ""))
    joined = f"^[^A-Za-z]*({'|'.join(rf'(?i:{spelled(x)})(?=[:#.\-_])|{spelled(x)}' for x in JOINED_LABELS)})"
    labels = F.create_map(*(F.lit(x) for label in JOINED_LABELS for x in (label.replace(" ", ""), label)))
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"\r\n?", "\n")
    text = F.translate(plain_dashes(text), " ", " ")

    def line(raw: Column) -> Column:
        if columns:
            out = F.regexp_replace(F.regexp_replace(raw, r"\t+", "    "), r"\s*\|+\s*", " | ")
            out = F.trim(F.regexp_replace(out, r"[\f\x0B]+", " "))
        else:
            out = F.trim(F.regexp_replace(F.regexp_replace(raw, r"\|+", " "), r"[ \t\f\x0B]+", " "))
        out = F.regexp_replace(
            out, r"(?i)^HEAD[\s_]*OFFICE[\s_]*ADDRESS(?=$|[\s:#.\-_]|\d)[ :#._-]*", "HEAD OFFICE ADDRESS "
        )

        def parted(out: Column, found: Column) -> Column:
            label = F.try_element_at(labels, F.regexp_replace(F.upper(found), "[^A-Z]", ""))
            rest = F.ltrim(F.substr(out, F.length(found) + 1), F.lit(" :-._"))
            return F.trim(F.when(found != "", F.concat(label, F.lit(" "), rest)).otherwise(out))

        return bound(out, lambda o: bound(F.regexp_extract(o, joined, 1), lambda f: parted(o, f)))

    return F.array_join(F.filter(F.transform(F.split(text, "\n"), line), lambda x: x != ""), "\n")


def normalize_company_name(value: Column) -> Column:
    """A legal name without its label, what follows it in a sentence, and marks at its ends; at most 180 characters."""
    name = F.regexp_replace(F.regexp_replace(collapse(value), NAME_LABEL, ""), NAME_TAIL, "")
    return none_if_empty(F.substring(F.btrim(name, F.lit(" :;,.-_\"'“”")), 1, 180))


def normalize_identifier(value: Column) -> Column:
    """Upper case, tight / and -, nothing else but letters and digits; at most 64 characters."""
    text = F.btrim(F.upper(value), F.lit(" :;,.#"))
    text = F.regexp_replace(F.regexp_replace(text, r"\s*([/-])\s*", "$1"), r"[^A-Z0-9/-]", "")
    return none_if_empty(F.substring(text, 1, 64))


def _full_year(year: Column) -> Column:
    return F.when(year >= 100, year).when(year <= 40, year + 2000).otherwise(year + 1900)


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd, null for what is no calendar date."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd").cast("string")


def parse_date(value: Column, country: Column | None = None) -> Column:
    """ISO date of a registry date: yyyy-m-d, d MON y, MON d y, or numbers.

    The first form found decides, even if its date does not exist. Of two numbers up to 12 the first is the day,
    in the USA the month. Two-digit years up to 40 are 20xx.
    """
    text = F.translate(F.upper(value), ",", " ")
    for pattern, by in (
        (r"\b(?:MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY|SATURDAY|SUNDAY)\b", " "),
        (r"\b(\d{1,2})(?:ST|ND|RD|TH)\b", "$1"),
        (r"\b(?:THIS|THE|DAY\s+OF|DAY|DATED|DATE)\b", " "),
        (r"(\d)([A-Z])", "$1 $2"),
        (r"([A-Z])(\d)", "$1 $2"),
    ):
        text = F.regexp_replace(text, pattern, by)
    return bound(collapse(text), lambda t: _dated(t, country))


def _dated(text: Column, country: Column | None) -> Column:
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    month_of = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    forms = (
        r"\b(19\d{2}|20\d{2})[./-](\d{1,2})[./-](\d{1,2})\b",
        rf"\b(\d{{1,2}})\s+({names})\s+(\d{{2,4}})\b",
        rf"\b({names})\s+(\d{{1,2}})\s+(\d{{2,4}})\b",
        r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})\b",
    )
    part = lambda form, k: F.regexp_extract(text, forms[form], k)
    number = lambda form, k: part(form, k).try_cast("int")
    a, b = number(3, 1), number(3, 2)
    month_first = (b > 12) & (a <= 12)
    if country is not None:
        month_first = month_first | ((a <= 12) & (b <= 12) & F.coalesce(F.upper(country) == "USA", F.lit(False)))
    dates = (
        iso_date(number(0, 1), number(0, 2), number(0, 3)),
        iso_date(_full_year(number(1, 3)), F.try_element_at(month_of, part(1, 2)), number(1, 1)),
        iso_date(_full_year(number(2, 3)), F.try_element_at(month_of, part(2, 1)), number(2, 2)),
        iso_date(_full_year(number(3, 3)), F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a)),
    )
    out = F.when(F.regexp_like(text, F.lit(forms[0])), dates[0])
    for form, date in zip(forms[1:], dates[1:], strict=True):
        out = out.when(F.regexp_like(text, F.lit(form)), date)
    return out


def normalize_entity_type(value: Column) -> Column:
    """Printed company type to a code; spelled-together phrases first."""

    def of(text: Column) -> Column:
        known = [F.when(F.contains(F.translate(text, " ", ""), F.lit(c.replace("_", ""))), F.lit(c)) for c in JOINED_ENTITY_TYPES]
        return F.coalesce(*known, first_rule(text, ENTITY_TYPES))

    return bound(F.trim(F.regexp_replace(F.upper(value), "[^A-Z0-9]+", " ")), of)


def normalize_company_status(value: Column) -> Column:
    return bound(F.trim(F.regexp_replace(F.upper(value), "[^A-Z]+", " ")), lambda text: first_rule(text, COMPANY_STATUSES))


def normalize_gender(value: Column) -> Column:
    text = F.upper(F.trim(value))
    return F.when(text.isin("M", "MALE"), "MALE").when(text.isin("F", "FEMALE"), "FEMALE").otherwise(none_if_empty(text))


def normalize_label(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z0-9]+", " "))


def identifier_key(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def confidence_level(score: Column) -> Column:
    """HIGH from .85, MEDIUM from .65, LOW from .40, else REJECT; null counts as 0."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= 0.85, "HIGH").when(s >= 0.65, "MEDIUM").when(s >= 0.40, "LOW").otherwise("REJECT")


def unique_clean(values: Column, limit: int = 100) -> Column:
    """Array of collapsed strings without marks at their ends, the first of each spelling, whatever its case."""
    clean = F.filter(
        F.transform(values, lambda v: F.btrim(collapse(F.coalesce(v, F.lit(""))), F.lit(" :;,.-"))), lambda v: v != ""
    )
    kept = F.filter(clean, lambda v, i: F.array_position(F.transform(clean, F.lower), F.lower(v)) == i + 1)
    return F.slice(kept, 1, limit)


def resolve_currency(value: Column, country: Column) -> Column:
    """ISO code of a printed currency; a bare $ only where the country has dollars."""
    text = F.upper(F.regexp_replace(value, r"\s+", ""))
    bare = F.create_map(*(F.lit(x) for x in ("USA", "USD", "CAN", "CAD", "AUS", "AUD")))
    known = F.create_map(*(F.lit(x) for pair in CURRENCY_CODES.items() for x in pair))
    return F.when(text == "$", F.try_element_at(bare, F.upper(country))).otherwise(F.try_element_at(known, text))


def normalize_decimal(value: Column) -> Column:
    """A printed amount as a plain decimal string, null for what is no number."""
    digits = F.regexp_replace(value, r"[,\s]", "")
    plain = F.when(F.regexp_like(digits, F.lit(r"^\d+(\.\d+)?$")), digits)
    return F.regexp_replace(plain, r"^0+(?=\d)", "")


def evidence_excerpt(text: Column, start: Column, end: Column, radius: int = 70) -> Column:
    """What surrounds [start, end), collapsed, at most 240 characters."""
    first = F.greatest(F.lit(0), start - radius)
    return F.substring(collapse(F.substr(text, first + 1, end + radius - first)), 1, 240)
