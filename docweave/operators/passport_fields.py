"""Printed fields of a passport's data page: names, date of issue, and when a printed name is better than the zone's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.textnorm import collapse, none_if_empty

# Words and patterns of printed labels, months.
LABEL_WORDS = (
    "AUTHORITY", "AUTORITE", "CODE", "COUNTRY", "DATE", "DATEOF", "DE", "DELIVRANCE", "DU", "EXPIRATION", "EXPIRY", "FEDERAL",
    "GIVEN", "GIVENNAMES", "GLVEN", "HOLDER", "ISSUE", "LIEU", "NAME", "NAMES", "NATIONALITY", "NATIONALITE", "NATIONALTY",
    "NATIONALTE", "NAISSANCE", "NOM", "NOMS", "PASSPORT", "PASSEPORT", "PAYS", "PLACE", "PRENOM", "PRENOMS", "PREVIOUS",
    "PRECEDENT", "REPUBLIC", "SEXE", "SIGNATURE", "SURNAME", "TITULAIRE", "TYPE",
)
LABEL = (
    r"\b(SUR\s*NAME|SURNAME|SURNAM[E]?|SUMAME|NOM|GIVEN\s*NAMES?|GIVENNAMES|GLVEN|GIV[EF]N|PRENOMS?|NATIONALITY|NATIONALITE"
    r"|NATIONALTY|NATIONALTE|DATE\s*OF|DATEOF|BIRTH|ISSUE|EXPIRY|EXPIRATION|SEX|SEXE|PLACE\s*OF|PASSPORT|PASSEPORT|NIN|AUTHORITY"
    r"|AUTORITE|HOLDER|SIGNATURE|PREVIOUS|PRECEDENT)\b"
)
SURNAME = r"(?i)\bSUR\s*NAME\b|\bSURNAM[E]?\b|\bSUMAME\b|\bNOM\b"
GIVEN = r"(?i)\bGIVEN(?:\s+NAMES?)?\b|\bGIV[EF]N\b|\bPRENOMS?\b"
ISSUE = r"(?i)\bDATE\s+OF\s+ISSUE\b"
ISSUE_LINE = r"(?i)\bDATE\s*OF\s*ISSUE\b|\bDELIVRANCE\b"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_MONTH = "|".join(MONTHS)
DATE = rf"\b([0-9]{{1,2}})\s*({_MONTH})\s*(?:(?:/)?\s*(?:{_MONTH})\s*)?([0-9]{{2,4}})\b"
#: Lines looked at below a label: for a value, and for a date.
BELOW, DATE_BELOW = 4, 3


def visual_line(line: Column) -> Column:
    """Upper case; letters, digits, blanks, slashes and hyphens only."""
    return F.trim(F.regexp_replace(F.upper(line), "[^A-Z0-9 /-]", " "))


def without_labels(line: Column) -> Column:
    """The plain words of a line that are no label words."""
    words = F.split(F.trim(F.regexp_replace(visual_line(line), " +", " ")), " ")
    return F.array_join(F.filter(words, lambda w: F.regexp_like(w, F.lit("^[A-Z0-9]+$")) & ~w.isin(*LABEL_WORDS)), " ")


def has_label(line: Column) -> Column:
    plain = visual_line(line)
    return F.exists(F.split(plain, " +"), lambda w: w.isin(*LABEL_WORDS)) | F.regexp_like(plain, F.lit(LABEL))


def visual_date(value: Column) -> Column:
    """ISO date of a printed one as 15 JAN 2025 or 15 JAN/JAN 25; two-digit years over 40 are 19xx; null without one."""
    text = visual_line(F.replace(value, F.lit("["), F.lit("1")))
    part = lambda g: F.regexp_extract(text, DATE, g)
    number = F.create_map(*(x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))))
    century = F.when(part(3).try_cast("int") > 40, "19").otherwise("20")
    year = F.when(F.length(part(3)) == 2, F.concat(century, part(3))).otherwise(part(3))
    return F.when(part(1) != "", F.concat_ws("-", year, F.try_element_at(number, part(2)), F.lpad(part(1), 2, "0")))


def _date_score(value: Column) -> Column:
    text = visual_line(F.replace(value, F.lit("["), F.lit("1")))
    day = F.regexp_extract(text, rf"\b([0-9]{{1,2}})\s*({_MONTH})", 1)
    points = F.when(F.length(day) == 2, 10).otherwise(0) + F.when(F.contains(text, F.lit("/")), 3).otherwise(0)
    return F.when(day == "", -1).otherwise(points)


def _value_score(value: Column, letters: bool) -> Column:
    compact, words = F.length(F.replace(value, F.lit(" "), F.lit(""))), F.size(F.split(value, " "))
    if not letters:
        return compact
    odd = F.when(F.regexp_like(value, F.lit("^[A-Z ]+$")), 0).otherwise(20) + F.when(compact <= 2, 8).otherwise(0)
    return compact - odd - F.greatest(F.lit(0), words - 2) * 5


def near_label(lines: Column, label: str, letters: bool = True) -> Column:
    """The best value on a line with the label or, up to the next label, below it; null without one.

    Of values with equal scores the first counts. With letters a value is 2 to 40 letters and blanks.
    """
    usable = lambda v: F.regexp_like(v, F.lit("^[A-Z][A-Z -]{1,39}$")) if letters else v != ""

    def around(line: Column, i: Column) -> Column:
        own = without_labels(line)
        open_, below = F.lit(True), F.lit(None).cast("string")
        for k in range(1, BELOW + 1):
            next_ = F.get(lines, i + k)
            open_ = open_ & F.coalesce(~has_label(next_), F.lit(False))
            value = without_labels(next_)
            below = F.coalesce(below, F.when(open_ & usable(value), value))
        return F.when(F.regexp_like(line, F.lit(label)), F.array_compact(F.array(F.when(usable(own), own), below)))

    found = F.flatten(F.filter(F.transform(lines, around), lambda x: x.isNotNull()))
    rated = F.transform(found, lambda v, i: F.struct((-_value_score(v, letters)).alias("rank"), i.alias("i"), v.alias("value")))
    return F.get(F.array_sort(rated), F.lit(0))["value"]


def issue_date(lines: Column) -> Column:
    """The date on a line with an issue label or on the three after it; of several the most complete, then the first."""

    def around(line: Column, i: Column) -> Column:
        near = F.array(line, *(F.get(lines, i + k) for k in range(1, DATE_BELOW + 1)))
        dated = F.transform(near, lambda x: F.struct((-_date_score(x)).alias("rank"), visual_date(x).alias("date")))
        return F.when(F.regexp_like(line, F.lit(ISSUE_LINE)), F.filter(dated, lambda d: d["date"].isNotNull()))

    found = F.flatten(F.filter(F.transform(lines, around), lambda x: x.isNotNull()))
    rated = F.transform(found, lambda d, i: F.struct(d["rank"].alias("rank"), i.alias("i"), d["date"].alias("date")))
    return F.get(F.array_sort(rated), F.lit(0))["date"]


def prefer_printed(zone_name: Column, printed: Column) -> Column:
    """Whether the printed name replaces the zone's: the zone has none, or four letters at most and two fewer."""
    plain = without_labels(printed)
    letters = lambda c: F.regexp_replace(F.upper(c), "[^A-Z]", "")
    zone, own = F.coalesce(letters(zone_name), F.lit("")), letters(plain)
    shaped = (F.length(own) >= 3) & F.regexp_like(plain, F.lit("^[A-Z][A-Z -]{2,39}$"))
    longer = (F.length(zone) <= 4) & (F.length(own) >= F.length(zone) + 2)
    return F.coalesce(shaped & (zone != own) & ((zone == "") | longer), F.lit(False))


def visual_fields(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per data page: surname, given_names, date_of_issue as printed, null if not found. Null texts have nothing."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: collapse(x) != "")
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, lines.alias("_lines"))
    return base.select(
        "doc_id",
        *keep,
        none_if_empty(near_label(F.col("_lines"), SURNAME)).alias("surname"),
        none_if_empty(near_label(F.col("_lines"), GIVEN)).alias("given_names"),
        F.coalesce(issue_date(F.col("_lines")), visual_date(near_label(F.col("_lines"), ISSUE, letters=False))).alias("date_of_issue"),
    )


def with_printed_names(passports: DataFrame, printed: DataFrame) -> DataFrame:
    """Passport records with the printed surname and given names where these are better, and the date of issue.

    Both have one row per doc_id; passports without a data page stay as they are.
    """
    page = printed.select(
        F.col("doc_id").alias("_page"), F.col("surname").alias("_surname"), F.col("given_names").alias("_given_names"), "date_of_issue"
    )
    joined = passports.join(page, passports["doc_id"].eqNullSafe(page["_page"]), "left")
    better = {c: F.when(prefer_printed(F.col(c), F.col(f"_{c}")), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("surname", "given_names")}
    return joined.withColumns(better).drop("_page", "_surname", "_given_names")
