"""Passport machine-readable zones: candidates, pair selection, repair, check digits, record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the zone's format (ICAO 9303, TD3) and of likely misreadings.
WIDTH = 44
_VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONFUSIONS = {"2": "5", "5": "2S", "8": "B3", "B": "86", "0": "OD", "O": "0", "6": "B8", "S": "5"}
LINE1 = r"^[A-Z<]{2}[A-Z]{3}(?=.*<<)[A-Z0-9<]{39}$"
LINE2 = r"^[A-Z0-9<]{9}\d[A-Z]{3}\d{6}\d[MF<]\d{6}\d[A-Z0-9<]{14}\d\d$"


@dataclass(frozen=True)
class CountryProfile:
    """An identity-document profile."""

    code: str
    name: str
    mrz_codes: tuple[str, ...]
    documents: tuple[tuple[str, str], ...]
    personal_number: str = "personal_number"


# Fixed values; a zone is matched against the profiles in this order.
COUNTRIES = (
    CountryProfile("GHA", "Ghana", ("GHA", "GH4", "6HA"), (
        ("DRIVERS_LICENSE", "Driver's license"),
        ("GHANA_CARD", "Ghana national identity card"),
        ("SSNIT_NUMBER", "Social Security and National Insurance Trust number"),
        ("TAX_IDENTIFICATION_NUMBER", "Tax Identification Number"),
        ("VOTER_ID", "Voter identity card"),
    )),
    CountryProfile("NGA", "Nigeria", ("NGA", "NGE", "NG4", "N6A", "N64", "NGR"), (
        ("BVN", "Bank Verification Number"),
        ("DRIVERS_LICENSE", "Driver's license"),
        ("NIN_CARD", "National Identification Number card"),
        ("NIN_SLIP", "National Identification Number slip"),
        ("TAX_IDENTIFICATION_NUMBER", "Tax Identification Number"),
        ("VOTER_CARD", "Permanent voter card"),
    ), "nin"),
)


def country_listing(spark) -> DataFrame:
    """The country profiles as a dimension, by code."""
    rows = [
        (c.code, c.name, sorted(c.mrz_codes), [{"code": a, "name": b} for a, b in sorted(c.documents)], c.personal_number)
        for c in COUNTRIES
    ]
    return spark.createDataFrame(
        rows,
        "country_code string, country_name string, mrz_code_aliases array<string>, "
        "supported_identity_documents array<struct<code:string,name:string>>, passport_personal_number_label string",
    ).orderBy("country_code")


def check_digit(value: Column) -> Column:
    """Weights 7, 3, 1 over digits, letters from 10 on, and 0 for anything else; modulo 10."""
    weighted = F.transform(
        F.split(value, ""),
        lambda c, i: F.greatest(F.instr(F.lit(_VALUES), c) - 1, F.lit(0)) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), i % 3 + 1),
    )
    return (F.aggregate(weighted, F.lit(0), lambda a, b: a + b) % 10).cast("string")


def _sub(value: Column, start: int, end: int) -> Column:
    return F.substring(value, start + 1, end - start)


def check_digits_valid(line2: Column) -> Column:
    """All five check digits of a second line of the right shape."""
    composite = F.concat(_sub(line2, 0, 10), _sub(line2, 13, 20), _sub(line2, 21, 43))
    pairs = ((_sub(line2, 0, 9), 9), (_sub(line2, 13, 19), 19), (_sub(line2, 21, 27), 27), (_sub(line2, 28, 42), 42), (composite, 43))
    valid = F.regexp_like(line2, F.lit(LINE2))
    for value, at in pairs:
        valid = valid & (check_digit(value) == _sub(line2, at, at + 1))
    return valid


def mrz_country(issuing: Column, nationality: Column) -> Column:
    """The code of the first profile that knows the issuing code or has the nationality; null without one."""
    return F.coalesce(*(F.when(issuing.isin(*c.mrz_codes) | (nationality == c.code), F.lit(c.code)) for c in COUNTRIES))


def _letters(line1: Column) -> Column:
    """Digits misread for letters in the name part of a full line."""
    return F.concat(_sub(line1, 0, 5), F.translate(_sub(line1, 5, WIDTH), "015", "OIS"))


def _with_country(line1: Column, line2: Column) -> Column:
    known = mrz_country(_sub(line1, 2, 5), _sub(line2, 10, 13))
    return F.when(known.isNotNull(), F.concat(_sub(line1, 0, 2), known, _sub(line1, 5, WIDTH))).otherwise(line1)


def _name(line1: Column, part: int) -> Column:
    return F.trim(F.translate(F.coalesce(F.get(F.split(_sub(line1, 5, WIDTH), "<<"), F.lit(part)), F.lit("")), "<", " "))


def _line1_score(line1: Column, line2: Column) -> Column:
    fixed = _with_country(line1, line2)
    surname, given = _name(fixed, 0), _name(fixed, 1)
    long_s, long_g = F.length(F.replace(surname, F.lit(" "), F.lit(""))), F.length(F.replace(given, F.lit(" "), F.lit("")))
    points = (
        F.when(F.startswith(fixed, F.lit("P")), 20).otherwise(0)
        + F.when(mrz_country(_sub(fixed, 2, 5), _sub(line2, 10, 13)).isNotNull(), 20).otherwise(0)
        + F.least(long_s, F.lit(12))
        + F.least(long_g, F.lit(12))
        + F.when(F.contains(given, F.lit(" ")), 8).otherwise(0)
        - F.when(long_s < 2, 12).otherwise(0)
        - F.when(long_g < 3, 12).otherwise(0)
        - F.when(F.regexp_like(F.concat(surname, given), F.lit(r"\d")), 20).otherwise(0)
    )
    return F.when(F.regexp_like(fixed, F.lit(LINE1)), points).otherwise(-100)


def _mrz_name(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(value), r"[\s-]+", "<"), "[^A-Z<]", "")


def format_date(value: Column) -> Column:
    """YYMMDD to a date text; years over 40 are 19xx."""
    century = F.when(_sub(value, 0, 2).try_cast("int") > 40, "19").otherwise("20")
    return F.when(
        F.length(value) == 6, F.concat_ws("-", F.concat(century, _sub(value, 0, 2)), _sub(value, 2, 4), _sub(value, 4, 6))
    ).otherwise(value)


def _repaired(number: Column, digit: Column) -> Column:
    """The number, or its first single substitution from left to right that fits the digit and begins with a letter."""
    table = F.create_map(*(F.lit(x) for pair in CONFUSIONS.items() for x in pair))
    tries = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(9)),
            lambda i: F.transform(
                F.filter(F.split(F.coalesce(F.try_element_at(table, F.substr(number, i, F.lit(1))), F.lit("")), ""), lambda c: c != ""),
                lambda c: F.concat(F.substr(number, F.lit(1), i - 1), c, F.substr(number, i + 1)),
            ),
        )
    )
    fits = F.filter(tries, lambda t: (check_digit(t) == digit) & F.regexp_like(t, F.lit("^[A-Z]")))
    return F.when(check_digit(number) == digit, number).otherwise(F.coalesce(F.get(fits, F.lit(0)), number))


def parse_mrz(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: success, reason and the passport fields, null without success.

    Lines of 25 or more zone characters with a filler are candidates, padded or cut to 44. Of adjacent pairs whose
    first line begins with P or names a known country and whose second has the right shape, the first of the best
    score is taken, else the last two candidates. The document number is repaired once; all check digits must fit.
    A Nigerian personal number must be digits. Null texts have no candidates.
    """
    lines = F.transform(
        F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9<]", "")
    )
    candidates = F.transform(
        F.filter(lines, lambda x: (F.length(x) >= 25) & F.contains(x, F.lit("<"))), lambda x: F.rpad(F.substring(x, 1, WIDTH), WIDTH, "<")
    )
    base = docs.select(F.col(id_col).alias("doc_id"), candidates.alias("c")).withColumn("n", F.size("c"))
    pairs = F.transform(
        F.when(F.col("n") >= 2, F.sequence(F.lit(0), F.col("n") - 2)).otherwise(F.expr("cast(array() as array<int>)")),
        lambda i: F.struct(i.alias("i"), _letters(F.get(F.col("c"), i)).alias("a"), F.get(F.col("c"), i + 1).alias("b")),
    )
    likely = F.filter(
        pairs,
        lambda p: (F.startswith(p["a"], F.lit("P")) | mrz_country(_sub(p["a"], 2, 5), _sub(p["b"], 10, 13)).isNotNull())
        & F.regexp_like(p["b"], F.lit(LINE2)),
    )
    ranked = F.array_sort(
        F.transform(likely, lambda p: F.struct((-_line1_score(p["a"], p["b"])).alias("rank"), p["i"].alias("i"), p["a"].alias("a"), p["b"].alias("b")))
    )
    last = F.struct(F.get("c", F.col("n") - 2).alias("a"), F.get("c", F.col("n") - 1).alias("b"))
    chosen = (
        base.withColumn("best", F.get(ranked, F.lit(0)))
        .withColumn("pair", F.when(F.col("best").isNotNull(), F.struct("best.a", "best.b")).when(F.col("n") >= 2, last))
        .select("doc_id", _with_country(F.col("pair.a"), F.col("pair.b")).alias("l1"), F.col("pair.b").alias("l2"))
        .withColumn("shape", F.coalesce(F.regexp_like("l1", F.lit(LINE1)) & F.regexp_like("l2", F.lit(LINE2)), F.lit(False)))
        .withColumn("l2", F.regexp_replace("l2", "^[68]", "B"))
        .withColumn("l2", F.concat(_repaired(_sub(F.col("l2"), 0, 9), _sub(F.col("l2"), 9, 10)), _sub(F.col("l2"), 9, WIDTH)))
    )
    l1, l2 = F.col("l1"), F.col("l2")
    personal = F.translate(_sub(l2, 28, 42), "<", "")
    profile = mrz_country(_sub(l1, 2, 5), _sub(l2, 10, 13))
    digits_ok = F.coalesce(check_digits_valid(l2), F.lit(False))
    nin_ok = ~F.coalesce((profile == "NGA") & ~F.regexp_like(personal, F.lit(r"^\d*$")), F.lit(False))
    judged = chosen.withColumns({"digits": digits_ok, "nin": nin_ok, "profile": profile, "personal": personal})
    ok = F.col("shape") & F.col("digits") & F.col("nin")
    reason = (
        F.when(l1.isNull(), "no machine-readable zone")
        .when(~F.col("shape"), "invalid or incomplete zone")
        .when(~F.col("digits"), "check digits do not fit")
        .when(~F.col("nin"), "invalid personal number")
    )
    kind = F.translate(_sub(l1, 0, 2), "<", "")
    country = F.coalesce("profile", F.translate(_sub(l1, 2, 5), "<", ""))
    surname, given = _name(l1, 0), _name(l1, 1)
    names = F.rtrim(F.concat(_mrz_name(surname), F.lit("<<"), _mrz_name(given)), F.lit("<"))
    rebuilt = F.substring(F.rpad(F.concat(F.rpad(_mrz_name(kind), 2, "<"), F.rpad(country, 3, "<"), names), WIDTH, "<"), 1, WIDTH)
    names_of = F.create_map(*(F.lit(x) for c in COUNTRIES for x in (c.code, c.name)))
    fields = {
        "document_type": kind,
        "issuing_country": country,
        "country_name": F.try_element_at(names_of, F.col("profile")),
        "surname": surname,
        "given_names": given,
        "passport_number": F.translate(_sub(l2, 0, 9), "<", ""),
        "nationality": F.translate(_sub(l2, 10, 13), "<", ""),
        "date_of_birth": format_date(_sub(l2, 13, 19)),
        "gender": F.when(_sub(l2, 20, 21) == "M", "Male").when(_sub(l2, 20, 21) == "F", "Female").otherwise(_sub(l2, 20, 21)),
        "date_of_expiry": format_date(_sub(l2, 21, 27)),
        "personal_number": F.col("personal"),
        "line1": F.when((surname != "") & (given != ""), rebuilt).otherwise(l1),
        "line2": l2,
    }
    return judged.select(
        "doc_id", ok.alias("success"), reason.alias("reason"), *(F.when(ok, v).alias(k) for k, v in fields.items())
    )
