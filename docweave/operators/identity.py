"""Field parsers of licences, voter cards and bank statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.textnorm import collapse, first_match, none_if_empty, normalize_gender

# Labels and shapes of the fields.
_DATE = r"([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})"
_NUMBER = r"\b(?:LICENSE\s*(?:NO|NUMBER)|LICENCE\s*(?:NO|NUMBER))[:\s-]*([A-Z0-9-]{6,30})"
_NIGERIAN_NUMBER = r"\b(?:DLN|LICENSE\s*(?:NO|NUMBER)|LICENCE\s*(?:NO|NUMBER))[:\s-]*([A-Z0-9-]{6,30})"
_NAME = r"\b(?:NAME|FULL\s*NAME|NAMES)[:\s-]*([A-Z][A-Z ,'-]{3,80})"
_BIRTH = r"\b(?:DOB|DATE\s*OF\s*BIRTH)[:\s-]*" + _DATE
_ISSUED = r"\b(?:ISSUE\s*DATE|DATE\s*ISSUED)[:\s-]*" + _DATE
_EXPIRES = r"\b(?:EXPIRY\s*DATE|EXPIRES|EXP)[:\s-]*" + _DATE
_CLASS = r"\b(?:CLASS|CATEGORY)[:\s-]*([A-Z0-9]{1,4})\b"
_SEX = r"\b(?:SEX|GENDER)[:\s-]*(MALE|FEMALE|M|F)\b"
_ADDRESS = r"\bADDRESS[:\s-]*([A-Z0-9 ,'#./-]{5,120})"
_VOTER = r"\b(?:VOTER\s*ID|ID\s*NO|CARD\s*NO)[:\s-]*([A-Z0-9-]{6,30})"
_STATION = r"\bPOLLING\s*STATION[:\s-]*([A-Z0-9 ,'-]{3,80})"
_PERIOD_DATE = r"\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}"
_ANY_DATE = rf"({_PERIOD_DATE}|\d{{1,2}}-[A-Za-z]{{3,9}}-\d{{4}})"
_GREY = rf"TIME\s+PERIOD:?\s+ACCOUNT\s+NUMBER\s+BANK\s+NAME\s+{_PERIOD_DATE}\s*(?:to|→)\s*{_PERIOD_DATE}\s+"
_ACCOUNT = r"(?:Account\s*(?:No|Number))\s*[:\-]?\s*([0-9xX*]{10,})"
_ACCOUNT_NAME = r"(?:Account\s*Name)\s*[:\-]?\s*([A-Z][A-Z .'\-]{3,90})"
_AMOUNT = r"\s*[:\-]?\s*(?:NGN|₦)?\s*(-?[\d,]+\.\d{2})"
_OPENING = r"(?:Opening\s*Balance)" + _AMOUNT
_CLOSING = r"(?:Closing\s*Balance|Balance\s+as\s+at\s+[A-Za-z]+\s+\d{1,2},\s*\d{4})" + _AMOUNT
_HELLO = r"\bHello\s+([A-Z][A-Z\s.'\-]{3,90}),"
_JOINED_NAMES = ("SAMPLE", "CUSTOMER", "HOLDER", "PERSON", "TEST")
_JOINED_STREETS = ("SAMPLE", "CUSTOMER", "ROAD", "STREET", "MAINLAND", "LAGOS", "WORLD", "BANK")


def parse_drivers_license(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", country_col: str = "country"
) -> DataFrame:
    """One row per licence: fields, success, message. Other countries than Nigeria and Ghana have no parser.

    A null or empty country counts as NGA. Each field is the first match of its label, null without one, and all are
    null where there is no parser: then success is false and message says so. success: a number or a name was found.
    """
    country = F.upper(F.coalesce(none_if_empty(F.trim(F.col(country_col))), F.lit("NGA")))
    text = F.when(country.isin("NGA", "GHA"), F.coalesce(F.col(text_col), F.lit("")))
    nigerian = country == "NGA"
    fields = docs.select(
        F.col(id_col).alias("doc_id"),
        country.alias("country"),
        F.when(nigerian, first_match(text, _NIGERIAN_NUMBER)).otherwise(first_match(text, _NUMBER)).alias("license_number"),
        first_match(text, _NAME).alias("full_name"),
        first_match(text, _BIRTH).alias("date_of_birth"),
        first_match(text, _ISSUED).alias("issue_date"),
        first_match(text, _EXPIRES).alias("expiry_date"),
        first_match(text, _CLASS).alias("license_class"),
        normalize_gender(first_match(text, _SEX)).alias("gender"),
        F.when(nigerian, first_match(text, _ADDRESS)).alias("address"),
    )
    missing = F.concat(F.lit("Driver's license OCR is not implemented for "), F.col("country"))
    return fields.withColumns(
        {
            "success": F.col("license_number").isNotNull() | F.col("full_name").isNotNull(),
            "message": F.when(~F.col("country").isin("NGA", "GHA"), missing),
        }
    )


def parse_ghana_voter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fields of Ghanaian voter cards. success: a number or a name was found."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        first_match(text, _VOTER).alias("voter_id"),
        first_match(text, r"\b(?:NAME|FULL\s*NAME)[:\s-]*([A-Z][A-Z ,'-]{3,80})").alias("full_name"),
        first_match(text, _BIRTH).alias("date_of_birth"),
        normalize_gender(first_match(text, _SEX)).alias("gender"),
        first_match(text, _STATION).alias("polling_station"),
    ).withColumn("success", F.col("voter_id").isNotNull() | F.col("full_name").isNotNull())


def clean_text(value: Column) -> Column:
    """Runs of blanks other than line feeds to one space, ends trimmed."""
    return F.trim(F.regexp_replace(value, r"[ \t\r\f\x0B]+", " "))


def clean_lines(text: Column, keep_empty: bool = False) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n?|\n"), collapse)
    return lines if keep_empty else F.filter(lines, lambda x: x != "")


def split_joined_name(value: Column) -> Column:
    return clean_text(reduce(lambda v, part: F.replace(v, F.lit(part), F.lit(f" {part} ")), _JOINED_NAMES, F.upper(clean_text(value))))


def split_joined_address(value: Column) -> Column:
    """Spaces where a compact address loses them: after its number and around known words."""
    out = F.upper(clean_text(value))
    out = F.regexp_replace(out, r"^(\d+)([A-Z])", "$1 $2")
    out = F.regexp_replace(out, r"([A-Z]{3,})(STR)(?=\b|[A-Z])", "$1 $2")
    for token in _JOINED_STREETS:
        out = F.regexp_replace(out, rf"(?<!^)(?<!\s)({token})", " $1")
        out = F.regexp_replace(out, rf"({token})(?!$)(?!\s)", "$1 ")
    out = F.regexp_replace(out, r"(?<!^)(?<!\s)(STR)(?=WORLD|BANK|MAINLAND|LAGOS|$)", " $1")
    return clean_text(F.regexp_replace(out, r"(STR)(?=WORLD|BANK|MAINLAND|LAGOS)", "$1 "))


def _address(value: Column) -> Column:
    out = F.regexp_replace(clean_text(value), r"\s*,\s*", ", ")
    return none_if_empty(F.btrim(collapse(out), F.lit(" ,")))


def parse_bank_statement(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Account, holder, balances, period, bank and address of statements in two known layouts.

    A labelled account name yields to one from a greeting or from the line after the heading if that one is spaced
    and the other is not, or if it has more words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    flat = F.regexp_replace(text, r"\s+", " ")
    find = lambda value, pattern, group=1: none_if_empty(clean_text(F.regexp_extract(value, "(?i)" + pattern, group)))
    base = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("_text"), flat.alias("_flat"), clean_lines(text).alias("_lines"),
        clean_lines(text, keep_empty=True).alias("_all"),
    ).withColumn(
        "_head", F.array_position(F.transform("_lines", lambda x: F.replace(F.upper(x), F.lit(" "), F.lit(""))), "BANKSTATEMENT")
    )
    text, flat, head = F.col("_text"), F.col("_flat"), F.col("_head")
    after = lambda n: F.when(head > 0, F.get("_lines", (head + n - 1).cast("int")))
    uba_address = F.when(
        F.regexp_like(after(2), F.lit(r"\d")) & ~F.regexp_like(after(2), F.lit(r"\d{1,2}-[A-Za-z]{3,9}-\d{4}")),
        _address(split_joined_address(after(2))),
    )
    suite = F.array_position(F.transform("_all", lambda x: F.contains(F.lower(x), F.lit("suite"))), True).cast("int")
    line = lambda n: F.when(suite > 0, F.get("_all", suite - 1 + n))

    def cut(value: Column, pattern: str) -> Column:
        rest = F.regexp_replace(value, pattern, "")
        return F.when((rest != value) & (rest != ""), rest)

    grey_address = _address(
        F.concat_ws(
            " ",
            cut(line(0), r"(?i)^.*?\bSuite\s+\d+\s*"),
            cut(line(1), r"(?i)^Middletown,\s*DE\s*\d+\s*USA\.?\s*"),
            F.when(F.regexp_like(line(2), F.lit(r"(?i)^[A-Z ]{2,20}$")), line(2)),
        )
    )
    labelled = find(text, _ACCOUNT_NAME)
    greeted = F.coalesce(F.upper(find(text, _HELLO)), split_joined_name(after(1)))
    words = lambda v: F.size(F.split(v, " "))
    better = (F.contains(greeted, F.lit(" ")) & ~F.contains(labelled, F.lit(" "))) | (words(greeted) > words(labelled))
    uba = F.contains(F.upper(flat), F.lit("UNITED BANK FOR AFRICA")) | F.regexp_like(flat, F.lit(r"(?i)\bUBA\b"))
    period = rf"{_ANY_DATE}\s*(?:to|→)\s*{_ANY_DATE}"
    return base.select(
        "doc_id",
        F.coalesce(find(text, _ACCOUNT), find(flat, _GREY + r"([0-9xX*]{5,20})\s+")).alias("account_number"),
        F.when(labelled.isNull() | F.coalesce(better, F.lit(False)), greeted).otherwise(labelled).alias("account_name"),
        find(text, _OPENING).alias("opening_balance"),
        find(text, _CLOSING).alias("closing_balance"),
        find(text, period, 1).alias("start_date"),
        find(text, period, 2).alias("end_date"),
        F.coalesce(
            find(flat, _GREY + r"[0-9xX*]{5,20}\s+([A-Za-z][A-Za-z\s&.\-]+?)\s+CURRENCY"), F.when(uba, "United Bank for Africa")
        ).alias("bank_name"),
        F.coalesce(grey_address, uba_address).alias("address"),
    )


# Fixed values of Nigerian voter cards: states in order, words of a name, words that no name line has.
STATES = (
    "ABIA", "ADAMAWA", "AKWA IBOM", "ANAMBRA", "BAUCHI", "BAYELSA", "BENUE", "BORNO", "CROSS RIVER", "DELTA", "EBONYI", "EDO",
    "EKITI", "ENUGU", "GOMBE", "IMO", "JIGAWA", "KADUNA", "KANO", "KATSINA", "KEBBI", "KOGI", "KWARA", "LAGOS", "NASARAWA",
    "NIGER", "OGUN", "ONDO", "OSUN", "OYO", "PLATEAU", "RIVERS", "SOKOTO", "TARABA", "YOBE", "ZAMFARA", "FCT",
)
NAME_TOKENS = "CARD|HOLDER|NAME|PERSON|SAMPLE|TEST"
NO_NAME_WORDS = (
    r"\b(?:FEDERAL|REPUBLIC|NIGERIA|INDEPENDENT|NATIONAL|ELECTORAL|COMMISSION|VOTER|CARD|CODE|VIN|DELIM|DATE|BIRTH|GENDER"
    r"|OCCUPATION|ADDRESS)\b"
)
JOINED_WORDS = ("SAMPLE", "STREET", "LAGOS", "MAINLAND", "SOUTH")
_VOTER_STOP = r"(?i),|^[A-Z]{2,}\.[A-Z]{2,}$|\b(DATE OF BIRTH|GENDER|OCCUPATION|ADDRESS)\b"
_MARKS = " :;,.|-"


def _voter_clean(value: Column) -> Column:
    return F.btrim(collapse(value), F.lit(_MARKS))


def _joined_words(value: Column) -> Column:
    out = _voter_clean(value)
    for token in JOINED_WORDS:
        out = F.regexp_replace(out, rf"(?i)(?<!^)(?<!\s)({token})\b", " $1")
        out = F.regexp_replace(out, rf"(?i)\b({token})(?!$)(?!\s|,)", "$1 ")
    out = F.regexp_replace(F.regexp_replace(collapse(out), r"\s+,", ","), r",\s*", ", ")
    return none_if_empty(F.trim(out))


def _name_tokens(value: Column) -> Column:
    """Known tokens at the begin of a joined name, parted; what follows the first unknown one stays as it is."""
    text = F.upper(_voter_clean(value))
    head = F.regexp_extract(text, f"^((?:{NAME_TOKENS})*)", 1)
    parted = F.concat(F.regexp_replace(head, f"({NAME_TOKENS})", "$1 "), F.substr(text, F.length(head) + 1))
    return F.when(F.contains(text, F.lit(" ")), text).otherwise(F.trim(parted))


def parse_nigeria_voter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fields of Nigerian voter cards, with joined words parted. success: a number or a name was found."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    for pattern, by in ((r"(?i)DATE ?OF ?BIRTH", "DATE OF BIRTH"), (r"(?i)VOTER'?SCARD", "VOTER'S CARD")):
        text = F.regexp_replace(text, pattern, by)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).withColumn(
        "_lines", F.filter(F.transform(F.split("_text", r"\r\n?|\n"), _voter_clean), lambda x: x != "")
    )
    text, flat = F.col("_text"), F.regexp_replace("_text", r"\s+", " ")
    find = lambda value, pattern: none_if_empty(_voter_clean(F.regexp_extract(value, "(?i)" + pattern, 1)))
    commas = F.transform("_lines", lambda x: F.regexp_replace(F.upper(x), r"^([A-Z]{2,})\.([A-Z]{2,})$", "$1,$2"))
    name_line = F.get(
        F.filter(commas, lambda x: F.contains(x, F.lit(",")) & (F.regexp_count(x, F.lit("[A-Z]{2,}")) >= 2) & ~F.regexp_like(x, F.lit(NO_NAME_WORDS))),
        F.lit(0),
    )
    name = F.concat(F.trim(F.substring_index(name_line, ",", 1)), F.lit(", "), _name_tokens(F.regexp_replace(name_line, "^[^,]*,", "")))
    at = F.array_position(F.transform("_lines", lambda x: F.contains(F.upper(x), F.lit("DELIM"))), True).cast("int")
    rest = F.slice("_lines", at + 1, F.size("_lines"))
    stop = F.array_position(F.transform(rest, lambda x: F.regexp_like(F.upper(x), F.lit(_VOTER_STOP))), True).cast("int")
    own = F.regexp_replace(F.get("_lines", at - 1), r"(?i)^.*?\bDELIM\b[:\s]*", "")
    taken = F.concat(F.array(own), F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest))
    place = _voter_clean(F.translate(F.array_join(F.when(at > 0, taken), " "), "|", " "))
    parted = F.coalesce(
        *(
            F.when(
                F.startswith(F.upper(place), F.lit(s.replace(" ", ""))) & ~F.startswith(F.upper(place), F.lit(s + " ")),
                F.concat(F.lit(s + " "), F.ltrim(F.regexp_replace(F.ltrim(F.substr(place, F.lit(len(s.replace(" ", "")) + 1))), "^[iI]", ""))),
            )
            for s in STATES
        ),
        place,
    )
    compact = find(text, r"DATE\s*OF\s*BIRTH(?:\s+GENDER)?\s*([0-9]{8})")
    birth = F.coalesce(
        find(text, r"DATE\s*OF\s*BIRTH(?:\s+GENDER)?\s*([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})"),
        F.concat_ws("-", F.substring(compact, 1, 2), F.substring(compact, 3, 2), F.when(compact.isNotNull(), F.substring(compact, 5, 4))),
    )
    address = F.regexp_replace(_voter_clean(F.replace(F.regexp_extract(flat, r"(?i)ADDRESS[:\s]*(.+)", 1), F.lit("."), F.lit(", "))), r"(?i)^(\d+)([A-Z])", "$1 $2")
    address = F.regexp_replace(F.regexp_replace(address, r"(?i)([A-Z])(?=STREET\b)", "$1 "), r"(?i)\bSTREET([A-Z])", "STREET $1")
    return base.select(
        "doc_id",
        find(text, r"\bCODE[:\s-]*([0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{3})").alias("code"),
        none_if_empty(F.regexp_replace(F.upper(find(text, r"\bVIN[:\s-]*([A-Z0-9 ]{10,30})")), "[^A-Z0-9]", "")).alias("vin"),
        _joined_words(parted).alias("delimitation"),
        name.alias("full_name"),
        none_if_empty(birth).alias("date_of_birth"),
        normalize_gender(find(text, r"\bGENDER\s*(?:[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}\s*)?(MALE|FEMALE|M|F)\b")).alias("gender"),
        _joined_words(F.regexp_replace(F.regexp_extract(flat, r"(?i)OCCUPATION[:\s]*(.+)", 1), r"(?i)\bADDRESS\b.*$", "")).alias("occupation"),
        _joined_words(F.regexp_replace(address, r"\s*,\s*", ", ")).alias("address"),
    ).withColumn("success", F.col("vin").isNotNull() | F.col("full_name").isNotNull())
