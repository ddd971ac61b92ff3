"""Nigerian identity cards and slips: labelled values to either side of a label, the card's layout, the better rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.textnorm import collapse, none_if_empty

# Printed labels by field, wording that is no name, address words, date shapes, weights.
LABELS = {
    "tracking id": "tracking_id", "nin": "nin", "national identification number": "nin", "surname": "surname", "last name": "surname",
    "first name": "first_name", "given name": "first_name", "given names": "first_name", "middle name": "middle_name",
    "other name": "other_names", "other names": "other_names", "gender": "gender", "sex": "gender", "date of birth": "date_of_birth",
    "dob": "date_of_birth", "date issued": "date_issued", "date of issued": "date_issued", "date of issue": "date_issued",
    "issue date": "date_issued", "issued": "date_issued", "address": "address",
}
LABEL = (
    r"(?i)\b(Tracking\s*ID|National\s+Identification\s+Number(?!\s+Slip)|NIN|Surname|Last\s*Name|Given\s*Name(?:s)?|First\s*Name"
    r"|Middle\s*Name|Other\s*Name(?:s)?|Gender|Sex|Date\s*of\s*Birth|DOB|Date\s*(?:of\s+)?Issued?|Issue\s*Date|Address|Note)\s*[:\-]"
)
NO_NAMES = tuple(
    """FEDERAL REPUBLIC NIGERIA NATIONAL IDENTITY IDENTIFICATION MANAGEMENT MANAGEIMENT SYSTEM COMMISSION SLIP SLIPS NIMC NIMNC NINC
    NIN NINS TRACKING ID SURNAME GIVEN MIDDLE FIRST LAST OTHER NAME NAMES GENDER SEX ADDRESS DATE BIRTH ISSUED ISSUE DOB NOTE STREET
    ROAD AVENUE WAY EXPRESS BUS STOP AREA NO ROUNDABOUT BLOCK FLAT APARTMENT ESTATE COURT DRIVE LANE BOULEVARD TERRACE RD ST AVE BLV
    BLVD PLAZA JUNCTION CRESCENT ZONE WUSE ABUJA OFF NORTH SOUTH EAST WEST YOU WILL BE NOTIFIED CARD READY CONTACT PLEASE FOR ANY AND
    THE WHEN YOUR IS AT OR OF CALL GOV NG COM WWW HELPDESK SOKODE DALABA""".split()
)
ADDRESS_MARKS = (
    "STREET", "ROAD", "AVENUE", " WAY", "EXPRESS", "BUS STOP", "AREA", "NO ", "NO.", "BLOCK ", "FLAT ", "ESTATE", "COURT", "DRIVE",
    "LANE", "BOULEVARD", "TERRACE", "PLAZA", "JUNCTION",
)
ADDRESS_WORDS = (
    "STREET", "ROAD", "AVENUE", "WAY", "EXPRESS", "BUS", "STOP", "AREA", "JUNCTION", "ESTATE", "COURT", "DRIVE", "LANE", "PLAZA",
)
DATES = (
    r"\b(\d{1,2}[\-/\.]\d{1,2}[\-/\.]\d{2,4})\b", r"\b(\d{4}[\-/\.]\d{1,2}[\-/\.]\d{1,2})\b", r"\b(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4})\b",
    r"\b([A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4})\b",
)
CARD_DATE = r"(?i)(\d{1,2}\s*[A-Za-z]{3,9}\s*\d{2,4}|\d{1,2}[\-/\.]\d{1,2}[\-/\.]\d{2,4}|\d{4}[\-/\.]\d{1,2}[\-/\.]\d{1,2})"
CARD_LABELS = {
    "surname": r"(?i)^\s*SURNAME(?:\s*/\s*NOM)?\s*:?\s*$",
    "first_name": r"(?i)^\s*(?:GIVEN\s+NAMES?(?:\s*/\s*PR[EÉ]?NOMS?)?|FIRST\s+NAME(?:S)?)\s*:?\s*$",
    "middle_name": r"(?i)^\s*MIDDLE\s+NAME(?:\s*/.*)?\s*:?\s*$",
}
CARD_SEX = r"(?i)SEX(?:\s*/\s*SEXE)?\s*[:\-]?\s*(?:\n|\s)\s*([MF])(?![A-Za-z])"
CARD_NUMBER = r"(?i)NATIONAL\s+IDENTIFICATION\s+NUMBER(?:\s*\(NIN\))?\s*[:\-]?\s*\n?\s*(\d[\d\s\.]{9,20}\d)"
CARD_WORDING = ("SURNAME/NOM", "GIVEN NAMES/PRENOMS", "GIVEN NAMES /PRENOMS", "SEX/SEXE", "DIGITAL NIN")
SLIP_WORDING = (
    "TRACKING ID", "NATIONAL IDENTIFICATION NUMBER SLIP", "NIN SLIP", "NIMC", "NIMNC", "NINC", "NATIONAL IDENTITY MANAGEMENT",
    "IDENTITY MANAGEIMENT", "NATIONAL IDENTIFICATION NUMBER", "NATIONAL IDENTITY",
)
WEIGHTS = {
    "nin": 5, "tracking_id": 3, "surname": 3, "first_name": 3, "middle_name": 2, "gender": 2, "address": 2, "date_of_birth": 1,
    "date_issued": 1,
}
FIELDS = (
    "nin", "tracking_id", "surname", "first_name", "middle_name", "other_names", "gender", "date_of_birth", "date_issued", "address",
)
#: Characters and words of a chunk that may hold a name, and of an address.
NAME_CHARS, NAME_WORDS, LONG_ADDRESS, SHORT_ADDRESS = 80, 6, 25, 15
_NUMBER = r"\b(\d{11})\b"
_NAME = r"\b([A-Za-z][A-Za-z'\-]{2,29})\b"


def validate_nin(value: Column) -> Column:
    """Whether a text is eleven digits; false for null."""
    return F.coalesce(F.regexp_like(value, F.lit(r"^[0-9]{11}$")), F.lit(False))


def _clean(chunk: Column) -> Column:
    return F.btrim(collapse(chunk), F.lit(" :;-,.|"))


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    upper = F.upper(text)
    found = F.lit(False)
    for w in words:
        found = found | F.contains(upper, F.lit(w))
    return found


def _pick(found: Column, last: bool) -> Column:
    return F.try_element_at(found, F.lit(-1 if last else 1))


def _name(chunk: Column, last: bool = False) -> Column:
    """The first or last word of a short chunk that can be a name, in capitals."""
    clean = _clean(chunk)
    words = F.filter(F.regexp_extract_all(clean, F.lit(_NAME), F.lit(1)), lambda w: ~F.upper(w).isin(*NO_NAMES))
    short = (F.length(chunk) <= NAME_CHARS) & (F.size(F.split(clean, " ")) <= NAME_WORDS) & ~_has_any(clean, ADDRESS_MARKS)
    return F.when(short, F.upper(_pick(words, last)))


def _number(chunk: Column, last: bool) -> Column:
    digits = F.regexp_replace(chunk, r"\D", "")
    return F.coalesce(_pick(F.regexp_extract_all(chunk, F.lit(_NUMBER), F.lit(1)), last), F.when(F.length(digits) >= 11, F.substring(digits, 1, 11)))


def _tracking(chunk: Column, last: bool) -> Column:
    codes = F.regexp_extract_all(chunk, F.lit(r"\b([A-Za-z0-9]{8,30})\b"), F.lit(1))
    mixed = F.filter(codes, lambda c: F.regexp_like(c, F.lit("[A-Za-z]")) & F.regexp_like(c, F.lit("[0-9]")))
    return F.upper(_pick(mixed, last))


def _gender(chunk: Column, last: bool) -> Column:
    found = F.regexp_extract_all(chunk, F.lit(r"(?i)(?<![A-Za-z])(MALE|FEMALE|M|F)(?![A-Za-z])"), F.lit(1))
    return F.substring(F.upper(_pick(found, last)), 1, 1)


def _value(field: str, chunk: Column, last: bool) -> Column:
    """What a chunk of text beside a label holds for a field."""
    clean = none_if_empty(_clean(chunk))
    if field == "nin":
        return _number(chunk, last)
    if field == "tracking_id":
        return _tracking(chunk, last)
    if field == "gender":
        return _gender(chunk, last)
    if field in ("date_of_birth", "date_issued"):
        return F.coalesce(*(none_if_empty(F.regexp_extract(chunk, p, 1)) for p in DATES))
    if field == "address":
        return F.when(_has_any(clean, ADDRESS_MARKS) | (F.length(clean) > LONG_ADDRESS), clean)
    return F.upper(clean) if field == "other_names" else _name(chunk, last)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _card(field: str, text: Column, lines: Column) -> Column:
    """A field from the card's layout: names stand under their label lines; dates run from birth to issue."""
    if field in CARD_LABELS:
        below = lambda i, k: none_if_empty(F.trim(F.get(lines, i + k)))
        named = lambda x, i: F.when(F.regexp_like(x, F.lit(CARD_LABELS[field])), _name(F.coalesce(below(i, 1), below(i, 2))))
        return _first(F.transform(lines, named))
    dates = F.regexp_extract_all(text, F.lit(CARD_DATE), F.lit(1))
    spaced = lambda d: collapse(F.regexp_replace(F.regexp_replace(d, r"(\d)([A-Za-z])", "$1 $2"), r"([A-Za-z])(\d)", "$1 $2"))
    if field == "date_of_birth":
        return spaced(F.get(dates, F.lit(0)))
    if field == "date_issued":
        return F.when(F.size(dates) >= 2, spaced(F.try_element_at(dates, F.lit(-1))))
    if field == "gender":
        alone = F.get(F.filter(F.transform(lines, F.trim), lambda x: F.regexp_like(x, F.lit("(?i)^[MF]$"))), F.lit(0))
        return F.upper(F.coalesce(none_if_empty(F.regexp_extract(text, CARD_SEX, 1)), alone))
    if field == "nin":
        labelled = F.regexp_replace(F.regexp_extract(text, CARD_NUMBER, 1), r"\D", "")
        digits = F.regexp_replace(text, r"\D", "")
        return F.coalesce(
            F.when(F.length(labelled) >= 11, F.substring(labelled, 1, 11)),
            none_if_empty(F.regexp_extract(text, _NUMBER, 1)),
            none_if_empty(F.regexp_extract(digits, r"^0*([1-9]\d{10})", 1)),
        )
    return F.lit(None).cast("string")


def _scanned_address(chunks: Column) -> Column:
    """The chunk with the most address words, of equals the longest, then the first."""
    clean = F.transform(chunks, _clean)
    points = lambda c: sum((F.contains(F.upper(c), F.lit(w)).cast("int") for w in ADDRESS_WORDS), F.lit(0))
    rated = F.transform(clean, lambda c, i: F.struct((-points(c)).alias("rank"), (-F.length(c)).alias("size"), i.alias("i"), c.alias("text")))
    fit = F.filter(rated, lambda r: (r["rank"] < 0) & (r["size"] <= -SHORT_ADDRESS))
    return F.get(F.array_sort(fit), F.lit(0))["text"]


def parse_nin(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: document_type, the fields, full_name, score, good_enough, success, nin_format_valid.

    A labelled value stands after its label, else before it; the first label of a field with a value counts, and what
    no label gives is taken from the card's layout. The address is the chunk between labels that looks most like one.
    success: a number was found. document_type is NIN_CARD or NIN_SLIP by its wording, else UNKNOWN, which the country
    does not support. Null texts have nothing. keep names further columns to pass on.
    """
    text, lines, chunks = F.col("_text"), F.split("_text", "\n"), F.col("_chunks")
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumns(
        {"_labels": F.regexp_extract_all("_text", F.lit(LABEL), F.lit(1)), "_chunks": F.split("_text", LABEL, -1)}
    )
    known = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    keys = F.transform("_labels", lambda x: F.try_element_at(known, F.lower(collapse(x))))

    def labelled(field: str) -> Column:
        at = lambda key, i: F.when(key == field, F.coalesce(_value(field, F.get(chunks, i + 1), False), _value(field, F.get(chunks, i), True)))
        return _first(F.transform(F.col("_keys"), at))

    found = base.withColumn("_keys", keys).withColumns({f: F.coalesce(none_if_empty(labelled(f)), _card(f, text, lines)) for f in FIELDS})
    whole = F.when(_has_any(text, ADDRESS_MARKS), none_if_empty(_clean(text)))
    found = found.withColumn("address", F.coalesce(F.when(F.size("_labels") > 0, _scanned_address(chunks)).otherwise(whole), "address"))
    # The address scan comes after a rotation is chosen, so the score counts a labelled address only.
    labelled_address = none_if_empty(labelled("address")).isNotNull()
    score = sum(((labelled_address if f == "address" else F.col(f).isNotNull()).cast("int") * w for f, w in WEIGHTS.items()), F.lit(0))
    named = F.col("surname").isNotNull() | F.col("first_name").isNotNull()
    good = (F.col("score") >= 18) | (F.col("nin").isNotNull() & ((F.col("score") >= 14) | ((F.col("score") >= 10) & named)))
    kind = F.when(_has_any(text, CARD_WORDING), "NIN_CARD").when(_has_any(text, SLIP_WORDING), "NIN_SLIP").otherwise("UNKNOWN")
    return (
        found.withColumn("score", score)
        .withColumns({"document_type": kind, "good_enough": good, "success": F.col("nin").isNotNull(), "nin_format_valid": validate_nin(F.col("nin"))})
        .withColumn("full_name", none_if_empty(F.concat_ws(" ", "first_name", "middle_name", "other_names", "surname")))
        .select("doc_id", *keep, "document_type", *FIELDS, "full_name", "score", "good_enough", "success", "nin_format_valid")
    )


def parse_nin_rotations(readings: DataFrame, id_col: str = "doc_id", order_col: str = "rotation", text_col: str = "text") -> DataFrame:
    """parse_nin() of the best reading of each document, with its rotation.

    Readings are tried in order until one is good enough; the best score of those tried wins, the first of equals.
    Empty readings are passed over; a document without any other has no row.
    """
    parsed = parse_nin(readings.where(F.coalesce(F.col(text_col), F.lit("")) != ""), id_col, text_col, (order_col,))
    own = Window.partitionBy("doc_id")
    tried = parsed.withColumn("_stop", F.min(F.when(F.col("good_enough"), F.col(order_col))).over(own))
    tried = tried.where(F.col("_stop").isNull() | (F.col(order_col) <= F.col("_stop")))
    best = F.row_number().over(own.orderBy(F.desc("score"), order_col))
    return tried.withColumn("_n", best).where("_n = 1").drop("_n", "_stop")
