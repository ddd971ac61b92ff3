"""Sections of company documents: objects clauses and share capital."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.literals import may_match
from docweave.functions.textnorm import collapse, none_if_empty, normalize_business_text, normalize_decimal, resolve_currency, unique_clean
from docweave.operators.labels import lines_of

# Headings, ends and amount patterns.
OBJECTS_HEADING = (
    r"(?i)^(?:\(?(?:\d+|[IVX]+)[.)]\s*)?(?:(?:THE\s+)?OBJECTS?\s+(?:FOR\s+WHICH\s+THE\s+COMPANY\s+IS\s+ESTABLISHED|OF\s+THE\s+COMPANY)"
    r"\s*(?:ARE|IS)?\s*[:.-]?\s*(.*)|(?:THE\s+)?OBJECTS?\s+(?:ARE|IS)\s*[:.-]?\s*(.*)|(?:THE\s+)?OBJECTS?\s*[:.-]\s*(.*)|(?:THE\s+)?OBJECTS?\s*)$"
)
OBJECTS_END = (
    r"(?i)^(?:(?:\d+|[IVX]+)[.)]\s*)?(?:LIABILITY\s+OF|THE\s+LIABILITY|LIABILITY\b|(?:THE\s+)?(?:NOMINAL\s+)?SHARE\s+CAPITAL|CAPITAL\s+OF"
    r"|ARTICLES\s+OF|SUBSCRIBERS?|WE\s+THE\s+SEVERAL|REGISTERED\s+OFFICE|DIRECTORS?|SHAREHOLDERS?|CERTIFICATION|DECLARATION|SIGNATURES?"
    r"|IN\s+WITNESS)"
)
NUMBERING = r"(?i)^\s*(?:\(?\d+[.)]|\(?[A-Z][.)]|\(?[IVX]+[.)])\s*"
BLOCK_LINES, CLAUSE_CHARS, MOST_OBJECTS = 79, 1200, 30
_CURRENCY = r"(NGN|NAIRA|N(?=\s?\d)|₦|GHS|GH₵|KES|KSH|USD|US\$|CAD|CA?\$|AUD|AU?\$|\$|GBP|£|EUR|€|ZAR)?"
_AMOUNT = r"(\d+(?:[ ,]\d{3})*(?:\.\d{1,4})?)(?![\d,])"
_OF = r"(?:\s+OF\s+THE\s+COMPANY)?\s*(?:IS|OF|:|-)?\s*"
_ALONE = r"(?<!ISSUED\s)(?<!AUTHORIZED\s)(?<!AUTHORISED\s)(?<!NOMINAL\s)(?<!PAID-UP\s)(?<!PAID UP\s)"
CAPITAL = (
    ("issued_amount", rf"(?i)\bISSUED\s+(?:SHARE\s+)?CAPITAL{_OF}{_CURRENCY}\s*{_AMOUNT}"),
    ("authorized_amount", rf"(?i)\b(?:AUTHORIZED|AUTHORISED|NOMINAL)\s+(?:SHARE\s+)?CAPITAL{_OF}{_CURRENCY}\s*{_AMOUNT}"),
    ("paid_up_amount", rf"(?i)\bPAID[- ]UP\s+(?:SHARE\s+)?CAPITAL\s*(?:IS|OF|:|-)?\s*{_CURRENCY}\s*{_AMOUNT}"),
    ("stated_amount", rf"(?i){_ALONE}\bSHARE\s+CAPITAL{_OF}{_CURRENCY}\s*{_AMOUNT}"),
    ("stated_amount", rf"(?i)(?<!SHARE\s){_ALONE}\bCAPITAL\s*(?:IS|OF|:|-)?\s*{_CURRENCY}\s*{_AMOUNT}\s+DIVIDED\s+INTO\b"),
)

_PRINTED = r"NGN|NAIRA|N(?=\s?\d)|₦|GHS|GH₵|KES|KSH|USD|US\$|CAD|CA?\$|AUD|AU?\$|\$|GBP|£|EUR|€|ZAR"
SHARE_CLASS = (
    r"(?i)(\d+(?:[ ,]\d{3})*)(?![\d,])\s+(?:([A-Z][A-Z &/-]{0,40}?)\s+)?SHARES?\b"
    rf"(?:\s+OF\s+({_PRINTED})?\s*(\d+(?:\.\d{{1,4}})?)\s+EACH)?"
)
NO_CLASSES = ("OF", "THE", "ISSUED", "AND")
DIVIDED = r"(?i)\bDIVIDED\s+INTO\b"
CAPITAL_LABEL = r"(?i)\b(ISSUED|AUTHORIZED|AUTHORISED|NOMINAL|PAID[- ]UP)?\s*(?:SHARE\s+)?CAPITAL\b"
DEFAULT_CURRENCIES = {
    "AUS": "AUD", "CAN": "CAD", "GHA": "GHS", "GBR": "GBP", "KEN": "KES", "NGA": "NGN", "USA": "USD", "ZAF": "ZAR",
}
#: Characters looked at behind the last amount, behind "divided into" and before it; classes of a document.
NEARBY, CLAUSE, BEFORE, MOST_CLASSES = 800, 700, 180, 20


def objects_clauses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, objects), and the columns to keep: the clauses under the first objects heading, numbered lines beginning new ones.

    A block has at most 79 lines and ends at another section. A clause is at most 1200 characters with 8 letters, 30
    clauses a document. Without a heading, or for null texts, the array is empty.
    """
    lines = lines_of(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, lines.alias("_lines")).withColumn(
        "_at", F.array_position(F.transform("_lines", lambda x: F.regexp_like(x, F.lit(OBJECTS_HEADING))), True).cast("int")
    )
    heading = F.get("_lines", F.col("_at") - 1)
    inline = F.concat(*(F.regexp_extract(heading, OBJECTS_HEADING, g) for g in (1, 2, 3)))
    block = F.slice("_lines", F.col("_at") + 1, F.lit(BLOCK_LINES))
    end = F.array_position(F.transform(block, lambda x: F.regexp_like(x, F.lit(OBJECTS_END))), True).cast("int")
    body = F.when(end > 0, F.slice(block, F.lit(1), end - 1)).otherwise(block)
    body = F.filter(F.concat(F.array(F.trim(inline)), body), lambda x: x != "")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        clean = F.trim(F.regexp_replace(line, NUMBERING, ""))
        new = (clean != F.trim(line)) & (acc["open"] != "")
        text = F.when(new, clean).otherwise(F.trim(F.concat_ws(" ", acc["open"], clean)))
        done = F.when(new, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        full = F.length(text) >= CLAUSE_CHARS
        return F.struct(
            F.when(full, F.concat(done, F.array(F.rtrim(F.substring(text, 1, CLAUSE_CHARS))))).otherwise(done).alias("done"),
            F.when(full, "").otherwise(text).alias("open"),
        )

    folded = F.aggregate(body, start, step, lambda a: F.filter(F.concat(a["done"], F.array(a["open"])), lambda x: x != ""))
    clauses = base.select("doc_id", *keep, F.when(F.col("_at") > 0, folded).otherwise(F.expr("cast(array() as array<string>)")).alias("c"))
    only = F.get("c", F.lit(0))
    parted = F.when((F.size("c") == 1) & (F.length(only) > 500), F.split(only, r"(?i);\s+(?=(?:TO|THE\s+COMPANY)\b)")).otherwise(F.col("c"))
    wordy = F.filter(parted, lambda x: F.length(F.regexp_replace(F.upper(x), "[^A-Z]", "")) >= 8)
    return clauses.select("doc_id", *keep, unique_clean(wordy, MOST_OBJECTS).alias("objects"))


def share_classes(nearby: Column, country: Column) -> Column:
    """Array of (share_count, share_class, nominal_value_per_share, currency, currency_raw) after "divided into"."""
    at = F.regexp_instr(nearby, F.lit(DIVIDED))
    clause = F.substr(nearby, at + F.length(F.regexp_extract(nearby, DIVIDED, 0)), F.lit(CLAUSE))
    part = lambda g: F.regexp_extract_all(clause, F.lit(SHARE_CLASS), F.lit(g))
    rows = F.arrays_zip(part(1).alias("n"), part(2).alias("kind"), part(3).alias("money"), part(4).alias("nominal"))

    def one(x: Column) -> Column:
        kind, money = F.upper(collapse(x["kind"])), F.upper(x["money"])
        code = resolve_currency(money, country)
        return F.struct(
            F.regexp_replace(x["n"], "[ ,]", "").alias("share_count"),
            F.when((kind != "") & ~kind.isin(*NO_CLASSES), kind).alias("share_class"),
            normalize_decimal(x["nominal"]).alias("nominal_value_per_share"),
            code.alias("currency"),
            F.when(code.isNull(), none_if_empty(money)).alias("currency_raw"),
        )

    found = F.slice(F.array_distinct(F.transform(rows, one)), 1, MOST_CLASSES)
    return F.when(at > 0, found).otherwise(F.filter(found, lambda x: F.lit(False)))


def share_capital(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", country_col: str = "country_code", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: issued, authorized, paid-up and stated amounts, the primary one, currency, share classes.

    The primary amount is the issued, authorized or stated one, in this order. currency is set if all printed ones
    agree, else currency_candidates lists them; one that stands for no code alone is currency_raw. Without a printed
    one the country's own counts, then that of the classes. The count of all classes is issued_share_count if the
    capital divided is the issued one, else share_count. Amounts are plain decimal strings. Null texts have none.
    keep: columns to pass on.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(country_col).alias("_country"), normalize_business_text(F.col(text_col)).alias("_text"))
    # Each pattern reads only the texts that have its words: most documents have no capital.
    base = base.withColumn("_upper", F.upper("_text"))
    base = base.withColumns({f"_seen{k}": F.when(may_match(F.col("_upper"), p), F.col("_text")) for k, (_, p) in enumerate(CAPITAL)})
    country = F.col("_country")
    amounts: dict[str, list[Column]] = {}
    printed, shown, starts, ends = [], [], [], []
    for k, (field, pattern) in enumerate(CAPITAL):
        text = F.col(f"_seen{k}")
        amounts.setdefault(field, []).append(normalize_decimal(none_if_empty(F.regexp_extract(text, pattern, 2))))
        printed.append(F.upper(none_if_empty(F.regexp_extract(text, pattern, 1))))
        whole, at = none_if_empty(F.regexp_extract(text, pattern, 0)), F.regexp_instr(text, F.lit(pattern))
        shown.append(collapse(whole))
        starts.append(F.when(at > 0, at))
        ends.append(F.when(at > 0, at + F.length(whole)))
    found = base.withColumns({f: F.coalesce(*a) for f, a in amounts.items()}).withColumns(
        {
            "_raw": F.array_compact(F.array(*printed)),
            "amount_text": none_if_empty(F.array_join(F.array_distinct(F.array_compact(F.array(*shown))), " | ")),
            "_start": F.array_min(F.array(*starts)),
            "_end": F.array_max(F.array(*ends)),
        }
    )
    nearby = F.substr(F.col("_text"), F.col("_start"), F.col("_end") - F.col("_start") + NEARBY)
    codes = F.array_distinct(F.array_compact(F.transform("_raw", lambda c: resolve_currency(c, country))))
    found = found.withColumns({"_nearby": nearby, "_codes": codes}).withColumn("share_classes", share_classes(F.col("_nearby"), country))
    defaults = F.create_map(*(F.lit(x) for pair in DEFAULT_CURRENCIES.items() for x in pair))
    default = F.when((F.size("_raw") == 0) & F.col("_start").isNotNull(), F.try_element_at(defaults, F.upper(country)))
    currency = F.coalesce(F.when(F.size("_codes") == 1, F.get("_codes", F.lit(0))), default)
    of_classes = F.array_distinct(F.array_compact(F.transform("share_classes", lambda c: c["currency"])))
    before = F.substr(
        F.col("_nearby"),
        F.greatest(F.lit(1), F.regexp_instr("_nearby", F.lit(DIVIDED)) - BEFORE),
        F.least(F.lit(BEFORE), F.regexp_instr("_nearby", F.lit(DIVIDED)) - 1),
    )
    labels = F.regexp_extract_all(before, F.lit(CAPITAL_LABEL), F.lit(1))
    of_issued = F.upper(F.try_element_at(labels, F.lit(-1))) == "ISSUED"
    total = F.aggregate("share_classes", F.lit(0).cast("decimal(38,0)"), lambda n, c: (n + c["share_count"].try_cast("decimal(38,0)")).cast("decimal(38,0)"))
    count = F.when(F.size("share_classes") > 0, total.cast("string"))
    first = F.get("share_classes", F.lit(0))
    return found.select(
        "doc_id",
        *keep,
        *amounts,
        F.coalesce("issued_amount", "authorized_amount", "stated_amount").alias("amount"),
        "amount_text",
        F.coalesce(currency, F.when(F.size(of_classes) == 1, F.get(of_classes, F.lit(0)))).alias("currency"),
        F.when(F.size("_codes") > 1, F.col("_codes")).alias("currency_candidates"),
        F.when(currency.isNull(), F.get("_raw", F.lit(0))).alias("currency_raw"),
        F.when(~F.coalesce(of_issued, F.lit(False)), count).alias("share_count"),
        F.when(of_issued, count).alias("issued_share_count"),
        first["share_class"].alias("share_class"),
        first["nominal_value_per_share"].alias("nominal_value_per_share"),
        "share_classes",
    )
