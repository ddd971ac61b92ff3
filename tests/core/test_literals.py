"""Literals of patterns: whatever a pattern matches holds its literal."""

import re

import pytest
from pyspark.sql import functions as F

from docweave.functions import literals as L
from docweave.functions import rules as R
from docweave.functions.literals import mandatory_literal, sql_found
from docweave.functions.profiles import REGISTRY_OF_PROFILES
from docweave.operators import business, labels, records, sections


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"\bCERTIFICATE\s+OF\s+INCORPORATION\b", "INCORPORATION"), (r"(?:AB|CD)EF", "EF"), (r"A*BCD?", "BC"), (r"(?:XYZ)+Q", "XYZ"), (r"[AB]C", "C"),
        (r"X|Y", ""), (r"(?i)ABC", ""), (r"A(?!BIG)CD", "ACD"), (r"A(?=LONG)B", "AB"), (r"\d{4}", ""), (r"((", ""), (r"A\.B", "A.B"), (r"(RC)\s*(NO)?", "RC"), (r"(?:LONGER)?AB", "AB"),
    ],
)
def test_literals(pattern, want):
    assert mandatory_literal(pattern) == want


def test_rules_run_where_their_literal_is(spark):
    """Of all rule patterns: on texts made of their own words, with the look ahead and without it."""
    patterns = [r.pattern for s in R.SIGNATURES for r in s.rules] + [m.pattern for p in REGISTRY_OF_PROFILES.list() for m in p.markers]
    assert sum(len(mandatory_literal(p)) > 1 for p in patterns) > len(patterns) / 2
    texts = [(i, " ".join(re.findall(r"[A-Z]{2,}", p.replace(r"\s+", " ")))) for i, p in enumerate(patterns)]
    df = spark.createDataFrame(texts, "i int, _text string")
    for k in range(0, len(patterns), 9):
        quick = df.selectExpr("i", f"{sql_found('_text', patterns[k], '(?s)')} AS hit").collect()
        pattern = patterns[k].replace("\\", "\\\\").replace("'", "\\'")
        assert quick == df.selectExpr("i", f"regexp_like(_text, '(?s){pattern}') AS hit").collect()


def test_all_mandatory_literals_are_looked_for(spark):
    """A state's name keeps its patterns from a text that only says secretary, and the guard is never false for a match."""
    patterns = [r"\bALABAMA\s+SECRETARY\s+OF\s+STATE\b", r"\bOHIO\s+SECRETARY\s+OF\s+STATE\b", r"\bSTATE\s+OF\s+UTAH\b"]
    assert "ALABAMA" in L.sql_found("t", patterns[0]).split("regexp_like")[0]
    rows = [("THE SECRETARY OF STATE", False), ("OHIO SECRETARY OF STATE", True), ("STATE OF UTAH", True), ("UTAH STATE", False), ("", False)]
    df = spark.createDataFrame(rows, "t string, may boolean")
    assert [r.m for r in df.selectExpr(f"{L.sql_may('t', patterns)} as m").collect()] == [r[1] for r in rows]


def test_what_is_looked_ahead_for_is_found_by_itself(spark):
    """The rule for both headings read the rest of the text from every place of it: work grew with the square of the text."""
    pattern = next(r.pattern for s in R.SIGNATURES for r in s.rules if r.pattern.startswith("(?="))
    quick = sql_found("_text", pattern, "(?s)")
    assert "(?=" not in quick
    a, b = "MEMORANDUM OF ASSOCIATION", "ARTICLES OF ASSOCIATION"
    texts = [f"X {a}\nAND {b}", f"{b} {a}", a, b, f"{a} XARTICLES OF ASSOCIATION", "", f"{a}S {b}", f"{b}\n\n{a}"]
    df = spark.createDataFrame([(t,) for t in texts], "_text string")
    asked = pattern.replace("\\", "\\\\")
    assert [r.hit for r in df.selectExpr(f"{quick} AS hit").collect()] == [r.hit for r in df.selectExpr(f"regexp_like(_text, '(?s){asked}') AS hit").collect()]
    for other in ("(?=.*A|B)(?=.*C)", "(?=.*A)B(?=.*C)", "(?=A)(?=.*B)", "(?=.*A(?=.*B))(?=.*C)"):
        assert "(?=" in sql_found("_text", other, "(?s)")
    assert "(?=" in sql_found("_text", pattern)


def test_words_of_patterns_without_case(spark):
    """Texts without a pattern's words skip it; no text that it is found in does."""
    patterns = [p for _, p in sections.CAPITAL] + [*business.NAME_PHRASES, *business.TYPE_PHRASES, *business.LAWS, *business.ISSUED, *records.AUTHORITIES, r"(?iU)\bSTRASSE\b"]
    texts = [
        "Issued Share Capital: NGN 1,000", "authorised capital is 50 divided into", "Paid-up capital 7", "capital of USD 5 divided into 5", "This is to certify that Alpha Ltd is hereby registered",
        "Companies Act 2006", "given under my hand this 1 May 2020", "secretary of state", "Corporate  Affairs\nCommission", "ſtraſſe straße", "incorporated trustees", "", "Memorandum of association of Beta Ltd",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *(L.may_match(F.upper("t"), p).alias(f"m{k}") for k, p in enumerate(patterns)), *(F.regexp_like("t", F.lit(p)).alias(f"f{k}") for k, p in enumerate(patterns))).collect()
    assert all(r[f"m{k}"] or not r[f"f{k}"] for r in rows for k in range(len(patterns)))
    assert sum(r[f"f{k}"] for r in rows for k in range(len(patterns))) > 10
    assert sum(not r[f"m{k}"] for r in rows for k in range(len(patterns))) > len(texts) * len(patterns) / 2


def test_texts_are_read_once(spark):
    """Authorities: the text is normalised once, not for each name. Pairs: a line is asked once whether it is one, and parted twice."""
    docs = spark.createDataFrame([(1, "Company Name: ALPHA LTD\nFoo\nCorporate affairs commission"), (2, None), (3, "Sample Registry")], "doc_id int, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    named = docs.select("doc_id", records.printed_authority(F.col("text")).alias("a"))
    assert plan(named).count("HEAD[") == 1
    assert {r.doc_id: r.a for r in named.collect()} == {1: "Corporate affairs commission", 2: None, 3: "Sample Registry"}
    assert plan(labels.label_values(docs)).count(labels.INLINE) == 3


def test_labels_among_the_lines_with_any(spark):
    lines = F.split("text", "\n")
    texts = ["x\nTIN: 12345\nCompany name: Alpha", "Company Name\nBeta\nTIN", "Status: active\nSTATUS\nno", "", "a\n\nDate of registration 1 May 2020"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("at", labels.labelled_at(lines, business.ALL_LABELS))
    assert [r.at for r in df.collect()] == [[1, 2], [0, 2], [0, 1], [], [2]]
    for some in (business.NAME_LABELS, business.TAX_LABELS, business.STATUS_LABELS, business.DATES["registration_date"][0]):
        valid = lambda v: F.length(v) > 1
        for scope in (lines, F.slice(lines, 1, 2)):
            both = df.select(labels.labelled(scope, some, valid).alias("a"), labels.labelled(scope, some, valid, among=F.col("at")).alias("b")).collect()
            assert [r.a for r in both] == [r.b for r in both]
