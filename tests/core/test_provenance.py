"""Page numbers of offsets and excerpts, against plain loops; authorities that may be one."""

import random

from pyspark.sql import functions as F

from docweave.functions import textnorm
from docweave.operators import business, provenance, records


def brute_span(start, end, pages):
    joined = "\n".join(p or "" for p in pages)
    lead = len(joined) - len(joined.lstrip())
    at = 0
    if not 0 <= start < end:
        return None
    for number, page in enumerate(pages, 1):
        if start + lead < at + len(page or "") and end + lead > at:
            return number
        at += len(page or "") + 1
    return None


def test_page_of_spans(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        pages = [rng.choice(["", None, "a", "ab\ncd", "  ", "Some words here. ", "é" * 9]) for _ in range(rng.randrange(0, 9))]
        for _ in range(6):
            start = rng.randrange(-1, 40)
            rows.append((i, pages, start, start + rng.randrange(0, 9)))
    df = spark.createDataFrame(rows, "doc_id int, pages array<string>, start int, end int")
    found = df.select("*", provenance.page_of_span(provenance.page_spans(F.col("pages")), F.col("start"), F.col("end")).alias("page"), provenance.joined_text(F.col("pages")).alias("text"))
    for r in found.collect():
        assert r.page == brute_span(r.start, r.end, r.pages), r
        assert r.text == "\n".join(p or "" for p in r.pages).strip()


def test_many_pages(spark):
    pages = ["x" * (i % 7) for i in range(3000)]
    df = spark.createDataFrame([(pages, s, s + 3) for s in range(0, 12000, 997)], "pages array<string>, start int, end int")
    for r in df.select("start", "end", provenance.page_of_span(provenance.page_spans(F.col("pages")), F.col("start"), F.col("end")).alias("page")).collect():
        assert r.page == brute_span(r.start, r.end, pages)


def test_page_of_excerpts(spark):
    pages = ["Nothing here", "Company  Name:\tALPHA\nLtd", None, "alpha ltd | beta"]
    rows = [(pages, e) for e in ("company name: alpha ltd", "ALPHA", "zz | Ltd", "no such", "", None, "be | alpha ltd", "x|ny", "ab | ta")]
    df = spark.createDataFrame(rows, "pages array<string>, excerpt string")
    flat = provenance.flat_pages(F.col("pages"))
    got = [(r.a, r.b) for r in df.select(provenance.page_of_phrase(flat, F.col("excerpt")).alias("a"), provenance.page_of_parts(flat, F.col("excerpt")).alias("b")).collect()]
    assert got == [(2, 2), (2, 2), (None, 2), (None, None), (None, None), (None, None), (2, 2), (None, None), (None, None)]


def test_evidence_of_records_has_pages(spark):
    pages = [
        "\n  FEDERAL REPUBLIC OF NIGERIA\nCORPORATE AFFAIRS COMMISSION\nCERTIFICATE OF INCORPORATION",
        "This is to certify that NORTH EXAMPLE LIMITED is hereby incorporated under the Companies and Allied Matters Act 2020\nRC 1234567\nCompany Name: NORTH EXAMPLE LIMITED",
        "Date of Incorporation: 12 March 2020\nCompany Status: Active\nRegistered Address: 1 Broad Street, Lagos",
        "DIRECTORS\nAlex Example\nSector Code: QX-12",
    ]
    docs = spark.createDataFrame([(1, pages, "extra"), (2, [], "extra"), (3, None, "extra")], "doc_id long, pages array<string>, page string")
    made = {r.doc_id: r for r in records.business_records(docs, F.lit("2026-06-03").cast("date"), pages_col="pages").collect()}
    evidence = {(e.field, e.method): e.page for e in made[1].evidence}
    assert None not in evidence.values()
    at = {f: {p for (g, _), p in evidence.items() if g == f} for f, _ in evidence}
    assert at["legal_company_name"] == {2} and at["incorporation_date"] == {3} and at["company_status"] == {3} and at["issuing_authority"] == {1}
    assert at["parties"] == {4} and at["additional_fields"] == {4} and {i.page for i in made[1].identifiers} == {2}
    assert [made[i].success for i in (2, 3)] == [False, False] and made[2].evidence == []


def test_authorities(spark):
    rows = [
        ("Delaware Secretary of State", "Delaware Division of Corporations", True), ("Corporate Affairs Commission", "Companies Registry", False),
        ("Delaware Office", "Delaware Registry", False), (None, "Registrar", False), ("Secretary of State", "STATE REGISTRY", False),
        ("corporate affairs commission", "Corporate Affairs Division", True),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", business.authorities_compatible(F.col("a"), F.col("b")).alias("got")).collect())
    cand = [(1, "issuing_authority", rows[0][0], 0.8, 0), (1, "issuing_authority", rows[0][1], 0.81, 1), (2, "issuing_authority", rows[1][0], 0.8, 0), (2, "issuing_authority", rows[1][1], 0.81, 1)]
    got = {r.doc_id: (r.value, r.conflict) for r in business.merge_candidates(spark.createDataFrame(cand, "doc_id long, field string, value string, confidence double, parser int")).collect()}
    assert got == {1: (rows[0][1], False), 2: (rows[1][0], True)}


def test_first_pages_are_merged(spark):
    """Excerpts are not sent whole to every executor, however small their table looks; tidy texts are not rewritten, others are."""
    texts = ["a b", " a b ", "a  b", "a\tb", "a\nb", "a\x0bb", "a\x0cb", "a\rb", "é b", "é b", "a b", "　a", "a\x1cb", "", None, "  "]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id int, page_number int, text string")
    both = df.select(textnorm.collapse(F.col("text")).alias("a"), textnorm.collapse_untidy(F.col("text")).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]
    excerpts = spark.createDataFrame([(2, "x", "zz | A  B C"), (2, "y", "a b c d | none")], "doc_id int, field string, excerpt string")
    pages = spark.createDataFrame([(2, 2, "q A b\tc"), (2, 1, "a b"), (2, 3, "a b c d")], "doc_id int, page_number int, text string")
    found = business.first_pages(excerpts, pages)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.field, r.page_number) for r in found.collect()) == [("x", 2), ("y", 3)]
