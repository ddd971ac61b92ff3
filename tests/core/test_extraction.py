"""Sufficiency of texts and what is reported of an extraction."""

from pyspark.sql import functions as F

from docweave.operators import pages, scoring


def test_metadata(spark):
    rows = [(1, 2, "b" * 9, "ocr", 0.5), (1, 1, "a", "pdf", None), (1, 3, "c", "pdf", None), (2, 1, None, None, None), (2, 2, "  ", None, None), (None, 1, "x", "pdf", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, text string, source string, conf double").repartition(3)
    got = {r.doc_id: r for r in pages.extraction_metadata(df, 2, 5, source=F.col("source"), confidence=F.col("conf")).collect()}
    assert [tuple(p) for p in got[1].pages] == [(1, "pdf", None, 1), (2, "ocr", 0.5, 5)] and (got[1].pages_processed, got[1].total_pages, got[1].truncated) == (2, 3, True)
    said = pages.EXTRACTION_WARNINGS
    assert got[1].warnings == [said["page_limit_reached"], said["page_text_limit_reached"]] and got[2].warnings == [said["no_text_extracted"]]
    assert not got[2].truncated and got[None].warnings == [] and [p.text_length for p in got[2].pages] == [0, 2]
    assert pages.extraction_metadata(df.where("false")).collect() == []


def test_sufficiency(spark):
    useful = "NATIONAL IDENTITY CARD\n" + "SURNAME GIVEN NAMES DATE OF BIRTH\n" * 12
    df = spark.createDataFrame([(useful, 0.65), (useful, 0.6), (useful, None), ("short", 0.9), (None, 0.9)], "text string, conf double")
    got = df.select(pages.embedded_text_is_sufficient(F.col("text")).alias("e"), pages.ocr_text_is_sufficient(F.col("text"), F.col("conf")).alias("o")).collect()
    assert [r.e for r in got] == [True, True, True, False, False] and [r.o for r in got] == [True, False, False, False, False]


def test_business_documents(spark):
    docs = spark.createDataFrame([(1, "CERTIFICATE OF INCORPORATION\nThis is to certify that the company X LIMITED is hereby incorporated"), (2, "a letter"), (3, None)], "doc_id long, text string")
    found = scoring.classify(docs)
    assert {r.doc_id: r.b for r in found.select("doc_id", scoring.looks_like_business_document(found).alias("b")).collect()} == {1: True, 2: False, 3: False}
