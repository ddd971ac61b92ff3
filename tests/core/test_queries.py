"""Every query that SQL can express gives the rows DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from docweave.plans import registry, utility_queries
from docweave.plans.views import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.sql(f"create view {path.stem} as select * from '{path}'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_match(spark, oracle, name):
    frame = registry.queries()[name](spark, SF)
    want = oracle.sql(registry.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert registry.flagship(spark, SF).columns[0] == "doc_id"


def test_excerpts_of_every_page(spark):
    pages = [(r.doc_id, r.page_number, r.text) for r in view(spark, SF, "doc_pages").collect()]
    of_doc = {}
    for doc, page, text in pages:
        of_doc.setdefault(doc, []).append((page, " ".join(text.split()).lower()))
    want = {}  # a page number may occur twice: the first page of either
    for doc, page, text in pages:
        for kind, part in (("p", text), ("m", text[len(text) // 2 :])):
            part = " ".join(part.split()).lower()
            found = [n for n, whole in of_doc[doc] if len(part) >= 4 and part in whole]
            if found:
                key = doc, f"{kind}{page}"
                want[key] = min([*found, *([want[key]] if key in want else [])])
    got = [(r.doc_id, r.field, r.page_number) for r in registry.queries()["excerpt_pages_whole"](spark, SF).collect()]
    assert {f for _, f in want} >= {"p1", "m1", "p2", "m2"}
    assert sorted(got) == sorted((*key, page) for key, page in want.items())


def test_misspelt_provider_of_a_receipt(spark, monkeypatch):
    text = "Biller\nABUJA ELECTRICTY\nBeneficiary ID: 20000000001\nAddress:\nPlot 1 Sample\nRoad Kubwa\nDate: 1/6/2026"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    monkeypatch.setattr(utility_queries, "view", lambda *_: docs)
    (row,) = utility_queries.utility_fields(spark, SF).collect()
    assert row.provider == "ABUJA ELECTRICTY" and row.provider_code == "AEDC"
