import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.functions import images, profiles
from docweave.functions import textnorm as N
from docweave.functions.rules import Rule
from docweave.operators import business, identifiers, identity, labels, mrz, pages, scoring, utility
from docweave.sources import policy
from docweave.streaming import webhooks


def values(spark, function, rows, schema="x string"):
    frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in frame.select(function(*(F.col(c.split()[0]) for c in schema.split(", ")))).collect()]


def test_text_is_normalised(spark):
    text = "A|B  c\r\n\r\nCompanyName: X\nCOMPANYNAME Y\nCompanyName Holdings\nHead_Office Address: 1 Road\nx – y z"
    want = "A B c\nCOMPANY NAME X\nCOMPANY NAME Y\nCompanyName Holdings\nHEAD OFFICE ADDRESS 1 Road\nx - y z"
    assert values(spark, N.normalize_business_text, [text, None, ""]) == [want, "", ""]


def test_scalars(spark):
    assert values(spark, N.normalize_company_name, ["Company Name: ACME  Ltd.", "X Ltd is hereby incorporated now", " ,", None]) == ["ACME Ltd", "X Ltd", None, None]
    assert values(spark, N.normalize_identifier, [" rc / 12 a#", "..", None]) == ["RC/12A", None, None]
    dates = ["12th March, 2020", "March 3 21", "2020/02/30", "13/02/2020", "02/13/99", "5.6.2041", "x", None, "Dated this 1st day of May 2019"]
    assert values(spark, N.parse_date, dates) == ["2020-03-12", "2021-03-03", None, "2020-02-13", "1999-02-13", "2041-06-05", None, None, "2019-05-01"]
    assert values(spark, N.parse_date, [("04/05/2021", "USA"), ("04/05/2021", "NGA"), ("04/05/2021", None)], "x string, c string") == ["2021-04-05", "2021-05-04", "2021-05-04"]
    assert values(spark, N.unique_clean, [([" a b ", "A  B", None, "", "c;"],)], "x array<string>") == [["a b", "c"]]
    assert values(spark, utility.receipt_date, ["Feb 14th, 2026 19:05:49", "21April,20267:53Am", "31/02/2020", None]) == ["2026-02-14", "2026-04-21", None, None]
    day = datetime.date
    pairs = [(day(2026, 1, 31), day(2026, 2, 28)), (day(2026, 2, 14), day(2026, 6, 3)), (day(2026, 7, 1), day(2026, 6, 3)), (None, day(2026, 6, 3))]
    assert values(spark, utility.completed_months, pairs, "a date, b date") == [0, 3, 0, None]


def test_check_digits(spark):
    assert values(spark, mrz.check_digit, ["L898902C3", "740812", "<<<<"]) == ["6", "2", "0"]
    line2 = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    assert values(spark, mrz.check_digits_valid, [line2, line2[:-1] + "1", "short"]) == [True, False, False]
    zone = "noise\nP<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\n" + line2
    docs = spark.createDataFrame([(1, zone), (2, None), (3, zone.replace("L898902C3", "L8989O2C3"))], "doc_id long, text string")
    got = {r.doc_id: r for r in mrz.parse_mrz(docs).collect()}
    assert (got[1].success, got[1].surname, got[1].given_names, got[1].date_of_birth) == (True, "ERIKSSON", "ANNA MARIA", "1974-08-12")
    assert got[2].reason == "no machine-readable zone" and got[3].passport_number == "L898902C3"


def test_classifier(spark):
    texts = {
        1: "CERTIFICATE OF INCORPORATION this is to certify that the company is incorporated under the Act, registrar",
        2: "a shopping list", 3: None,
        4: "MEMORANDUM AND ARTICLES OF ASSOCIATION. MEMORANDUM OF ASSOCIATION, ARTICLES OF ASSOCIATION of the company",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in scoring.classify(docs).collect()}
    assert got[1].document_type == "CERTIFICATE_OF_INCORPORATION" and got[1].confidence == 1.0
    assert got[2].document_type == got[3].document_type == "UNKNOWN_BUSINESS_DOCUMENT" and got[3].alternatives == []
    assert got[4].document_type == "MEMORANDUM_AND_ARTICLES_OF_ASSOCIATION" and not got[4].ambiguous


def test_jurisdiction_hints(spark):
    rows = [(1, "Companies House, England and Wales", "UK"), (2, "Companies House, England and Wales", "Ghana"), (3, "nothing", "kenya"), (4, None, "FRA"), (5, "", None)]
    got = {r.doc_id: r for r in scoring.detect_jurisdiction(spark.createDataFrame(rows, "doc_id long, text string, h string"), hint_col="h").collect()}
    assert [(got[i].country_code, got[i].source) for i in range(1, 6)] == [
        ("GBR", "country_hint_and_document"), ("GBR", "document_text_conflict"), ("KEN", "country_hint"), ("FRA", "country_hint_unprofiled"), (None, "undetermined"),
    ]


def test_registry_of_profiles():
    registry = profiles.Profiles(profiles.checked(profiles.BUILT_IN))
    assert registry.resolve("u.s.") == "USA" and registry.resolve("Atlantis") is None and registry.get("zz") is None
    fresh = profiles.Profile("FRA", "France", "Infogreffe", ("FR",), (Rule("x", r"\bINFOGREFFE\b", 60),))
    registry.register(fresh)
    with pytest.raises(ValueError):
        registry.register(fresh)
    registry.register(fresh, replace=True)
    with pytest.raises(ValueError):
        registry.register(profiles.Profile("FRX", "Elsewhere", "R", ("FR",), ()))
    assert registry.unregister("fra") is fresh and len(registry.list()) == 8
    assert registry.get("nowhere", fallback=True).code == "XXX" and len(profiles.describe(registry.get("US"))["subdivisions"]) == 51
    with pytest.raises(ValueError):
        registry.register(profiles.Profile("XXX", "Other", "R", (), ()))


def test_labels_and_fields(spark):
    text = "Company Status: Active\nFILING CATEGORY\nMerchant 7\nRegistered Address:\n12 Broad Street\nSUITE\nEmail: a@b.co\nsector - x1"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    pairs = [(r.label, r.value, r.confidence) for r in labels.label_values(docs).orderBy("line_no").collect()]
    assert ("FILING CATEGORY", "Merchant 7", 0.66) in pairs and ("Email", "a@b.co", 0.76) in pairs and ("sector", "x1", 0.76) in pairs
    known = docs.withColumns({"country_code": F.lit("NGA"), "document_type": F.lit("CERTIFICATE_OF_INCORPORATION")})
    got = {r.doc_id: r for r in business.core_fields(known).collect()}
    assert got[1].company_status.value == "ACTIVE" and got[1].registered_address.value == "12 Broad Street" and got[1].contact_email.value == "a@b.co"
    assert got[2].company_name is None


def test_identifiers_have_offsets(spark):
    text = "é🎉 RC 1234567 and TIN: 12345678-0001, EIN 12 3456789"
    docs = spark.createDataFrame([(1, text, "NGA"), (2, None, "NGA"), (3, "Company Number: AB12345 company no AB-12345", None)], "doc_id long, text string, country_code string")
    got = identifiers.resolve_identifiers(identifiers.identifier_candidates(docs)).collect()
    one = {r.normalized_value: r for r in got if r.doc_id == 1}
    assert set(one) == {"RC1234567", "12345678-0001"} | ({"12-3456789"} & set(one))
    rc = one["RC1234567"]
    assert text[rc.start : rc.end] == "RC 1234567" and rc.is_primary and rc.number_type == "CAC_RC"
    assert len([r for r in got if r.doc_id == 3]) == 1


def test_candidates_merge(spark):
    rows = [(1, "name", "ALPHA LTD", 0.94, 0), (1, "name", "Beta", 0.98, 1), (2, "name", "ALPHA", 0.94, 0), (2, "name", "Beta", 0.95, 1), (3, "name", "A-1", 0.5, 0), (3, "name", "a1", 0.9, 1), (3, "x", None, 0.9, 1), (4, "name", "ACME LTD", 0.8, 0), (4, "name", "Acme Ltd.", 0.9, 1), (4, "name", "OTHER", 0.85, 2)]
    rows += [(5, "name", "A", None, 0), (5, "name", "B", 0.53, 1)]
    got = {r.doc_id: r for r in business.merge_candidates(spark.createDataFrame(rows, "doc_id long, field string, value string, confidence double, parser int")).collect()}
    assert [(got[i].value, got[i].confidence, got[i].conflict) for i in (1, 2, 3, 4, 5)] == [("Beta", 0.98, True), ("ALPHA", 0.94, True), ("A-1", 0.5, False), ("OTHER", 0.85, True), ("B", 0.53, True)]


def test_boxes_and_pages(spark):
    boxes = [(1, 10.0, 50.0, 10.0, "b"), (1, 12.0, 5.0, 10.0, "a"), (1, 40.0, 0.0, 0.0, "c"), (1, 46.5, 9.0, 0.0, "d"), (1, 54.0, 9.0, 0.0, "e")]
    got = pages.group_boxes(spark.createDataFrame(boxes, "doc_id long, y double, x double, h double, text string")).collect()
    assert got[0].text == "a b\nc d\ne"
    polygon = [([[0.0, 0.0], [4.0, 0.0], [4.0, 8.0], [0.0, 8.0]],), (None,)]
    geometry = values(spark, pages.box_geometry, polygon, "b array<array<double>>")
    assert tuple(geometry[0]) == (4.0, 0.0, 8.0) and tuple(geometry[1]) == (0.0, 0.0, 12.0)
    assert values(spark, pages.readability_score, ["a b\nc", "�", None]) == [7, 0, 0]


def test_sources(spark):
    heads = [b"%PDF-1.7", b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n..", b"II*\0", b"MM\0*", b"BM..", b"RIFF1234WEBP", b"RIFF1234WAVE", b"", None]
    assert values(spark, policy.file_type, [(h,) for h in heads], "b binary") == ["pdf", "jpeg", "png", "tiff", "tiff", "bmp", "webp", None, None, None]
    urls = ["https://a.example.com/x?y=1", "http://a.example.com/", "https://u:p@a.example.com/", "https://a.example.com/#f", "https://a.example.com:8443/", "nonsense", None, "HTTPS://A.Example.com"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [(r.status, r.normalized_url) for r in policy.check_urls(frame).collect()]
    assert [g[0] for g in got] == [200, 403, 403, 403, 403, 400, 400, 200] and got[-1][1] == "https://a.example.com/"
    assert [policy.is_public_address(a) for a in ("8.8.8.8", "127.0.0.1", "10.1.1.1", "::1", "::ffff:10.0.0.1", "x", None)] == [True] + [False] * 6


def test_webhooks(spark):
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, at(0), "x"), (2, at(60), "x"), (3, at(61), "x"), (4, at(100), "x"), (5, at(0), "y"), (6, None, "x"), (7, at(5), None)]
    got = {r.event_id: r.accepted for r in webhooks.mark_duplicates(spark.createDataFrame(rows, "event_id long, ts timestamp, body string")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True}
    signed = spark.range(1).select(webhooks.sign(F.lit("k"), F.lit(5), F.lit("body")).alias("s")).first().s
    assert signed == __import__("hmac").new(b"k", b"5.body", "sha256").hexdigest()
    headers = spark.range(1).select(webhooks.safe_headers(F.create_map(F.lit("Cookie"), F.lit("a"), F.lit("X"), F.lit("b"))).alias("h")).first().h
    assert headers == {"Cookie": "[redacted]", "X": "b"}


def test_stream_accepts_once(spark, tmp_path):
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, at(0), "x"), (2, at(30), "x"), (3, at(61), "x"), (4, at(0), "y")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, body string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, body string").parquet(str(tmp_path / "in"))
    query = webhooks.accepted_stream(stream).writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.event_id for r in spark.table("accepted").collect()) == [1, 3, 4]


def test_image_metrics():
    white = np.full((20, 30, 3), 255, np.uint8)
    assert images.glare(white)["glare_pct"] == 100 and images.scan_like(white)["scan_like"] and images.flash_hint(white)["flashy"]
    spots = np.zeros((20, 30, 3), np.uint8)
    spots[2:4, 2:4] = spots[4:6, 4:6] = 255  # touch at a corner
    spots[15, 20] = 255
    assert images.largest_component(spots[:, :, 0] > 0) == (8, 16)
    assert images.glare(spots) == {"glare_pct": 1.5, "spot_pct": 1.33, "box_pct": 2.67, "localized": True}
    assert images.largest_component(np.zeros((3, 3), bool)) == (0, 0)


def test_statements_and_licences(spark):
    text = "UNITED BANK FOR AFRICA\nBank Statement\nSAMPLECUSTOMER\n12SAMPLESTREETLAGOS\nOpening Balance: NGN 1,234.50"
    row = identity.parse_bank_statement(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).where("doc_id = 1").first()
    assert (row.account_name, row.address, row.opening_balance, row.bank_name) == ("SAMPLE CUSTOMER", "12 SAMPLE STREET LAGOS", "1,234.50", "United Bank for Africa")
    bills = spark.createDataFrame([(1, "Biler IKEJA ELECTRC"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in utility.parse_utility_bill(bills, F.lit("2026-06-03").cast("date")).collect()}
    assert got[1].provider_code == "IKEDC" and got[2].confidence == "REJECT" and not got[2].is_recent


def test_nigerian_voter_cards(spark):
    text = (
        "FEDERAL REPUBLIC OF NIGERIA\nCODE: 24-03-07-012 \nVIN: 90F5 B0C2 1234 5678 901\nDELIM: LAGOSI MAINLAND\nWARD\n"
        "DOE.SAMPLEHOLDER\nDATEOFBIRTH GENDER\n02121990 M\nOCCUPATION TRADER\nADDRESS 4SAMPLESTREET.LAGOS"
    )
    got = {r.doc_id: r for r in identity.parse_nigeria_voter(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    row = got[1]
    assert (row.code, row.vin, row.full_name, row.date_of_birth) == ("24-03-07-012", "90F5B0C212345678901", "DOE, SAMPLE HOLDER", "02-12-1990")
    assert (row.delimitation, row.occupation, row.address) == ("LAGOS MAINLAND WARD", "TRADER", "4 SAMPLE STREET, LAGOS")
    assert not got[2].success and got[2].delimitation is None and got[2].date_of_birth is None


def test_sections(spark):
    from docweave.operators import sections

    text = (
        "MEMORANDUM\nOBJECTS OF THE COMPANY:\n1. To carry on trading\nand farming\n2. To own property\nSHARE CAPITAL\n"
        "Issued share capital: NGN 500.00 and paid-up capital is NGN 0,250"
    )
    docs = spark.createDataFrame([(1, text, "NGA"), (2, None, None), (3, "Share capital of the company is $ 1,000,000 divided into shares", "CAN")], "doc_id long, text string, country_code string")
    objects = {r.doc_id: r.objects for r in sections.objects_clauses(docs).collect()}
    assert objects == {1: ["To carry on trading and farming", "To own property"], 2: [], 3: []}
    capital = {r.doc_id: r for r in sections.share_capital(docs).collect()}
    assert (capital[1].issued_amount, capital[1].paid_up_amount, capital[1].amount, capital[1].currency) == ("500.00", "0250".lstrip("0"), "500.00", "NGN")
    assert (capital[3].stated_amount, capital[3].currency) == ("1000000", "CAD") and capital[2].amount is None


def test_receipt_date_tidies_its_text_once(spark):
    from docweave.operators.utility import receipt_date

    assert str(receipt_date(F.lit("1/2/2026"))).count("Monday") <= 2


def test_clean_address_parts_known_words_in_order(spark):
    import re

    from docweave.operators.utility import ADDRESS_TOKENS, clean_address

    texts = ["ABROADSTREETLAGOS", "LOKOGOMA LOKOGO", "XLOKOGOMAESTATEROADNEARHOTEL", "FO1AVENUE/ROAD,STREET.", "AIRPRTROADAIRPORT", "nothing", "LAGOS", "ZONELUGBE-ABUJA"]

    def plain(out):
        for token in ADDRESS_TOKENS:
            out = re.sub(rf"(?<!^)(?<![\s,/])({token})", r" \1", out)
            out = re.sub(rf"({token})(?!$)(?![\s,.])", r"\1 ", out)
        return re.sub(r"\s+", " ", re.sub(r"\s*,\s*", ", ", out)).strip(" ,")

    got = [r.a for r in spark.createDataFrame([(t,) for t in texts], "t string").select(clean_address(F.col("t")).alias("a")).collect()]
    want = [plain(re.sub(r"(\d)([A-Z])", r"\1 \2", t.upper())) for t in texts]
    assert got == want


def test_party_names_are_cut_out_once(spark):
    from docweave.operators.parties import party_name

    assert str(party_name(F.col("line"))).count("INACTIVE") == 1
