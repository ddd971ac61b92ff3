"""Whole documents: parties, capital, records and their summary, identity cards, remote sources, events."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from docweave.operators import identity, nin, parties, passport_fields, records, scoring, sections
from docweave.sources import policy, remote
from docweave.streaming import webhooks

TODAY = "2026-06-03"
CERTIFICATE = """FEDERAL REPUBLIC OF NIGERIA
CORPORATE AFFAIRS COMMISSION
CERTIFICATE OF INCORPORATION
This is to certify that NORTH EXAMPLE LIMITED is hereby incorporated under the Companies and Allied Matters Act 2020
RC 1234567
Company Name: NORTH EXAMPLE LIMITED
Date of Incorporation: 12 March 2020
Date of Issue: 15 March 2020
Company Type: Private Company Limited by Shares
Company Status: Active
Registered Address: 1 Broad Street, Lagos
DIRECTORS
Alex Example
Sector Code: QX-12"""


def test_parties(spark):
    texts = {
        1: "DIRECTORS\nAlex Example    ACTIVE    100 SHARES\nMorgan Sample    INACTIVE    50 SHARES\n",
        2: "DIRECTORS\nAlex Example\nVictoria Street Central\nUnited Kingdom\nMorgan Sample\n",
        3: "DIRECTORS\nAlex Example\nSHARE CAPITAL\nDIRECTORS\nMorgan Sample\nGENERAL DETAILS\n",
        4: "SUBSCRIBERS\nFULL NAME    SHARES\nAlex Example    10 SHARES\nARTICLES OF ASSOCIATION\nDIRECTORS\nDirectors' General Authority\n"
        "Subject to the articles, the directors are responsible for management of the company.\nDIRECTORS\nCorporate Affairs Commission\nModel articles\n",
        5: None,
        6: "ROLE TYPE DIRECTOR\nFULL NAME: Ada Example\nSHARES 12\nROLE TYPE JANITOR\nFULL NAME: Nobody Here\nROLE TYPE PSC\nSURNAME: Control\nFIRST NAME: Dele",
    }
    found = parties.extract_parties(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).orderBy("doc_id", "position").collect()
    got = {i: [(r.name, r.roles, r.status, r.shares) for r in found if r.doc_id == i] for i in texts}
    director = ["DIRECTOR"]
    assert got[1] == [("Alex Example", director, "ACTIVE", "100"), ("Morgan Sample", director, "INACTIVE", "50")]
    assert got[2] == got[3] == [("Alex Example", director, None, None), ("Morgan Sample", director, None, None)]
    assert got[4] == [("Alex Example", ["SUBSCRIBER"], None, "10")] and got[5] == []
    assert got[6] == [("Ada Example", director, None, "12"), ("Control Dele", ["PERSON_WITH_SIGNIFICANT_CONTROL"], None, None)]


def test_records_and_summary(spark):
    rows = [(1, CERTIFICATE, None, None, None), (1, "COMPANY STATUS REPORT\nCompany Name: OTHER HOLDINGS PLC", "Nigeria", "nonsense", None)]
    rows += [(2, CERTIFICATE, None, None, None), (2, CERTIFICATE, None, None, None), (3, None, None, None, None), (None, "  ", None, None, None)]
    rows += [(4, "STATE OF DELAWARE\nUnited States of America\nEntity Name: X VENTURES LLC", None, "ARTICLES_OF_ORGANIZATION", "Texas")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hint string, kind string, state string")
    made = records.business_records(docs, F.lit(TODAY).cast("date"), hint_col="hint", type_hint_col="kind", state_hint_col="state").cache()
    got = made.collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r.doc_id == 1 and r.document_type == "CERTIFICATE_OF_INCORPORATION")
    assert [r.legal_company_name for r in got if r.doc_id == 2] == ["NORTH EXAMPLE LIMITED"] * 2
    assert (one.legal_company_name, one.incorporation_date, one.document_issue_date, one.company_status) == ("NORTH EXAMPLE LIMITED", "2020-03-12", "2020-03-15", "ACTIVE")
    assert one.country_code == "NGA" and one.issuing_authority.upper() == "CORPORATE AFFAIRS COMMISSION" and one.registered_office_address == "1 Broad Street, Lagos"
    assert [p.name for p in one.parties] == [p.name for p in one.directors] == ["Alex Example"] and one.shareholders == []
    assert [i.normalized_value for i in one.identifiers if i.is_primary] == ["RC1234567"] and one.overall_confidence > 0.85
    assert ("Sector Code", "QX-12") in [(a.label, a.value) for a in one.additional_fields] and one.warnings == []
    assert {e.field for e in one.evidence if e.selected} >= {"legal_company_name", "identifiers", "parties", "additional_fields"}
    report = next(r for r in got if r.doc_id == 1 and r is not one)
    assert records.SAID["no_parties"] in report.warnings and records.SAID["type_hint_unsupported"] in report.warnings
    assert [r.success for r in got if r.doc_id in (3, None)] == [False, False]
    us = next(r for r in got if r.doc_id == 4)
    assert us.jurisdiction_code == "US-DE" and us.issuing_authority and records.SAID["state_hint_conflict"] in us.warnings
    view = {r.doc_id: r for r in records.summary_view(made.where("doc_id = 2 or doc_id = 3")).collect()}
    data = json.loads(view[2].data)
    assert data["parties"] == [{"name": "Alex Example", "roles": ["DIRECTOR"]}] and "trading_name" not in data and "directors" not in data
    assert "incorporation_or_registration_date" not in data and all("normalized_value" not in i or i["normalized_value"] != i["value"] for i in data["identifiers"])
    assert json.loads(view[2].field_details)["legal_company_name"]["evidence"]["text"] and json.loads(view[3].data) == {}


def test_share_capital(spark):
    texts = [
        (1, "Share capital USD 100 divided into 1 share of USD 100 each", None),
        (2, "4. The nominal share capital of the Company is \u20a61,000,000 divided into 1,000,000 ordinary shares of \u20a61 each", "NGA"),
        (3, "Share capital $100 divided into 1 share of $100 each", None),
        (4, None, "USA"),
    ]
    got = {r.doc_id: r for r in sections.share_capital(spark.createDataFrame(texts, "doc_id long, text string, country_code string")).collect()}
    assert (got[1].stated_amount, got[1].currency, got[1].share_count, got[1].nominal_value_per_share) == ("100", "USD", "1", "100")
    assert (got[2].authorized_amount, got[2].currency, got[2].share_count, got[2].share_class) == ("1000000", "NGN", "1000000", "ORDINARY")
    assert (got[3].currency, got[3].currency_raw, got[3].share_classes[0].currency_raw) == (None, "$", "$") and got[4].amount is None


def test_state_gives_registry_and_terms(spark):
    docs = spark.createDataFrame([(1, "State of Delaware\nDelaware Division of Corporations\nUnited States")], "doc_id long, text string")
    (row,) = scoring.detect_jurisdiction(docs).collect()
    assert row.registry_name == "Delaware Division of Corporations" and row.subdivision.code == "US-DE"
    assert {"State of Delaware", "Delaware Division of Corporations", "United States"} <= set(row.matched_terms)


def test_cards_and_rotations(spark):
    good = "Tracking ID: S7Y0X1AB12\nNIN: 12345678901\nSurname: SAMPLE\nFirst Name: ADA\nGender: F\nAddress: 1 Example Street, Area 2"
    rows = [(1, 0, "noise"), (1, 90, good), (1, 180, good + "\nDate of Birth: 01-02-1990"), (2, 0, None), (3, 0, "a"), (3, 90, "NIN: 12345678901")]
    got = {r.doc_id: r for r in nin.parse_nin_rotations(spark.createDataFrame(rows, "doc_id long, rotation int, text string")).collect()}
    assert got[1].rotation == 90 and got[1].nin == "12345678901" and got[1].full_name == "ADA SAMPLE" and set(got) == {1, 3} and got[3].rotation == 90
    checks = spark.createDataFrame([("12345678901",), ("1234567890",), ("12345678901\n",), (None,)], "x string")
    assert [r[0] for r in checks.select(nin.validate_nin(F.col("x"))).collect()][:2] == [True, False]


def test_printed_names(spark):
    pages = spark.createDataFrame([(1, "SURNAME\nLONGNAME\nGIVEN NAMES\nADA"), (2, None)], "doc_id long, text string")
    zone = spark.createDataFrame([(1, "LO", "ADA"), (2, "LO", "ADA")], "doc_id long, surname string, given_names string")
    got = passport_fields.with_printed_names(zone, passport_fields.visual_fields(pages)).orderBy("doc_id").collect()
    assert [(r.surname, r.given_names) for r in got] == [("LONGNAME", "ADA"), ("LO", "ADA")]


def test_licences_without_parser(spark):
    rows = [(1, "KEN", "NAME: ADA EXAMPLE"), (2, None, "LICENSE NO: ABC-123456"), (3, "GHA", None)]
    got = identity.parse_drivers_license(spark.createDataFrame(rows, "doc_id long, country string, text string")).orderBy("doc_id").collect()
    assert [(r.success, r.message is None) for r in got] == [(False, False), (True, True), (False, True)] and got[1].country == "NGA"


def test_uploads(spark):
    png, pdf = b"\x89PNG\r\n\x1a\n", b"%PDF-1.7"
    rows = [("a b.jpg", png), ("x.pdf", png), ("x.png", pdf), ("../etc/pass wd.odd", pdf), ("..", png)]
    files = spark.createDataFrame(rows, "filename string, content binary")
    got = policy.inspect_uploads(files).collect()
    assert [r.status for r in got] == [200, 415, 415, 200, 200]
    assert [r.canonical_name for r in got] == ["a_b.png", None, None, "etc_pass_wd.pdf", "document.png"]
    assert [r.status for r in policy.inspect_uploads(files, match_extension=False).collect()] == [200] * 5


def test_settings(monkeypatch):
    monkeypatch.setenv("DOCUMENT_URL_ALLOW_HTTP", "yes")
    monkeypatch.setenv("DOCUMENT_URL_MAX_LENGTH", "1")
    monkeypatch.setenv("DOCUMENT_URL_ENABLED", "off")
    monkeypatch.setenv("DOCUMENT_URL_ALLOWED_HOSTS", "a.example., *.b.example")
    monkeypatch.setenv("DOCUMENT_URL_TOTAL_TIMEOUT_SECONDS", "x")
    found = policy.SourcePolicy.from_env()
    assert (found.allowed_ports, found.max_url_length, found.url_enabled) == ((80, 443), 256, False)
    assert found.allowed_hosts == ("a.example", "*.b.example") and found.total_timeout == 20.0


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        target = {"/go": "/doc", "/loop": "/loop", "/far": "http://private.example/doc"}.get(self.path)
        self.send_response(302 if target else 200)
        if target:
            self.send_header("Location", target)
        body = b"" if target else b"%PDF-1.7 x" if self.path == "/doc" else b"x" * 5000 if self.path == "/big" else b"plain"
        self.send_header("Content-Length", str(len(body)))
        self.send_header("Content-Disposition", 'attachment; filename="my file.pdf"')
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_remote_documents(monkeypatch):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_address[1]
    rules = policy.SourcePolicy(allow_http=True, allowed_ports=(port, 80), max_upload_bytes=4000)
    hosts = lambda host, _: ["10.0.0.1"] if host == "private.example" else ["127.0.0.1"]

    def status(path, **options):
        try:
            return remote.fetch(f"http://a.example:{port}{path}", rules, hosts, **options)["filename"]
        except remote.Refused as refused:
            return refused.status, refused.reason

    assert status("/doc") == (403, "prohibited_address")
    monkeypatch.setattr(remote, "is_public_address", lambda a: a == "127.0.0.1")
    assert [status(p) for p in ("/doc", "/go", "/loop", "/far", "/big", "/text")] == [
        "my_file.pdf", "my_file.pdf", (502, "redirect_loop"), (403, "prohibited_address"), (413, "too_large"), (415, "unsupported_type"),
    ]
    server.shutdown()
    for url, reason in (("ftp://a.example", "scheme"), ("http://u:p@a.example", "credentials_or_fragment"), ("http://a.example:1", "port"), (None, "invalid")):
        with pytest.raises(remote.Refused, match=reason):
            remote.fetch(url, rules, hosts)


def test_fetched_rows(spark):
    urls = spark.createDataFrame([(1, "ftp://a.example/x"), (2, None)], "doc_id long, url string")
    assert [(r.status, r.reason) for r in remote.fetch_documents(urls).orderBy("doc_id").collect()] == [(403, "scheme"), (400, "invalid")]


def test_events(spark):
    t0 = 1_700_000_000
    rows = [(i, t0 + i % 1000, "hot") for i in range(3000)] + [(9000, t0, "cold"), (9001, None, "cold")]
    events = spark.createDataFrame(rows, "event_id long, s long, body string").select("event_id", F.timestamp_seconds("s").alias("ts"), "body")
    accepted = sorted(r.event_id for r in webhooks.mark_duplicates(events).where("accepted").collect())
    assert accepted == sorted([9000, *range(0, 1000, 61)])
    one = spark.createDataFrame([("s", "1", "b", {"Proxy-Authorization": "x", "content-type": "t", "Other": "o"}), (None, "1", "b", None)], "k string, t string, b string, h map<string,string>")
    signed = one.select(webhooks.sign(F.col("k"), F.col("t"), F.col("b")).alias("s"), webhooks.safe_headers(F.col("h")).alias("h"), webhooks.forward_headers(F.col("h"), F.col("t"), F.lit("sig")).alias("f")).collect()
    assert signed[0].s and signed[1].s is None and signed[0].h["Proxy-Authorization"] == "[redacted]"
    assert signed[0].f == {"X-Timestamp": "1", "X-Signature": "sig", "X-Source": "webhook-forwarder", "Content-Type": "t"} and len(signed[1].f) == 3
    right = spark.createDataFrame([("100", None, "/p")], "timestamp string, signature string, path string")
    right = right.withColumn("signature", webhooks.sign(F.lit("k"), F.col("timestamp"), F.col("path")))
    wrong = spark.createDataFrame([("100", "x", "/p"), ("zz", "x", "/p"), ("1", "x", "/p"), (None, "x", "/p")], "timestamp string, signature string, path string")
    got = webhooks.verify_requests(right.union(wrong), F.lit("k"), F.lit(130)).collect()
    assert [r.reason for r in got] == [None, "invalid_signature", "invalid_timestamp", "expired", "missing_headers"]

    def post(url, body, headers):
        if url == "bad":
            raise OSError("boom")
        return 200, body.decode()

    sent = spark.createDataFrame([(1, "body", {"a": "b"})], "event_id long, body string, headers map<string,string>")
    answers = {r.target: r for r in webhooks.broadcast(sent, {"x": "http://x", "y": None, "z": "bad"}, post).collect()}
    assert answers["x"].ok and answers["x"].response_preview == "body" and answers["y"].error == "Missing target URL" and answers["z"].error == "boom"
