"""Streams of webhook events: expiring state, and deliveries across a restart."""

import json
import time
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from docweave.streaming import forward
from docweave.streaming.ttl import mark_accepted

SCHEMA = "event_id long, ts timestamp, body string, headers map<string,string>"


def put(folder, name, rows):
    lines = [json.dumps({"event_id": i, "ts": f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}Z", "body": b, "headers": {"A": "b"}}) for i, s, b in rows]
    (folder / f".{name}").write_text("\n".join(lines))
    (folder / f".{name}").rename(folder / name)


@pytest.fixture
def native(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    forward.use_native_state(spark)
    yield spark
    spark.conf.set(name, before)


BATCHES = [
    [(1, 0, "a"), (2, 60, "a"), (3, 61, "a"), (4, 5, "b"), (5, 0, None), (6, 0, None)],
    [(7, 100, "a"), (8, 122, "a"), (9, 700, "b")],
    [(10, 710, "b"), (11, 761, "b"), (12, 800, "a")],
]


def test_stream_accepts_what_the_batch_accepts(native, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    events = native.readStream.schema(SCHEMA).json(str(source))
    for k, rows in enumerate(BATCHES):
        put(source, f"{k}.json", rows)
        query = forward.accepted_events(events).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
        query.awaitTermination()
    got = sorted(r.event_id for r in native.read.parquet(str(out)).collect())
    rows = [(i, s, b) for batch in BATCHES for i, s, b in batch]
    every = native.createDataFrame(rows, "id long, s long, body string")
    want = mark_accepted(every, F.coalesce("body", F.lit("none")), F.col("s"), ["id"], 60).where("accepted").collect()
    assert got == sorted(r.id for r in want) == [1, 3, 4, 5, 8, 9, 11, 12]


def test_state_by_arrival_expires(native, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    events = native.readStream.schema(SCHEMA).json(str(source))

    def run(name, rows):
        put(source, name, rows)
        forward.accepted_events(events, ttl=8, clock="arrival").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start(str(out)).awaitTermination(60)
        return sorted(r.event_id for r in native.read.parquet(str(out)).collect())

    started = time.monotonic()
    assert run("0.json", [(1, 3, "a"), (2, 1, "a"), (3, 0, "b")]) == [2, 3]
    again = run("1.json", [(4, 0, "a"), (5, 0, "c")])
    if time.monotonic() - started < 8:
        assert again == [2, 3, 5]
    time.sleep(9)
    assert 6 in run("2.json", [(6, 0, "a")])
    with pytest.raises(ValueError):
        forward.accepted_events(events, clock="other")


def test_a_replayed_batch_sends_nothing_twice(native, tmp_path, monkeypatch):
    source, ledger, checkpoint, log = (tmp_path / n for n in ("in", "ledger", "cp", "log"))
    source.mkdir()
    file = str(log)

    def post(url, body, headers):
        with open(file, "a") as out:
            out.write(f"{url} {body.decode()} {headers['X-Delivery-Id']}\n")
        return (500, "no") if url == "http://y" else (200, "ok")

    events = native.readStream.schema(SCHEMA).json(str(source))
    targets = {"x": "http://x", "y": "http://y", "z": None}
    start = lambda: forward.forward_stream(forward.accepted_events(events), targets, post, f"file://{ledger}", str(checkpoint), availableNow=True)
    real, calls = forward.deliver_once, []

    def dies_at_its_end(*args):
        real(*args)
        calls.append(args[1])
        if len(calls) == 1:
            raise RuntimeError("lost after sending, before the batch is committed")

    monkeypatch.setattr(forward, "deliver_once", dies_at_its_end)
    put(source, "0.json", BATCHES[0])
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    first = log.read_text().splitlines()
    assert len(first) == 2 * 4 and calls == [0]
    start().awaitTermination()
    assert log.read_text().splitlines() == first and calls[1] == 0  # the batch was replayed under its number
    put(source, "1.json", BATCHES[1])
    start().awaitTermination()
    sent = Counter(line.rsplit("-", 1)[1] + line.split()[0] for line in log.read_text().splitlines())
    assert set(sent.values()) == {1} and {k.split("http")[0] for k in sent} == {"1", "3", "4", "5", "8", "9"}
    noted = native.read.parquet(str(ledger))
    assert Counter((r.target, r.ok) for r in noted.collect()) == {("x", True): 6, ("y", False): 6, ("z", False): 6}
