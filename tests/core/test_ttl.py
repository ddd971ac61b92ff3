"""Acceptance under a time to live, against a walk over all events."""

import random

import numpy as np
from pyspark.sql import functions as F

from docweave.streaming import ttl as T
from docweave.streaming.webhooks import mark_duplicates

TTL = 10


def walked(times, ttl):
    last, out = None, []
    for t in times:
        out.append(last is None or t - last > ttl)
        last = t if out[-1] else last
    return out


def patterns(rng, n):
    yield [rng.randrange(20_000) for _ in range(n)]  # random
    yield list(range(0, 3 * n, 3))  # phases that never merge
    yield list(range(0, 11 * n, 11))  # each just over the ttl: all accepted
    yield list(range(-10 * n, 0, 10))  # exactly the ttl, before the epoch
    yield [x for k in range(n // 8) for x in (640 * k + rng.randrange(3), 640 * k + 639)]  # few events at the ends of slots
    yield [5] * n  # a burst
    yield [x * 900 for x in range(n)]  # gaps longer than a slot
    yield [x for k in range(n // 4) for x in (700 * k, 700 * k + 9, 700 * k + 9, 700 * k + 19)]


def test_steps_equal_the_walk():
    rng = random.Random(1)
    for times in patterns(rng, 400):
        times = np.unique(times)
        ttl, width = TTL, T.SLOT_TTLS * TTL
        start = int(times[0] // width * width)
        inside = times[times < start + width]
        step = T.slot_step(inside, start, ttl)
        for x in range(start - 3 * ttl, start, 3):
            last = x
            for t in inside:
                last = t if t - last > ttl else last
            assert T.take_step(step, np.array([x]), ttl)[0] == last


def test_marks_equal_the_walk(spark, monkeypatch):
    monkeypatch.setattr(T, "RADIX", 4)  # several levels of functions
    rng = random.Random(2)
    rows = [(f"k{k}", t, i, "x", 1.5) for k, times in enumerate(patterns(rng, 700)) for i, t in enumerate(times)]
    rows += [("none", None, 1, "x", 0.0), ("none", None, 1, "x", 0.0), ("k0", 7, 3, "y", 0.0), ("k0", 7, 3, "y", 0.0)]
    df = spark.createDataFrame(rows, "k string, t long, id int, slot string, accepted double").repartition(7)
    got = T.mark_accepted(df, F.col("k"), F.col("t"), ["id", "slot"], TTL).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["k", "t", "id", "slot", "accepted"]
    for name in {r[0] for r in rows}:
        own = sorted((r.t, not r.accepted) for r in got if r.k == name and r.t is not None)
        times = sorted(r[1] for r in rows if r[0] == name and r[1] is not None)
        want = sorted(zip(times, (not x for x in walked(times, TTL)), strict=True))
        assert own == want, name
    assert [r.accepted for r in got if r.t is None] == [False, False]


def test_empty_and_repeated_events(spark):
    schema = "event_id long, ts timestamp, body string, accepted string"
    assert mark_duplicates(spark.createDataFrame([], schema)).collect() == []
    at = "2026-01-01 00:00:00"
    rows = [(1, at, "a", "?"), (1, at, "a", "?"), (2, "2026-01-01 00:01:00", "a", "?"), (3, "2026-01-01 00:01:01", "a", "?"), (4, at, None, "?"), (5, at, None, "?"), (6, None, "a", "?"), (None, at, "b", "?")]
    df = spark.createDataFrame(rows, "event_id long, ts string, body string, accepted string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted(((r.event_id, r.accepted) for r in mark_duplicates(df).collect()), key=str)
    assert got == [(1, False), (1, True), (2, False), (3, True), (4, True), (5, False), (6, False), (None, True)]


def test_one_body_for_ever_is_spread(spark):
    """A million events of one body: over a hundred tasks walk, and their answers are those of one walk."""
    n = 1_000_000
    conf = {"spark.sql.shuffle.partitions": "256", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(n, numPartitions=16).select("id", (F.col("id") * 7 + F.pmod(F.xxhash64("id"), F.lit(23))).alias("t"))
        marked = T.mark_accepted(df, F.lit("hot"), F.col("t"), ["id"], 60)
        table = marked.select("t", "accepted", F.spark_partition_id().alias("task")).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    per_task = table.groupby("task").size()
    assert len(per_task) >= 100 and per_task.max() < n / 20
    table = table.sort_values(["t", "accepted"], ascending=[True, False])
    assert table["accepted"].tolist() == walked(table["t"].tolist(), 60)


def test_walk_keeps_its_own_shuffle_over_a_join_by_slot(spark):
    """The planner leaves out a repartition by the keys of a sort-merge join, which then may run without a shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2_000).select("id", F.col("id").alias("t"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("body"))
        marked = T.mark_accepted(df, F.col("body"), F.col("t"), ["id"], 10)
        plan = marked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "REPARTITION_BY_COL" in plan
