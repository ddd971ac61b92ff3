"""Which of repeated events are accepted under a time to live, without a task for all events of one body.

An event is accepted if the last accepted event of its body is over the ttl older. Whether it is depends on all before
it, but only through one number, the time of that last event. Time is cut into slots. Of a slot, only what it makes of
that number matters: a step function, given by the events it may be entered at (those within a ttl of its start and the
first beyond) and the last event accepted from each. Functions of consecutive slots compose, RADIX at a time, to those
of longer spans; from the top, the number then goes down to every slot, and the slots are walked independently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import dealt, discard, materialize

#: Width of a slot in times to live; functions that are composed together.
SLOT_TTLS, RADIX = 64, 64
#: Older than any event.
NEVER = -(1 << 62)
Step = tuple[np.ndarray, np.ndarray]


def slot_step(times: np.ndarray, start: int, ttl: int) -> Step:
    """(entries, lasts) of a slot with these ascending times: entered at an entry, the last accepted time is its last.

    Neighbours with the same last are one entry, the later one: a number x leads to the first entry above x + ttl.
    """
    n = len(times)
    after = np.searchsorted(times, times + ttl, side="right")
    last = np.where(after < n, after, np.arange(n))
    while True:  # twice as many steps each time, until every event points to one without a next
        further = last[last]
        if (further == last).all():
            break
        last = further
    entries = min(n, int(np.searchsorted(times, start + ttl, side="right")) + 1)
    lasts = times[last[:entries]]
    keep = np.append(lasts[1:] != lasts[:-1], True)
    return times[:entries][keep], lasts[keep]


def take_step(step: Step, values: np.ndarray, ttl: int) -> np.ndarray:
    """What a slot makes of last accepted times; they stay where no event of the slot is accepted after them."""
    entries, lasts = step
    at = np.searchsorted(entries, values + ttl, side="right")
    return np.where(at < len(entries), lasts[np.minimum(at, len(entries) - 1)], values)


def compose(steps: Sequence[Step], ttl: int) -> Step:
    """The function of consecutive slots. A slot may be passed without an event accepted: then the next is entered first."""
    entries, values = steps[0]
    for k, step in enumerate(steps[1:]):
        values = take_step(step, values, ttl)
        if not k:
            entries, values = np.append(entries, step[0][0]), np.append(values, step[1][0])
    keep = np.append(values[1:] != values[:-1], True)
    return entries[keep], values[keep]


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], names: Sequence[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows (of names) of each run of equal keys in sorted batches."""
    now, rows = None, []
    for batch in batches:
        own = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
        for key, row in zip(own, zip(*(batch.column(c).to_pylist() for c in names), strict=True), strict=True):
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows


def _grouped(
    df: DataFrame, keys: Sequence[str], order: str, names: Sequence[str], make: Callable[[tuple, list[tuple]], Iterator[tuple]], schema: str
) -> DataFrame:
    """Rows that make gives for each group of keys, whose rows it gets in order; groups stream by in sorted partitions."""
    types = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in _groups(batches, keys, names):
            out += make(key, rows)
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    runs = dealt(df.select(*{*keys, order, *names}), *keys).sortWithinPartitions(*keys, order)
    return runs.mapInArrow(run, schema)


_STEPS = "key string, seg long, node long, entries array<long>, lasts array<long>"


def _entered(events: DataFrame, slots: DataFrame, ttl: int, width: int) -> DataFrame:
    """(key, slot, last_in) of the slots in chains of several: the last accepted time before each.

    slots are (key, slot, seg, node, size): a chain's slots, numbered, each within a ttl of the one before.
    """
    times = events.select("key", "slot", "at").distinct().join(slots, ["key", "slot"])

    def first(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        name, slot = key
        entries, lasts = slot_step(np.array([r[0] for r in rows], np.int64), slot * width, ttl)
        yield name, rows[0][1], rows[0][2], entries.tolist(), lasts.tolist()

    def combined(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        entries, lasts = compose([(np.array(e, np.int64), np.array(x, np.int64)) for e, x in rows], ttl)
        yield *key, entries.tolist(), lasts.tolist()

    def down(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        value = np.array([rows[0][3]], np.int64)
        for node, entries, lasts, _ in rows:
            yield key[0], key[1], node, int(value[0])
            value = take_step((np.array(entries, np.int64), np.array(lasts, np.int64)), value, ttl)

    size = slots.agg(F.max("size")).first()[0]
    levels = [materialize(_grouped(times, ["key", "slot"], "at", ["at", "seg", "node"], first, _STEPS), "ttl-slots")]
    while size > RADIX:
        size = -(-size // RADIX)
        up = levels[-1].withColumn("parent", F.floor(F.col("node") / RADIX))
        made = _grouped(up, ["key", "seg", "parent"], "node", ["entries", "lasts"], combined, _STEPS.replace("node", "parent"))
        levels.append(materialize(made.withColumnRenamed("parent", "node"), "ttl-spans"))
    above = None
    for level in reversed(levels):
        rows = level.withColumn("parent", F.floor(F.col("node") / RADIX))
        rows = rows.withColumn("value", F.lit(NEVER)) if above is None else rows.join(above, ["key", "seg", "parent"])
        names = ["node", "entries", "lasts", "value"]
        found = _grouped(rows, ["key", "seg", "parent"], "node", names, down, "key string, seg long, parent long, value long")
        above = materialize(found, "ttl-entered")
    discard(*levels)
    entered = above.withColumnRenamed("parent", "node").join(slots, ["key", "seg", "node"])
    return entered.select("key", "slot", F.col("value").alias("last_in"))


def mark_accepted(events: DataFrame, key: Column, at: Column, order: Sequence[str], ttl: int, flag: str = "accepted") -> DataFrame:
    """events with flag: whether the event is accepted; at is its time and ttl the time to live, both in whole units.

    Events of a key, a text without nulls, go by (at, order). One exactly ttl old still is a duplicate. Events without a
    time are not accepted. A column named flag is replaced; repeated rows are events of their own.
    """
    taken = {c.lower() for c in events.columns}
    fresh = {}
    for name in ("key", "at", "slot", "last_in"):
        fresh[name] = f"_{name}"
        while fresh[name].lower() in taken:
            fresh[name] += "_"
    kept = [c for c in events.columns if c.lower() != flag.lower()]
    width = SLOT_TTLS * ttl
    keyed = events.withColumns({fresh["key"]: key, fresh["at"]: at})
    slot = F.floor(F.col(fresh["at"]) / width)
    timed = keyed.where(F.col(fresh["at"]).isNotNull()).withColumn(fresh["slot"], slot)
    plain = timed.select(*(F.col(fresh[n]).alias(n) for n in ("key", "at", "slot")))

    spans = plain.groupBy("key", "slot").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    along = Window.partitionBy("key").orderBy("slot")
    # Rows of this window are slots, not events.
    linked = F.coalesce(F.col("low") - F.lag("high").over(along) <= ttl, F.lit(False))
    chains = spans.withColumn("linked", linked).withColumn("seg", F.sum((~F.col("linked")).cast("long")).over(along))
    chain = Window.partitionBy("key", "seg")
    chains = chains.withColumns({"size": F.count(F.lit(1)).over(chain), "node": (F.row_number().over(chain.orderBy("slot")) - 1).cast("long")})
    chains = materialize(chains.where("size > 1").select("key", "slot", "seg", "node", "size"), "ttl-chains")

    joined = timed.withColumn(fresh["last_in"], F.lit(NEVER))
    if not chains.isEmpty():
        entered = _entered(plain, chains, ttl, width)
        named = entered.select(*(F.col(n).alias(fresh[n]) for n in ("key", "slot", "last_in")))
        joined = timed.join(named, [fresh["key"], fresh["slot"]], "left").withColumn(fresh["last_in"], F.coalesce(fresh["last_in"], F.lit(NEVER)))
    columns = [*kept, fresh["key"], fresh["slot"], fresh["at"], fresh["last_in"]]
    by = [fresh["key"], fresh["slot"]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, NEVER
        for batch in batches:
            flags = []
            for *own, time, before in zip(*(batch.column(c).to_pylist() for c in columns[len(kept) :]), strict=True):
                if own != now:
                    now, last = own, before
                new = time - last > ttl
                last = time if new else last
                flags.append(new)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(flags, pa.bool_())], [*kept, flag])

    runs = dealt(joined.select(*(F.col(f"`{c}`") for c in columns)), *by).sortWithinPartitions(*by, fresh["at"], *order)
    schema = events.select(*(F.col(f"`{c}`") for c in kept)).withColumn(flag, F.lit(None).cast("boolean")).schema
    untimed = keyed.where(F.col(fresh["at"]).isNull()).select(*(F.col(f"`{c}`") for c in kept)).withColumn(flag, F.lit(False))
    return runs.mapInArrow(walk, schema).unionByName(untimed)
