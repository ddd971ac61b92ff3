"""Webhook events as a stream: state that expires by itself, and a sink that a replayed batch does not send twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from docweave.streaming.webhooks import TTL_SECONDS, body_key, broadcast

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEDGER = "batch_id long, event_id {}, target string, url string, ok boolean, status_code int, error string, response_preview string"
_LAST = StructType([StructField("last", LongType())])


def use_native_state(spark: SparkSession) -> None:
    """Let streams of this session keep state that expires by itself, which needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _ByEventTime(StatefulProcessor):
    """The time of the last accepted event of a body, dropped by a timer once the watermark is a ttl beyond it."""

    def __init__(self, ttl: int, columns: list[str]) -> None:
        self.ttl, self.columns = ttl, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        for chunk in rows:
            chunk = chunk.sort_values(["ts", "event_id"])
            kept = []
            for at in (chunk["ts"].astype("datetime64[us]").astype("int64")).tolist():
                kept.append(last is None or at - last > self.ttl * 1_000_000)
                last = at if kept[-1] else last
            yield chunk.loc[kept, self.columns]
        if last != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((last,))
            self.handle.registerTimer(last // 1000 + self.ttl * 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class _ByArrival(StatefulProcessor):
    """A mark of a body that the store itself drops a ttl after the event that set it was accepted."""

    def __init__(self, ttl: int, columns: list[str]) -> None:
        self.ttl, self.columns = ttl, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _LAST, self.ttl * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = not self.seen.exists()
        for chunk in rows:
            if new and len(chunk):
                self.seen.update((0,))
                yield chunk.sort_values(["ts", "event_id"])[self.columns].head(1)
                new = False

    def close(self) -> None:
        pass


def accepted_events(events: DataFrame, ttl: int = TTL_SECONDS, watermark: str = "1 minute", clock: str = "event") -> DataFrame:
    """The accepted events of a stream (event_id, ts, body, ...), with state that expires by itself.

    clock "event": an event is accepted if it is over ttl seconds later than the last accepted one of its body, by ts;
    a timer drops that time once the watermark has passed it by the ttl. Events without ts are dropped. Clock "arrival":
    one event of a body, the first by ts of the first chunk, and no more until the mark has lived for the ttl; such a
    stream runs batches without end, so that a trigger "available now" never finishes.

    Bodies are keyed by their hash, null being one body. A micro-batch's events of a body come in chunks that are
    sorted each; none is gathered whole. The session must have called use_native_state().
    """
    if clock not in ("event", "arrival"):
        raise ValueError(f"clock must be 'event' or 'arrival', not {clock!r}")
    key = F.coalesce(body_key(F.col("body")), F.lit("none"))
    timed = events.where(F.col("ts").isNotNull()) if clock == "event" else events
    keyed = timed.withWatermark("ts", watermark) if clock == "event" else timed
    name = "_body"
    while name in events.columns:
        name += "_"
    processor, mode = (_ByEventTime, "EventTime") if clock == "event" else (_ByArrival, "ProcessingTime")
    grouped = keyed.withColumn(name, key).groupBy(name)
    return grouped.transformWithStateInPandas(processor(ttl, events.columns), events.schema, "append", mode)


def deliver_once(
    batch: DataFrame, batch_id: int, targets: dict[str, str | None], post: Callable[[str, bytes, dict], tuple[int, str]], ledger: str, slices: int = 4
) -> None:
    """Send a micro-batch (event_id, body, headers) to every target and note each delivery in the ledger.

    A batch that is replayed after a failure has its old number; what the ledger has of that number is not sent again,
    whether it succeeded or not. A batch goes in slices by event, each noted when it has been sent, so a driver or a
    job that is lost in between leaves the deliveries of one slice in doubt, not those of the batch. An event_id is one
    event; the header X-Delivery-Id, the same in every attempt, lets a receiver tell a repetition in such a slice.
    """
    spark = batch.sparkSession
    kind = batch.schema["event_id"].dataType.simpleString()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    delivery = F.create_map(F.lit("X-Delivery-Id"), F.concat_ws("-", F.lit(batch_id), F.col("event_id").cast("string")))
    plain = F.map_filter(headers, lambda k, v: k != "X-Delivery-Id")
    events = batch.select("event_id", "body", F.map_concat(plain, delivery).alias("headers")).dropDuplicates(["event_id"])
    slot = F.pmod(F.xxhash64("event_id"), F.lit(slices))
    for k in range(slices):
        part = events.where(slot == k)
        for name, url in targets.items():
            todo = part
            if exists:
                noted = spark.read.schema(LEDGER.format(kind)).parquet(ledger).where((F.col("batch_id") == batch_id) & (F.col("target") == name))
                todo = part.join(noted.select(F.col("event_id").alias("_id")), F.col("event_id").eqNullSafe(F.col("_id")), "left_anti")
            sent = broadcast(todo, {name: url}, post).withColumn("batch_id", F.lit(batch_id).cast("long"))
            sent.write.mode("append").partitionBy("batch_id").parquet(ledger)


def forward_stream(
    accepted: DataFrame,
    targets: dict[str, str | None],
    post: Callable[[str, bytes, dict], tuple[int, str]],
    ledger: str,
    checkpoint: str,
    **trigger: object,
) -> StreamingQuery:
    """Start a stream that sends accepted events (event_id, body, headers) to every target, each once; see deliver_once().

    ledger and checkpoint are folders that all executors share. trigger is given to DataStreamWriter.trigger().
    """
    writer = accepted.writeStream.foreachBatch(lambda batch, n: deliver_once(batch.persist(), n, targets, post, ledger)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
