"""Webhook events: duplicates within a time to live, signatures, redaction; in batch and as a stream."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType

from docweave.streaming.ttl import mark_accepted

TTL_SECONDS = 60
# Headers that never reach a log.
REDACTED = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-signature", "x-webhook-secret")
SOURCE = "webhook-forwarder"
PASSED_ON = ("Content-Type", "X-Request-Id", "X-Correlation-Id")
EXPIRY_SECONDS = 60


def body_key(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def mark_duplicates(events: DataFrame, ttl: int = TTL_SECONDS, id_col: str = "event_id", time_col: str = "ts", body_col: str = "body") -> DataFrame:
    """Add accepted: false for an event whose body was accepted at most ttl seconds before.

    Only an accepted event starts a new span; its duplicates don't prolong it, and one exactly ttl seconds old still
    is a duplicate. Events run by (time, id). Null bodies are one body. An event without a time is never accepted.
    Repeated ids and rows are events of their own, a column accepted is replaced. A body that is repeated for ever is
    spread over tasks by time; see mark_accepted().
    """
    key = F.coalesce(body_key(F.col(f"`{body_col}`")), F.lit("none"))
    at = F.unix_micros(F.col(f"`{time_col}`").cast("timestamp"))
    return mark_accepted(events, key, at, [f"`{id_col}`"], ttl * 1_000_000)


def accepted_stream(events: DataFrame, ttl: int = TTL_SECONDS, watermark: str = "1 minute") -> DataFrame:
    """The same as a stream over (event_id, ts, body): accepted events only, by event time; state lives for the ttl."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        kept = []
        for row in rows.itertuples(index=False):
            at = int(row.ts.timestamp() * 1_000_000)
            if last is None or at - last > ttl * 1_000_000:
                last = at
                kept.append(row)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + ttl * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=rows.columns)

    keyed = events.withWatermark("ts", watermark).withColumn("key", body_key(F.col("body")))
    return keyed.groupBy("key").applyInPandasWithState(
        decide, keyed.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


@F.pandas_udf(StringType())
def _hmac(secret: pd.Series, message: pd.Series) -> pd.Series:
    pairs = zip(secret, message, strict=True)
    return pd.Series([None if s is None or m is None else hmac.new(s.encode(), m, hashlib.sha256).hexdigest() for s, m in pairs], dtype=object)


def sign(secret: Column, timestamp: Column, body: Column) -> Column:
    """HMAC-SHA256, hex, of the timestamp, a dot and the body; null if one of them or the secret is null.

    Spark has no such function, hence Arrow batches.
    """
    return _hmac(secret, F.concat(F.concat(timestamp.cast("string"), F.lit(".")).cast("binary"), body.cast("binary")))


def safe_headers(headers: Column) -> Column:
    """Headers with the values of sensitive ones replaced, whatever their case."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*REDACTED), "[redacted]").otherwise(v))


def forward_headers(headers: Column, timestamp: Column, signature: Column) -> Column:
    """The headers sent to a target: time, signature, source, and those of PASSED_ON that the event has."""
    lower = F.transform_keys(F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    own = F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in ("X-Timestamp", timestamp.cast("string"), "X-Signature", signature, "X-Source", SOURCE)))
    passed = F.create_map(*(x for h in PASSED_ON for x in (F.lit(h), F.try_element_at(lower, F.lit(h.lower())))))
    return F.map_concat(own, F.map_filter(passed, lambda k, v: F.coalesce(v, F.lit("")) != ""))


def verify_requests(requests: DataFrame, secret: Column, now: Column, expiry: int = EXPIRY_SECONDS) -> DataFrame:
    """Add status (200 or 401) and reason to (timestamp, signature, path), all texts; now is in seconds.

    The signature is that of the timestamp, a dot and the path, at most expiry seconds old or ahead.
    """
    at = F.col("timestamp").try_cast("long")
    missing = (F.coalesce("timestamp", F.lit("")) == "") | (F.coalesce("signature", F.lit("")) == "")
    reason = (
        F.when(missing, "missing_headers")
        .when(at.isNull(), "invalid_timestamp")
        .when(F.abs(now - at) > expiry, "expired")
        .when(~F.coalesce(sign(secret, F.col("timestamp"), F.col("path")) == F.col("signature"), F.lit(False)), "invalid_signature")
    )
    return requests.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), 200).otherwise(401))


def broadcast(events: DataFrame, targets: dict[str, str | None], post: Callable[[str, bytes, dict], tuple[int, str]]) -> DataFrame:
    """(event_id, target, url, ok, status_code, error, response_preview): every event (event_id, body, headers) to every target.

    post(url, body, headers) sends the body as it came and returns the status and the answer's text. A target without
    a URL is reported and not asked; a failing post is an error of its row. As a sink of a stream, call it on each
    micro-batch: stream.writeStream.foreachBatch(lambda batch, _: broadcast(batch, ...).write...).
    """
    names = F.array(*(F.struct(F.lit(n).alias("target"), F.lit(u).cast("string").alias("url")) for n, u in targets.items()))
    rows = events.select("event_id", "body", "headers", F.explode(names).alias("t")).select("event_id", "body", "headers", "t.*")

    def send(url: str | None, body: bytes | None, headers: list | None) -> tuple:
        if not url:
            return "", False, None, "Missing target URL", None
        try:
            status, answer = post(url, bytes(body or b""), dict(headers or []))
        except Exception as error:
            return url, False, None, str(error), None
        ok = 200 <= status < 400
        return url, ok, status, None if ok else (answer[:500] or "Non-2xx"), answer[:1000] or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("url", "body", "headers")]
            sent = list(zip(*map(send, *columns), strict=True)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(sent, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("event_id"), batch.column("target"), *arrays],
                ["event_id", "target", "url", "ok", "status_code", "error", "response_preview"],
            )

    id_type = rows.schema["event_id"].dataType.simpleString()
    return rows.withColumn("body", F.col("body").cast("binary")).mapInArrow(
        run, f"event_id {id_type}, target string, url string, ok boolean, status_code int, error string, response_preview string"
    )


def body_preview(body: Column, limit: int = 8192) -> Column:
    return F.make_valid_utf8(F.substring(body.cast("binary"), 1, limit).cast("string"))
