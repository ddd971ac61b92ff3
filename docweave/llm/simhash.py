"""SimHash near-duplicates: pigeonring candidates, Hamming check, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.components import connected_components
from docweave.session import materialize

#: Two fingerprints link when at most so many of their bits differ.
MAX_BITS = 2
#: (shift, width) of the segments, in ring order: one more than MAX_BITS.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: A segment value that more fingerprints than this share is not paired up; see near_links().
BUCKET = 256
#: Hashes counted at a time, for bounded memory on very long texts.
_CHUNK = 1 << 16

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed integer.

    A bit is 1 if set in over half the XXH64 hashes of the shingles, repeats included. Fewer words than a shingle
    are one shingle; without words (empty, null) the fingerprint is zero.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        stop = min(n, at + _CHUNK)
        first = starts[at:stop].tolist()
        last = ends[min(len(words), shingle) - 1 :][at:stop].tolist()
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """(doc_id, fp) for every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {id_type}, fp long")


def _segment(fp: Column, number: int) -> Column:
    shift, width = SEGMENTS[number % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to connect all that MAX_BITS allow.

    Pigeonring: if all differences add up to at most t over m segments in a ring, some chain of consecutive segments
    has at most l * t / m differences in its first l segments, for every l. With m = t + 1 the chain begins with an
    equal segment, the join key; the cumulative budgets of the longer chains prune a pair before its full check.

    A segment value shared by over BUCKET fingerprints is not paired up, which would grow with its square. Its
    fingerprints go to each other's neighbours instead: two of them differ in at most 2 bits exactly if they share a
    value within 1 bit of both. At most 65 distinct fingerprints meet at one value, so this is linear and exact.
    """
    rings = F.explode(
        F.array(*(F.struct(F.lit(i).alias("ring"), _segment(F.col("fp"), i).alias("key")) for i in range(len(SEGMENTS))))
    )
    keyed = fps.select("fp", rings.alias("s")).select("fp", "s.ring", "s.key")
    sizes = keyed.groupBy("ring", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, ["ring", "key"]), "segments")

    small = shared.where(F.col("n") <= BUCKET).drop("n")
    other = small.select("ring", "key", F.col("fp").alias("fp2"))
    differ = F.col("fp").bitwiseXOR(F.col("fp2"))
    prune = F.lit(False)
    for i in range(len(SEGMENTS)):
        spent, chain = F.lit(0), F.col("ring") == i
        for length in range(2, len(SEGMENTS)):
            spent = spent + F.bit_count(_segment(differ, i + length - 1))
            chain = chain & (spent <= length * MAX_BITS // len(SEGMENTS))
        prune = prune | chain
    pairs = small.join(other, ["ring", "key"]).where(
        (F.col("fp") < F.col("fp2")) & prune & (F.bit_count(differ) <= MAX_BITS)
    )

    crowded = shared.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    near = F.concat(F.array("fp"), F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit)))
    meeting = crowded.select("fp", F.explode(near).alias("value"))
    hub = F.min("fp").over(Window.partitionBy("value"))
    starred = meeting.select("fp", hub.alias("fp2")).where("fp != fp2")
    return pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b")).union(starred).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Fingerprints link at MAX_BITS or fewer differing bits. Null and empty texts have fingerprint zero, linked like
    any other. Rows without an id get their component's id, which is null if none of its rows has one. Repeated rows
    answer alike; an empty table gives an empty result; other columns are not read.

    Links are found between distinct fingerprints only, so copies never multiply; the distinct fingerprints meet
    their documents again in one join, whose hot keys adaptive execution splits.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_links(distinct.select("fp")))
    linked = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "least")
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    of_linked = linked.join(lowest, "root").select(F.col("fp").alias("node"), "lowest")
    answer = distinct.join(of_linked, distinct["fp"] == of_linked["node"], "left").select(
        "fp", F.coalesce("lowest", "least").alias("component_id")
    )
    # Written first, so that both sides of the last join are fresh exchanges, whose hot keys can be split.
    answer = materialize(answer, "answers")
    return rows.join(answer, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
