"""Interpolated modified Kneser-Ney model of order 2, counted in Spark, kept as memory-mapped sorted hash arrays."""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import crc_mod
from docweave.session import materialize, shared_dir

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: The end of a text, a token; and its start, only ever a context. Seeds apart from the words' own.
END = xxhash.xxh64_intdigest(b"end", 1)
START = xxhash.xxh64_intdigest(b"start", 2)
#: Word hashes inside pairs are cut to 40 bits; a pair's own hash too, beside 24 bits of its count.
_BITS = 40
_MASK = np.uint64((1 << _BITS) - 1)
_COUNT = np.uint64((1 << 24) - 1)
_EXACT = 1 << 23
#: Tokens gathered before a task counts what it has, and tokens scored at a time.
_GATHER, _SCORE = 2_500_000, 600_000
#: Words whose hashes a worker remembers.
_CACHE = 200_000
#: A context with over 1 / HOT of all tokens is spread over all buckets; there are fewer than HOT of them.
HOT = 1000


class Hasher:
    """64-bit hashes of the tokens of texts: lower-cased words, then the end."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> list[int]:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        known = self.known
        try:
            found = [known[w] for w in words]
        except KeyError:
            if len(known) > _CACHE:
                known.clear()
            found = []
            for w in words:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w)
                found.append(h)
        found.append(END)
        return found


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """40-bit hashes of (context, word), both 40-bit."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x & _MASK


def bucket_of(context: np.ndarray, pair: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """A pair's bucket: its context's, or its own for a hot context."""
    by_context = context % np.uint64(buckets)
    return np.where(np.isin(context, hot), pair % np.uint64(buckets), by_context).astype(np.int64)


def _pack40(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def _pack(*columns: bytes) -> bytes:
    return struct.pack(f"<{len(columns)}q", *map(len, columns)) + b"".join(columns)


def _unpack(data: bytes, n: int) -> list[bytes]:
    at, out = 8 * n, []
    for size in struct.unpack_from(f"<{n}q", data):
        out.append(data[at : at + size])
        at += size
    return out


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes; those over 254 follow in full. Most are 1, so the shuffle's compression removes them."""
    big = counts > 254
    return np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype("<i8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[n:], "<i8")
    return counts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _split(buckets: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows by bucket, in the columns' order within each."""
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    for b in range(n):
        if edges[b] < edges[b + 1]:
            yield b, *(c[edges[b] : edges[b + 1]] for c in columns)


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Token hashes, a start before each text, in pieces of about _GATHER."""
    hasher, parts, size = Hasher(), [], 0
    for batch in batches:
        for text in batch.column(0):
            parts.append(np.array([START, *hasher(text.as_py())], np.uint64))
            size += len(parts[-1])
            if size >= _GATHER:
                yield np.concatenate(parts)
                parts, size = [], 0
    if parts:
        yield np.concatenate(parts)


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"]
    )


def _store(path: str, data: bytes) -> None:
    """Write a file whole or not at all, so that a task may run twice."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def discounts(n: Iterable[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of entries with counts 1 to 4; plain ones where those fail."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        if all(0 < x < k for k, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts after their discounts; 0 stays 0."""
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)], 0.0)


def _count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _coded(counts: np.ndarray) -> np.ndarray:
    """Counts in 24 bits: exact below 2**23, above on a logarithmic scale."""
    over = _EXACT + np.round(np.log2(np.maximum(counts, _EXACT) / _EXACT) * (1 << 17))
    return np.where(counts < _EXACT, counts, np.minimum(over, int(_COUNT))).astype(np.uint64)


def _decoded(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.int64)
    return np.where(codes < _EXACT, codes, _EXACT * np.exp2((codes - _EXACT) / (1 << 17))).astype(np.float64)


#: Columns of a word file, one after the other: each sorted by the first, so that a lookup touches few pages.
_WORD = {"key": "<u8", "count": "<i8", "before": "<i4", "gamma": "<f4"}
_WORD_BYTES = 24


@dataclass
class NgramModel:
    """A model in a shared folder: words-<bucket> and pairs-<bucket>, opened by memory mapping when first asked."""

    folder: str
    buckets: int
    hot: np.ndarray
    tokens: int
    types: int
    pairs: int
    discount: tuple[float, float, float]
    low_discount: tuple[float, float, float]
    low_gamma: float
    start: tuple[int, float]

    def __post_init__(self) -> None:
        self._open: dict[str, np.ndarray] = {}
        self.hasher = Hasher()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_open", "hasher")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _file(self, name: str) -> np.ndarray:
        if name not in self._open:
            path = f"{self.folder}/{name}"
            there = os.path.exists(path) and os.path.getsize(path)
            self._open[name] = np.memmap(path, np.uint8, "r") if there else np.zeros(0, np.uint8)
        return self._open[name]

    def _columns(self, bucket: int) -> list[np.ndarray]:
        data, at, out = self._file(f"words-{bucket:06d}"), 0, []
        n = len(data) // _WORD_BYTES
        for kind in _WORD.values():
            size = n * np.dtype(kind).itemsize
            out.append(data[at : at + size].view(kind))
            at += size
        return out

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, numbers of distinct contexts and back-off weights of distinct word hashes."""
        out = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.ones(len(keys))
        at = np.arange(len(keys))
        place = ((keys & _MASK) % np.uint64(self.buckets)).astype(np.int64)
        for b, places, wanted in _split(place, self.buckets, at, keys):
            key, *columns = self._columns(b)
            if len(key):
                found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                same = key[found] == wanted
                for values, column in zip(out, columns, strict=True):
                    values[places[same]] = column[found[same]]
        return out

    def pair_counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Counts of (context, word), given as 40-bit hashes."""
        pair = pair_hash(context, word)
        out = np.zeros(len(pair))
        at = np.arange(len(pair))
        buckets = bucket_of(context, pair, self.hot, self.buckets)
        order = np.argsort(pair)
        for b, places, wanted in _split(buckets[order], self.buckets, at[order], pair[order]):
            table = self._file(f"pairs-{b:06d}").view("<u8")
            if len(table):
                found = np.minimum(np.searchsorted(table, wanted << np.uint64(24)), len(table) - 1)
                entry = table[found]
                same = entry >> np.uint64(24) == wanted
                out[places[same]] = _decoded(entry[same] & _COUNT)
        return out

    def score(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text: tokens, known tokens, add-one unigram log10 probability, the model's log10 probability."""
        hashed = [self.hasher(t) for t in texts]
        sizes = np.array([len(h) for h in hashed])
        tokens = np.array([x for h in hashed for x in h], np.uint64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        keys, back = np.unique(tokens, return_inverse=True)
        count, before, gamma = self.words(keys)
        low = self.low_gamma / (self.types + 1) + _less(before, self.low_discount) / max(1, self.pairs)
        base = np.log10((count + 1.0) / (self.tokens + (self.types + 1)))
        context = np.concatenate(([np.uint64(START)], tokens[:-1]))
        seen = np.concatenate(([0], count[back][:-1])).astype(np.float64)
        weight = np.concatenate(([1.0], gamma[back][:-1]))
        context[starts] = START
        seen[starts], weight[starts] = self.start
        own = _less(self.pair_counts(context & _MASK, tokens & _MASK), self.discount)
        p = np.where(seen > 0, own / np.maximum(seen, 1.0) + weight * low[back], low[back])
        total = lambda values: np.add.reduceat(values, starts)
        return [sizes, total((count[back] > 0).astype(np.int64)), total(base[back]), total(np.log10(p))]


def train_ngram_model(docs: DataFrame, text_col: str = "text", buckets: int | None = None) -> NgramModel:
    """Count all rows of docs and leave the model in the shared folder.

    Tokens are words between white space, A-Z lower-cased, then one end; a null text is an empty one. Repeated rows
    count each time. An empty table gives a model that knows nothing.

    All tables are packed arrays, one row per task and bucket in a shuffle, which are merged bucket by bucket. There
    are as many buckets as shuffle partitions unless given.
    1. Token counts give the totals and the hot contexts, fewer than HOT.
    2. Pairs go to their context's bucket, pairs of hot contexts to a bucket of their own, so no bucket grows with
       one word. The merged bucket is a file of the model: 40-bit hashes, sorted, each with its count.
    3. Numbers of distinct contexts before a word, and back-off weights after it, join its count in a second file.
    The folder must be one that workers can map, so spark.checkpoint.dir has to be a mounted path (file:).
    """
    spark = docs.sparkSession
    root = shared_dir(spark)
    if "://" in root and not root.startswith("file:"):
        raise ValueError(f"workers memory-map the model, so {root} must be a mounted folder")
    folder = f"{root.removeprefix('file://').removeprefix('file:')}/docweave/ngrams-{uuid.uuid4().hex}"
    n_buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(text_col).alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in _gathered(batches):
            keys, counts = np.unique(tokens, return_counts=True)
            place = ((keys & _MASK) % np.uint64(n_buckets)).astype(np.int64)
            yield _rows(
                [(b, _pack(k.astype("<u8").tobytes(), _small(c))) for b, k, c in _split(place, n_buckets, keys, counts)]
            )

    def merge_words(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for data in table.column("data"):
            k, c = _unpack(data.as_py(), 2)
            keys.append(np.frombuffer(k, "<u8").astype(np.uint64))
            counts.append(_wide(c, len(keys[-1])))
        key, count = _summed(np.concatenate(keys), np.concatenate(counts))
        word = key != np.uint64(START)
        top = np.argsort(-count)[:HOT]
        return pa.table(
            {
                "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
                "data": pa.array([_pack(key.astype("<u8").tobytes(), _small(count))], pa.binary()),
                "tokens": pa.array([int(count[word].sum())], pa.int64()),
                "types": pa.array([int(word.sum())], pa.int64()),
                "starts": pa.array([int(count[~word].sum())], pa.int64()),
                "top": pa.array([[{"key": int(k), "n": int(n)} for k, n in zip((key & _MASK)[top], count[top], strict=True)]],
                                pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))),
            }
        )

    word_rows = materialize(
        texts.mapInArrow(count_words, "bucket int, data binary")
        .groupBy("bucket")
        .applyInArrow(
            merge_words,
            "bucket int, data binary, tokens long, types long, starts long, top array<struct<key:long,n:long>>",
        ),
        "words",
    )
    tokens, types, starts = (x or 0 for x in word_rows.agg(F.sum("tokens"), F.sum("types"), F.sum("starts")).first())
    least = (tokens + starts) // HOT + 1
    hot_rows = word_rows.select(F.explode("top").alias("w")).where(F.col("w.n") >= least).select("w.key").collect()
    hot = np.array(sorted(r[0] for r in hot_rows), np.uint64)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in _gathered(batches):
            own = stream[1:] != np.uint64(START)  # what comes before a start belongs to another text
            context, word = (stream[:-1] & _MASK)[own], (stream[1:] & _MASK)[own]
            pair = pair_hash(context, word)
            order = np.argsort(pair, kind="stable")
            sorted_ = pair[order]
            first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
            counts = np.diff(np.concatenate((first, [len(sorted_)])))
            context, word, pair = context[order[first]], word[order[first]], sorted_[first]
            place = bucket_of(context, pair, hot, n_buckets)
            order = np.lexsort((context, place))
            rows = []
            for b, u, w, n in _split(place[order], n_buckets, context[order], word[order], counts[order]):
                edge = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
                runs = np.diff(np.concatenate((edge, [len(u)])))
                rows.append((b, _pack(_pack40(u[edge]), _small(runs), _pack40(w), _small(n))))
            yield _rows(rows)

    def merge_pairs(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        contexts, words, counts = [], [], []
        for data in table.column("data"):
            u, r, w, n = _unpack(data.as_py(), 4)
            u, w = _unpack40(u), _unpack40(w)
            contexts.append(np.repeat(u, _wide(r, len(u))))
            words.append(w)
            counts.append(_wide(n, len(w)))
        context, word, count = (np.concatenate(x) for x in (contexts, words, counts))
        pair = pair_hash(context, word)
        order = np.argsort(pair, kind="stable")
        context, word, pair, count = context[order], word[order], pair[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        count = np.add.reduceat(count, first)
        context, word, pair = context[first], word[first], pair[first]
        _store(f"{folder}/pairs-{bucket:06d}", ((pair << np.uint64(24)) | _coded(count)).astype("<u8").tobytes())
        out = []
        # Of each context: continuations seen once, twice, and more often.
        order = np.argsort(context, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], context[order][1:] != context[order][:-1])))
        classes = [np.add.reduceat((count[order] == k).astype(np.int64), edge) for k in (1, 2)]
        classes.append(np.add.reduceat((count[order] > 2).astype(np.int64), edge))
        u = context[order][edge]
        place = (u % np.uint64(n_buckets)).astype(np.int64)
        for b, key, n1, n2, n3 in _split(place, n_buckets, u, *classes):
            out.append((b, "after", _pack(_pack40(key), _small(n1), _small(n2), _small(n3))))
        w, n = np.unique(word, return_counts=True)
        for b, key, c in _split((w % np.uint64(n_buckets)).astype(np.int64), n_buckets, w, n):
            out.append((b, "before", _pack(_pack40(key), _small(c))))
        out.append((-1, "sums", json.dumps([len(pair), *_count_of_counts(count)]).encode()))
        return pa.table(
            {
                "bucket": pa.array([x[0] for x in out], pa.int32()),
                "kind": pa.array([x[1] for x in out], pa.string()),
                "data": pa.array([x[2] for x in out], pa.binary()),
            }
        )

    parts = materialize(
        texts.mapInArrow(count_pairs, "bucket int, data binary")
        .groupBy("bucket")
        .applyInArrow(merge_pairs, "bucket int, kind string, data binary"),
        "pairs",
    )
    sums = np.zeros(5, np.int64)
    for row in parts.where("kind = 'sums'").select("data").toLocalIterator():  # five numbers a bucket
        sums += np.array(json.loads(bytes(row[0])))
    pairs = int(sums[0])
    discount = discounts(map(int, sums[1:]))
    start_key = START

    def merge_all(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        after: dict[str, list] = {"key": [], "n1": [], "n2": [], "n3": []}
        before_keys, before_counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for kind, data in zip(table.column("kind"), table.column("data"), strict=True):
            kind, data = kind.as_py(), data.as_py()
            if kind == "count":
                k, c = _unpack(data, 2)
                keys = np.frombuffer(k, "<u8").astype(np.uint64)
                counts = _wide(c, len(keys))
            elif kind == "before":
                k, c = _unpack(data, 2)
                before_keys.append(_unpack40(k))
                before_counts.append(_wide(c, len(before_keys[-1])))
            else:
                k, *classes = _unpack(data, 4)
                after["key"].append(_unpack40(k))
                for name, c in zip(("n1", "n2", "n3"), classes, strict=True):
                    after[name].append(_wide(c, len(after["key"][-1])))
        cut = keys & _MASK
        before, gamma = np.zeros(len(keys), np.int32), np.ones(len(keys), np.float32)
        b_key, b_count = _summed(np.concatenate(before_keys), np.concatenate(before_counts))
        if len(b_key):
            at = np.minimum(np.searchsorted(b_key, cut), len(b_key) - 1)
            before = np.where(b_key[at] == cut, b_count[at], 0).astype(np.int32)
        if after["key"]:
            key = np.concatenate(after["key"])
            mass = sum(d * np.concatenate(after[n]) for d, n in zip(discount, ("n1", "n2", "n3"), strict=True))
            a_key, a_mass = _summed(key, mass)
            at = np.minimum(np.searchsorted(a_key, cut), len(a_key) - 1)
            gamma = np.where(a_key[at] == cut, a_mass[at] / np.maximum(counts, 1), 1.0).astype(np.float32)
        word = keys != np.uint64(start_key)
        start = [int(counts[~word][0]), float(gamma[~word][0])] if not word.all() else None
        columns = (keys[word], counts[word], before[word], gamma[word])
        _store(
            f"{folder}/words-{bucket:06d}",
            b"".join(c.astype(kind).tobytes() for c, kind in zip(columns, _WORD.values(), strict=True)),
        )
        before = before[word]
        facts = {
            "n": _count_of_counts(before),
            "more": int((before > 2).sum()),
            "start": start,
        }
        return pa.table({"facts": pa.array([json.dumps(facts)], pa.string())})

    every = word_rows.select("bucket", F.lit("count").alias("kind"), "data").unionByName(parts.where("bucket >= 0"))
    facts = materialize(every.groupBy("bucket").applyInArrow(merge_all, "facts string"), "facts")
    n, more, start = np.zeros(4, np.int64), 0, (0, 1.0)
    for row in facts.toLocalIterator():  # one short line a bucket
        found = json.loads(row[0])
        n += np.array(found["n"])
        more += found["more"]
        start = tuple(found["start"]) if found["start"] else start
    low = discounts(map(int, n))
    low_mass = low[0] * int(n[0]) + low[1] * int(n[1]) + low[2] * more
    gamma = low_mass / pairs if pairs else 1.0
    return NgramModel(folder, n_buckets, hot, tokens, types, pairs, discount, low, gamma, start)


def score_ngrams(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, base_score, score (log10 probabilities). No shuffle.

    Null texts count as empty: their only token is the end. Repeated rows answer alike; an empty table gives an
    empty result; other columns are not read. perplexity = 10 ** (-score / n_tokens).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and size < 6 * _SCORE:
                    size += len(texts[stop] or "") + 1
                    stop += 1
                columns = own.score(texts[at:stop])
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, stop - at), *arrays],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )
                at = stop

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of a model of the rows not held out.

    The fold of a row is crc32(doc_id as text) mod folds; rows without an id are not held out.
    """
    is_held: Column = F.coalesce(crc_mod(F.col(id_col), folds) == held, F.lit(False))
    model = train_ngram_model(docs.where(~is_held), text_col)
    return score_ngrams(docs, model, id_col, text_col).select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
