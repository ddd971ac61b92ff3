"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, trained from document labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import crc_mod
from docweave.llm.decontaminate import words_of

_SENTENCE = re.compile(r"[^.!?\n]+")
#: Word beginnings that count as features besides the word itself, in bytes.
_PREFIXES = (4, 5, 6)
#: Words whose weights a worker remembers, and bytes of the longest of them.
_CACHE, _CACHED_BYTES = 100_000, 64


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit. The sample is the only part that does not see all rows."""

    rows_per_class: int = 6000
    sample_bytes: int = 64 << 20
    least_documents: int = 3
    least_log_odds: float = 2.5
    features: int = 4000
    leak: float = -11.0
    """Log-odds of a sentence without any feature: keeps long clean documents clean under the noisy-or."""
    steps: int = 300
    rate: float = 0.15
    decay: float = 2e-4


def features_of(word: bytes) -> list[bytes]:
    return [word + b"$", *(word[:n] for n in _PREFIXES if len(word) >= n)]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class ToxicityModel:
    """Feature weights; a sentence's log-odds are the leak plus the weights of its distinct words."""

    weights: dict[bytes, float]
    leak: float
    _known: dict[bytes, float] = field(default_factory=dict)

    def weight(self, word: bytes) -> float:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= _CACHE:
                self._known.clear()
            found = sum(self.weights.get(f, 0.0) for f in features_of(word))
            if len(word) <= _CACHED_BYTES:
                self._known[word] = found
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or over the sentences, and the sentences (start, end, probability) with a probability over 0.5."""
        if not text:
            return 0.0, []
        weight = self.weight
        sentences = [m.span() for m in _SENTENCE.finditer(text)]
        none = float(np.logaddexp(0.0, self.leak))
        if not any(map(weight, set(words_of(text.lower())))):
            return -math.expm1(-none * len(sentences)), []
        total, places = 0.0, []
        for start, end in sentences:
            z = self.leak + sum(map(weight, set(words_of(text[start:end].lower()))))
            total += float(np.logaddexp(0.0, z))
            if z > 0:
                places.append((start, end, 1 / (1 + math.exp(-z))))
        return -math.expm1(-total), places

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "leak": self.leak, "_known": {}}


def fit_noisy_or(rows: list[tuple[str | None, int]], share: float, settings: Training = Training()) -> ToxicityModel:
    """Fit on (text, label) rows; share is the part of label 1 in the data the rows were drawn from.

    Features are those that occur in enough documents of label 1, far more often than in label 0, and more often than
    chance gives to any of so many features (a Chernoff bound over all that were looked at). Their weights
    start at their log-odds and follow the gradient of the noisy-or's document likelihood (Adam, fixed steps).
    Without rows of both labels the model has no features and scores every text near 0.
    """
    toxic, clean = Counter(), Counter()
    n = [0, 0]
    per_doc = []
    for text, label in sorted(rows, key=lambda r: (-r[1], r[0] or "")):
        low = (text or "").lower()
        found = {f for w in set(words_of(low)) for f in features_of(w)}
        n[label] += 1
        if label:
            toxic.update(found)
        else:
            clean.update(f for f in found if f in toxic)
        per_doc.append((text or "", label))
    if not n[0] or not n[1]:
        return ToxicityModel({}, settings.leak)
    odds = {
        f: math.log((c + 0.5) / (n[1] + 1)) - math.log((clean[f] + 0.5) / (n[0] + 1))
        for f, c in toxic.items()
        if c >= settings.least_documents
    }
    part = n[1] / sum(n)
    needed = math.log(max(1, len(odds))) + 2

    def evidence(f: bytes) -> float:
        total = toxic[f] + clean[f]
        x = toxic[f] / total
        rest = (1 - x) * math.log((1 - x) / (1 - part)) if x < 1 else 0.0
        return total * (x * math.log(x / part) + rest)

    chosen = sorted(
        (f for f, o in odds.items() if o >= settings.least_log_odds and evidence(f) >= needed),
        key=lambda f: (-odds[f] * toxic[f], f),
    )
    index = {f: i for i, f in enumerate(chosen[: settings.features])}
    if not index:
        return ToxicityModel({}, settings.leak)

    doc_of, entries_s, entries_f, counts = [], [], [], []
    labels, empty = [], []
    for d, (text, label) in enumerate(per_doc):
        bare = 0
        for m in _SENTENCE.finditer(text):
            hit = Counter(index[f] for w in set(words_of(m.group().lower())) for f in features_of(w) if f in index)
            if hit:
                entries_s += [len(doc_of)] * len(hit)
                entries_f += hit.keys()
                counts += hit.values()
                doc_of.append(d)
            else:
                bare += 1
        labels.append(label)
        empty.append(bare)
    s, f = np.array(entries_s), np.array(entries_f)
    x, doc = np.array(counts, float), np.array(doc_of)
    y, bare = np.array(labels), np.array(empty, float)
    # Each class counts as much as in the data the sample was drawn from.
    importance = np.where(y == 1, share / n[1], (1 - share) / n[0])
    none = np.logaddexp(0.0, settings.leak)
    w = np.array([odds[k] for k in index])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, settings.steps + 1):
        z = settings.leak + np.bincount(s, w[f] * x, minlength=len(doc))
        total = np.bincount(doc, softplus(z), minlength=len(y)) + bare * none
        pull = np.where(y == 1, -1.0 / np.expm1(np.clip(total, 1e-9, 600)), 1.0) * importance
        slope = pull[doc] / (1 + np.exp(-z))
        gradient = np.bincount(f, slope[s] * x, minlength=len(w)) + settings.decay * w / len(w)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w = w - settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return ToxicityModel({k: float(v) for k, v in zip(index, w, strict=True)}, settings.leak)


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column | None = None,
    settings: Training = Training(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Fit a model on a bounded sample of the labelled rows that satisfy learn_from (a condition on doc_id).

    Class shares are counted over all of them; the sample holds the first rows_per_class ids of each class in md5
    order, and of these the first whose whole texts fit half of sample_bytes together. Labels other than 0 and 1 and rows without an id are left out;
    ids labelled twice count as toxic if any label says so.
    """
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    if learn_from is not None:
        known = known.where(learn_from)
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.md5(F.col("doc_id").cast("string"))
    picked = [known.where(F.col("label") == y).orderBy(order, "doc_id").limit(settings.rows_per_class) for y in (0, 1)]
    ids = picked[0].union(picked[1])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # At most 2 * rows_per_class ids: a proven bound for the broadcast.
    found = texts.join(F.broadcast(ids), "doc_id")
    ahead = Window.partitionBy("label").orderBy(order, "doc_id", F.md5(F.coalesce("text", F.lit(""))))
    used = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    sample = found.withColumn("_used", used).where(F.col("_used") <= settings.sample_bytes // 2)
    rows = [(row[0], row[1]) for row in sample.select("text", "label").toLocalIterator()]
    return fit_noisy_or(rows, size.get(1, 0) / max(1, sum(size.values())), settings)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, sentences (start, end, score of offending ones, in code points).

    Null and empty texts score 0. Repeated rows answer alike; an empty table gives an empty result; other columns
    are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column(1)]
            places = [[{"start": a, "end": b, "score": p} for a, b, p in x[1]] for x in found]
            arrays = [batch.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array(places, place)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "sentences"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run, f"doc_id {id_type}, score double, sentences array<struct<start:int,end:int,score:double>>"
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under threshold, with all their columns. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([score(t.as_py())[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending: trained on labelled rows outside the held-out fold.

    The fold of a row is crc32(doc_id as text) mod folds; rows without an id are not held out.
    """
    fold = crc_mod(F.col("doc_id"), folds)
    model = train_toxicity(docs, labels, fold != held)
    return score_toxicity(docs, model).select(
        "doc_id",
        F.coalesce(fold == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("sentences").alias("n_offending"),
    )
