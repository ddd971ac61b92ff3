"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.automaton import SuffixAutomaton

#: Bytes of words after lower-casing: digits, a-z and all of multi-byte characters; others separate words.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int32()))]


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text after lower-casing A-Z; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


class Benchmark:
    """The test items as an automaton that finds their windows in a stream of words.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = 10) -> None:
        self.window = window
        self.words: dict[bytes, int] = {}
        sequences = []
        for item_id, text in items:
            numbers = [self.words.setdefault(w, len(self.words)) for w in words_of(text)]
            if numbers:
                sequences.append((item_id, numbers))
        self.sam = SuffixAutomaton(len(self.words))
        for _, numbers in sequences:
            self.sam.add(numbers)
        self.sam.seal()
        self.shortest = min((min(len(n), window) for _, n in sequences), default=window)
        #: Items whose windows are among a state's factors, by state and factor length.
        self.ends: dict[int, dict[int, set[str]]] = {}
        for item_id, numbers in sequences:
            size = min(len(numbers), window)
            for i in range(len(numbers) - size + 1):
                state = self.sam.state_of(numbers[i : i + size])
                self.ends.setdefault(state, {}).setdefault(size, set()).add(item_id)
        self._seen: dict[int, tuple[list[int], list[set[str]]]] = {}

    def _windows_at(self, state: int) -> tuple[list[int], list[set[str]]]:
        """Lengths of windows that are suffixes of a state's factors, ascending, with their items."""
        found = self._seen.get(state)
        if found is None:
            by_size: dict[int, set[str]] = {}
            at = state
            while at > 0:
                for size, ids in self.ends.get(at, {}).items():
                    by_size.setdefault(size, set()).update(ids)
                at = self.sam.link[at]
            sizes = sorted(by_size)
            found = self._seen[state] = sizes, [by_size[s] for s in sizes]
        return found

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans (start, end) of words inside any occurrence of a window, and the items that occur.

        A word of no item resets the automaton, so a run of known words shorter than the shortest window is passed
        over unread.
        """
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if len(words) < self.shortest or not self.words:
            return spans, items
        get = self.words.get
        numbers = np.array(list(map(get, words, repeat(-1))), dtype=np.int64)
        unknown = np.flatnonzero(numbers < 0)
        starts = np.concatenate(([0], unknown + 1))
        stops = np.concatenate((unknown, [len(words)]))
        long = stops - starts >= self.shortest
        step, width = self.sam.next, self.sam.n_words
        link, length = self.sam.link, self.sam.length
        for start, stop in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            state = matched = 0
            for at, word in enumerate(numbers[start:stop].tolist(), start + 1):
                to = step.get(state * width + word)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = step.get(state * width + word)
                if to is None:
                    continue
                state = to
                matched += 1
                if matched < self.shortest:
                    continue
                sizes, ids = self._windows_at(state)
                n = bisect_right(sizes, matched)
                if n:
                    for x in ids[:n]:
                        items |= x
                    begin = at - sizes[n - 1]
                    while spans and begin <= spans[-1][0]:
                        spans.pop()
                    if spans and begin <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], at)
                    else:
                        spans.append((begin, at))
        return spans, items


def _items(benchmark: DataFrame, id_col: str, text_col: str, most_bytes: int) -> list[tuple[str, str | None]]:
    """The test items on the driver. The test set is small by nature; its size is checked, not assumed."""
    items, size = [], 0
    for row in benchmark.select(benchmark[id_col].cast("string"), text_col).toLocalIterator():
        if row[0] is not None:
            size += len(row[1] or "") + 16
            if size > most_bytes:
                raise ValueError(f"the test items exceed {most_bytes} bytes; raise most_bytes or run them in parts")
            items.append((row[0], row[1]))
    return sorted(items, key=lambda x: (x[0], x[1] or ""))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    most_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Document words stream through the automaton, which tracks the longest factor of any item that ends at each word.
    spans are pairs [start, end) of word positions inside occurrences of windows. items_sha256 is over the ids of
    items with occurring windows, sorted as strings, comma-joined. Null texts have no words; null items and items
    without an id are no items; items that share an id count once. Without items nothing is contaminated. Repeated
    rows answer alike; an empty table gives an empty result; other columns are not read. No shuffle.
    """
    shared = _broadcast(docs, benchmark, window, item_id_col, item_text_col, most_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                spans, items = model.match(words)
                digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
                hit = sum(b - a for a, b in spans)
                rows.append((len(words), hit, len(items), digest, hit > 0, spans))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *_NAMES])

    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        scan,
        f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "spans array<array<int>>",
    )


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    max_coverage: float = 0.5,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    most_bytes: int = 64 << 20,
) -> DataFrame:
    """docs without test passages: rows with over max_coverage of their words hit go, others lose the spans hit.

    A span is cut from its first word's first to its last word's last character. Every column stays; only the text of
    rows with hits changes. At max_coverage 0 every row with a hit goes. Nulls, empty texts, repeats and empty tables
    are handled as find_contamination() says.
    """
    shared = _broadcast(docs, benchmark, window, item_id_col, item_text_col, most_bytes)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            keep, texts = [], []
            for value in batch.column(at):
                text = value.as_py()
                words = words_of(text)
                spans, _ = model.match(words)
                hit = sum(b - a for a, b in spans)
                keep.append(not hit or hit <= max_coverage * len(words))
                texts.append(cut_words(text, spans) if hit and keep[-1] else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters of the words in spans and what lies between them."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_BYTES))]
    kept, end = [], 0
    for first, stop in spans:
        kept.append(data[end : places[first][0]])
        end = places[stop - 1][1]
    return b"".join([*kept, data[end:]]).decode("utf-8", "surrogatepass")


def _broadcast(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, most_bytes: int):
    return docs.sparkSession.sparkContext.broadcast(Benchmark(_items(benchmark, id_col, text_col, most_bytes), window))
