"""Token counts by compiled finite-state transducers.

Two deterministic transducers in a cascade, both with counts or marks on their transitions:

* The splitter reads classes of characters and marks where pieces begin. It has few states, so a chunk of text is a
  map from states to states. The maps of all chunks are composed by a parallel prefix scan, which gives every chunk
  its start state; then all chunks run at once.
* The merger reads the bytes of a piece and emits on each transition by how many tokens the count changes. Its states
  are made when first reached: what matters of the past is the longest suffix that begins a token, and for each
  position in it the last token of the text up to there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of characters. BREAK separates texts; S.. are letters that can continue an apostrophe.
BREAK, SPACE, WHITE, NUMBER, OTHER, APOSTROPHE, LETTER, S, R, V, L, E = range(12)
_LETTERS = {"s": S, "t": S, "m": S, "d": S, "r": R, "v": V, "l": L, "e": E}
# States of the splitter: at a piece's start, inside a run, after an apostrophe that begins a piece (and r, v or l),
# and after white space: one or several characters, the last of which is a space or not.
START, WORD, DIGITS, MARKS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, ONE_S, ONE_W, MANY_S, MANY_W = range(12)
N = 12
#: Marks on a transition: a piece begins here, or it began one character before.
HERE, BEFORE = 1, 2
#: Characters to a chunk of the scan, and to a batch of texts.
CHUNK, BATCH = 256, 1 << 20
#: Bounds of what a worker remembers: merger states, and the counts of pieces up to so many bytes.
MOST_STATES, MOST_PIECES, PIECE_BYTES = 150_000, 400_000, 64


def _fresh(c: int) -> int:
    """The state after a piece's first character."""
    first = {BREAK: START, SPACE: ONE_S, WHITE: ONE_W, NUMBER: DIGITS, OTHER: MARKS, APOSTROPHE: QUOTE}
    return first.get(c, WORD)


def _step(state: int, c: int) -> tuple[int, int]:
    """The splitter's transition: next state and marks."""
    letter = c >= LETTER
    if c == BREAK:
        late = state in (QUOTE_R, QUOTE_V, QUOTE_L)
        return START, HERE | (BEFORE if late else 0)
    if state == START:
        return _fresh(c), HERE
    if state in (WORD, DIGITS):
        goes_on = letter if state == WORD else c == NUMBER
        return (state, 0) if goes_on else (_fresh(c), HERE)
    if state == MARKS or (state == QUOTE and c in (OTHER, APOSTROPHE)):
        return (MARKS, 0) if c in (OTHER, APOSTROPHE) else (_fresh(c), HERE)
    if state == QUOTE:
        if c == S:
            return START, 0
        return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}.get(c, _fresh(c)), 0 if c in (R, V, L) else HERE
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if c == (L if state == QUOTE_L else E):
            return START, 0
        return (WORD, BEFORE) if letter else (_fresh(c), BEFORE | HERE)
    # After white space: all but its last character is a piece; a last space joins what follows.
    if c in (SPACE, WHITE):
        return MANY_S if c == SPACE else MANY_W, 0
    late = BEFORE if state in (MANY_S, MANY_W) else 0
    if state in (ONE_S, MANY_S):
        return MARKS if c == APOSTROPHE else _fresh(c), late
    return _fresh(c), late | HERE


_TABLE = np.array([_step(s, c) for c in range(12) for s in range(N)], np.int64)
_NEXT, _MARKS = _TABLE[:, 0].astype(np.int8), _TABLE[:, 1].astype(np.int8)


def character_classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    shift = lambda i: i if i < 0xD800 else i + 0x800  # noqa: E731  surrogates are no characters
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            for x, y in ((a, min(b, 0xD800)), (max(a, 0xD800), b)):
                if x < y:
                    out[shift(x) : shift(y - 1) + 1] = c
    out[ord(" ")], out[ord("'")] = SPACE, APOSTROPHE
    for char, c in _LETTERS.items():
        out[ord(char)] = c
    return out


def split_marks(classes: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character, for classes that start and end with a BREAK."""
    n = len(classes)
    k = -(-n // CHUNK)
    grid = np.full(k * CHUNK, BREAK, np.int64)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(k, CHUNK).T) * N  # one row for each position within the chunks

    maps = np.tile(np.arange(N, dtype=np.int64), (k, 1))
    for row in grid:
        maps = _NEXT[row[:, None] + maps].astype(np.int64)
    # Inclusive scan of the composition: after each round a map covers twice as many chunks up to its own.
    reach = 1
    while reach < k:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.concatenate(([START], maps[:-1, START])).astype(np.int64)

    marks = np.empty((CHUNK, k), np.int8)
    for at, row in enumerate(grid):
        key = row + state
        marks[at] = _MARKS[key]
        state = _NEXT[key].astype(np.int64)
    flat = np.ascontiguousarray(marks.T).reshape(-1)[:n]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return begins


class Merger:
    """The transducer of the merges, made state by state and forgotten when it grows too large."""

    def __init__(self, tokens: list[bytes], merges: dict[tuple[bytes, bytes], int]) -> None:
        self.merges = merges
        self.tokens = set(tokens)
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._own: dict[bytes, bool] = {}
        self.pieces: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: the suffix, and for the positions from its begin to its end the last token and the tokens since.
        start = (b"", (None,), (0,))
        self.states = [start]
        self.numbers = {start: 0}
        self.moves: dict[int, int] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The merges applied in order of rank; what transitions are compiled from."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.merges.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _whole(self, token: bytes) -> bool:
        """Whether the merges make this token of its own bytes."""
        found = self._own.get(token)
        if found is None:
            found = self._own[token] = self.merged(token) == [token]
        return found

    def _follows(self, a: bytes, b: bytes) -> bool:
        """Whether the merges leave a and b beside each other as they are."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > 4 * MOST_STATES:
                self._pairs.clear()
            found = self._pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def _move(self, number: int, byte: int) -> int:
        """Compile a transition: next state * 256 + change of the count + 128."""
        suffix, last, count = self.states[number]
        longer = suffix + bytes([byte])
        drop = 0
        while longer[drop:] not in self.prefixes:
            drop += 1
        suffix = longer[drop:]
        for size in range(len(suffix), 0, -1):
            token = suffix[-size:]
            if token not in self.tokens or not self._whole(token):
                continue
            at = len(longer) - size
            if last[at] is None or self._follows(last[at], token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        change = count[at] + 1 - count[-1]
        total = count[at] + 1
        state = (suffix, (*last[drop:], token), tuple(c - total for c in (*count[drop:], total)))
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
        move = self.moves[number << 8 | byte] = to << 8 | (change + 128)
        return move

    def count(self, piece: bytes) -> int:
        """Tokens of a piece: the sum of what the transitions emit."""
        # Counts of pieces do not depend on the states, so each is forgotten for itself.
        if len(self.states) > MOST_STATES:
            self._reset()
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        get, state, total = self.moves.get, 0, 0
        for byte in piece:
            move = get(state << 8 | byte)
            if move is None:
                if len(self.states) > 2 * MOST_STATES:  # within one long piece
                    here = self.states[state]
                    self._reset()
                    state = self.numbers.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                    get = self.moves.get
                move = self._move(state, byte)
            state = move >> 8
            total += (move & 255) - 128
        if len(piece) <= PIECE_BYTES:
            self.pieces[piece] = total
        return total


@dataclass
class Tokenizer:
    """A byte-level BPE vocabulary compiled to transducers."""

    tokens: list[bytes]
    merges: dict[tuple[bytes, bytes], int]
    specials: list[str]

    def __post_init__(self) -> None:
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
        self._classes: np.ndarray | None = None
        self._merger: Merger | None = None

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "merges": self.merges, "specials": self.specials}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. A special string within a text is one token and ends what stands before it."""
        if self._merger is None:
            self._merger, self._classes = Merger(self.tokens, self.merges), character_classes()
        extra, joined, breaks, at = [], [], [0], 1
        for text in texts:
            parts = self._special.split(text) if self.specials else [text]
            extra.append(len(parts) - 1)
            for part in parts:
                joined.append(part)
                at += len(part) + 1
                breaks.append(at - 1)
        data = "\0" + "\0".join(joined) + "\0"
        points = np.frombuffer(data.encode("utf-32-le"), "<u4")
        classes = self._classes[points]
        classes[breaks] = BREAK
        begins = np.flatnonzero(split_marks(classes))
        width = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        offset = np.cumsum(width) - width
        raw = data.encode()
        edges = offset[begins].tolist()
        pieces = [raw[a:b] for a, b in zip(edges, [*edges[1:], len(raw)], strict=True)]
        known, count = self._merger.pieces.get, self._merger.count
        found = np.array([n if (n := known(p)) is not None else count(p) for p in pieces], np.int64)
        found[classes[begins] == BREAK] = 0
        # Texts begin at their first break; those with specials take several.
        sums = np.add.reduceat(found, np.searchsorted(begins, np.array(breaks[:-1])))
        first = np.concatenate(([0], np.cumsum(np.array(extra) + 1)[:-1]))
        return (np.add.reduceat(sums, first) + np.array(extra)).tolist()


def load_tokenizer(path: str) -> Tokenizer:
    """Compile a byte-level BPE file of the tokenizers library. Other models and splitters are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    level = pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
    added = spec["added_tokens"]
    odd = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    if model["type"] != "BPE" or not plain or not level or spec["normalizer"] or model.get("ignore_merges") or odd:
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    # The files write bytes as printable characters: themselves where printable, else from U+0100 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}
    as_bytes = lambda token: bytes(byte[c] for c in token)
    specials = [t["content"] for t in added]
    tokens = [as_bytes(t) for t in model["vocab"] if t not in specials]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Tokenizer(tokens, {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}, specials)


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary is the path of a byte-level BPE file, read on the driver and broadcast. Null texts count as empty,
    which is 0 tokens. Repeated rows answer alike; an empty table gives an empty result; other columns are not read.
    No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_tokenizer(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value.counts
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            at, sizes, found = 0, [], []
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and size < BATCH:
                    size += len(texts[stop]) + 1
                    stop += 1
                found += counts(texts[at:stop])
                at = stop
            sizes = [len(t.encode()) for t in texts]
            arrays = [pa.array(sizes, pa.int64()), pa.array(found, pa.int64())]
            arrays.append(pa.array([n > limit for n in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
