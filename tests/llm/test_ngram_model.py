import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docweave.llm import ngram_model as M


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


class Brute:
    """The textbook model with exact keys."""

    def __init__(self, texts):
        self.c, self.uni, self.ctx = Counter(), Counter(), Counter()
        for t in texts:
            ws = ["<start>", *tokens(t)]
            for u, w in zip(ws, ws[1:], strict=False):
                self.c[u, w] += 1
                self.uni[w] += 1
                self.ctx[u] += 1
        self.before = Counter(w for _, w in self.c)
        self.after = defaultdict(Counter)
        for (u, _), n in self.c.items():
            self.after[u][min(n, 3)] += 1
        of = lambda counts: M.discounts([sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)])
        self.d, self.low = of(self.c), of(self.before)
        self.N, self.V = sum(self.uni.values()), len(self.uni)
        mass = sum(self.low[min(n, 3) - 1] for n in self.before.values())
        self.low_gamma = mass / len(self.c) if self.c else 1.0

    def p(self, u, w):
        b = self.before[w]
        low = (max(b - self.low[min(b, 3) - 1], 0) / len(self.c) if b else 0) + self.low_gamma / (self.V + 1)
        if not self.ctx[u]:
            return low
        n = self.c[u, w]
        own = max(n - self.d[min(n, 3) - 1], 0) if n else 0
        gamma = sum(self.d[k - 1] * m for k, m in self.after[u].items()) / self.ctx[u]
        return own / self.ctx[u] + gamma * low

    def score(self, text):
        ws = tokens(text)
        return (
            len(ws),
            sum(self.uni[w] > 0 for w in ws),
            sum(math.log10((self.uni[w] + 1) / (self.N + self.V + 1)) for w in ws),
            sum(math.log10(self.p(u, w)) for u, w in zip(["<start>", *ws], ws, strict=False)),
        )


def test_scores_match_the_textbook(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(7001, None), (7002, ""), (7003, "The the\tTHE"), (None, "x y")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int").repartition(5)
    for hot in (1000, 5):  # with few, most frequent contexts are spread
        monkeypatch.setattr(M, "HOT", hot)
        got = {r.doc_id: r for r in M.lm_scores(frame).collect()}
        held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
        brute = Brute([t for i, t in rows if not held[i]])
        for i, text in rows:
            n, known, base, score = brute.score(text)
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, brute.N)
            assert r.base_score == pytest.approx(base, rel=1e-9)
            assert r.score == pytest.approx(score, rel=1e-5)
    some = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in some) > sum(r.base_score for r in some)


def test_probabilities_add_up(spark):
    texts = ["a b a c", "b a b", "a a a b c", "c"]
    model = M.train_ngram_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    for context in ("a", "b", "nowhere"):
        total = 0.0
        for w in ("a", "b", "c", "unknown"):
            both, one = (model.score([t])[3][0] for t in (f"{context} {w}", context))
            # log P(context w end) - log P(context end), with the last steps taken out again
            total += 10 ** (both - _end(model, w) - (one - _end(model, context)))
        total += 10 ** _end(model, context)
        assert total == pytest.approx(1.0, rel=1e-4)


def _end(model, word):
    """log10 P(end | word)."""
    key = np.array([M.Hasher()(word)[0]], np.uint64)
    end = np.array([M.END], np.uint64)
    (count,), _, (gamma,) = model.words(key)
    before = model.words(end)[1]
    low = model.low_gamma / (model.types + 1) + M._less(before, model.low_discount)[0] / model.pairs
    own = M._less(model.pair_counts(key & M._MASK, end & M._MASK), model.discount)[0]
    return math.log10(own / count + gamma * low if count else low)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.lm_scores(empty).collect() == []
    model = M.train_ngram_model(empty)
    assert model.tokens == 0 and model.score(["a b"])[3][0] == 0


def test_counts_survive_packing():
    counts = np.array([1, 254, 255, 256, 10**12])
    assert (M._wide(M._small(counts), 5) == counts).all()
    many = np.array([1, 5, M._EXACT - 1, M._EXACT, 10**9])
    assert np.allclose(M._decoded(M._coded(many)), many, rtol=1e-5)
    keys = np.array([0, 1, 2**40 - 1], np.uint64)
    assert (M._unpack40(M._pack40(keys)) == keys).all()
