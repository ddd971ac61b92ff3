import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import topk

SCHEMA = "vec_id long, embedding array<float>, pos long, dim string, shard int, label int"


def fits(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, every, k):
    """(query id, rank, id, score) of all queries, ordered; rows are told apart by their place."""
    vecs = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if fits(v)]
    out = []
    for p, (i, q) in enumerate(vecs):
        if i is None or i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for o, (j, v) in enumerate(vecs) if o != p and len(v) == len(q)]
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "d", 1, 2) for i, v in rows], SCHEMA).repartition(5)


def sample(n, dim, seed=1, ties=False):
    rng = random.Random(seed)
    one = (lambda: rng.choice([0.0, 0.25, -0.25])) if ties else (lambda: rng.gauss(0, 0.3))
    return [(i, [one() for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize(("shard", "leaf", "ties"), [(64, 4, False), (64, 4, True), (4096, 256, False)])
def test_equals_brute_force(spark, shard, leaf, ties):
    rows = sample(400, 6, ties=ties)
    got = topk.exact_top_k(frame(spark, rows), F.col("vec_id") % 7 == 0, shard=shard, leaf=leaf)
    assert found(got) == brute(rows, 7, 5)


def test_edge_cases(spark):
    rows = sample(30, 4, 2) + sample(6, 3, 3)
    rows += [rows[0], rows[0], rows[7], (0, [0.5] * 4), (None, [0.5] * 4), (None, [0.5] * 4), (70, None), (77, []), (84, [1.0, None, 1.0, 1.0]), (91, [1.0, float("nan"), 1.0, 1.0])]
    rows += [(98, [1.0, float("inf"), 1.0, 1.0]), (105, [3.0e6, -2.0e6, 1.0e6, 5.0]), (112, [2.5e9, -2.5e9, 1.0, 1.0]), (119, [0.0] * 4), (-7, [-0.25, 0.001, -0.001, 0.0]), (126, [0.25] * 9)]
    got = topk.exact_top_k(frame(spark, rows), F.col("vec_id") % 7 == 0, k=4, shard=8, leaf=2)
    want = [(q, r, i, max(min(s, (1 << 63) - 1), -(1 << 63))) for q, r, i, s in brute(rows, 7, 4)]
    assert found(got) == want
    assert not [r for r in want if r[0] == 126]  # nothing else has its length


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    assert found(topk.exact_top_k(frame(spark, rows), F.col("vec_id") == 0)) == [(0, 1, 1, 32768), (0, 2, 2, 0)]
    assert topk.exact_top_k(frame(spark, []), F.col("vec_id") == 0).collect() == []


def test_equal_vectors_are_one_leaf_and_hot(spark):
    rows = [(i, [0.5, 0.25]) for i in range(600)] + [(1000, [1.0, 1.0])]
    got = topk.exact_top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, shard=128, leaf=16)
    assert found(got) == brute(rows, 100, 5)


def test_boxes_pass_over_what_cannot_reach_the_kth_score(monkeypatch):
    """Two clusters: from a bound of the near one no leaf of the far one is scored."""
    rng = np.random.default_rng(5)
    near, far = rng.integers(200, 256, (300, 8)), rng.integers(-256, -200, (300, 8))
    vectors = np.concatenate([near, far])
    order, spans, boxes = topk.build_tree(vectors, 16)
    assert all((boxes[k][0] == vectors[order[a:b]].min(axis=0)).all() and (boxes[k][1] == vectors[order[a:b]].max(axis=0)).all() for k, (a, b, _) in enumerate(spans))
    assert sorted(order) == list(range(600)) and all(b - a <= 16 for a, b, child in spans if child < 0)
    seen = []
    add = topk._Best.add
    monkeypatch.setattr(topk._Best, "add", lambda self, q, scores, ids, n: (seen.extend(ids), add(self, q, scores, ids, n))[1])
    ids = order.astype(np.int64)
    args = (vectors[order], spans, boxes), ids, np.zeros(600, bool), ids
    rows = topk.search_tree(*args, near[:1], np.array([-1]), [None], 5)
    scores = sorted((near[0] @ vectors.T).tolist(), reverse=True)
    assert [-s for s, _, _ in rows[0]] == scores[:5] and max(seen) < 300
    seen.clear()
    assert topk.search_tree(*args, near[:1], np.array([-1]), [scores[0] + 1], 5) == [[]] and not seen
