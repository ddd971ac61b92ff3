"""The pipeline against brute force over a small corpus, and the operators' SQL on the smallest tables."""

import hashlib
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import oracles, queries
from docweave.llm import wide_simhash as W
from docweave.llm.exact_dedup import drop_exact_duplicates
from docweave.llm.mixing import mix_sources
from docweave.llm.toxicity import train_toxicity

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n))


def edited(rng, text, edits):
    parts = text.split(" ")
    for at in rng.sample(range(len(parts)), edits):
        parts[at] = words(rng, 1) + "x"
    return " ".join(parts)


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_wide_fingerprint_matches_definition():
    rng = random.Random(1)
    assert not W.wide_fingerprint(None).any() and not W.wide_fingerprint(" \n").any()
    for n in (1, 4, 5, 40, 600):
        text = words(rng, n)
        hashes = W.shingle_hashes(text)
        assert len(hashes) == len(shingles(text))
        x = (hashes[:, None] + W._ODD).astype(object)
        mask = (1 << 64) - 1
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        x = x ^ (x >> 31)
        want = [sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in x[:, k]) > len(hashes)) for k in range(W.WORDS)]
        assert [int(v) for v in W.wide_fingerprint(text)] == want


def test_distance_estimates_similarity():
    rng = random.Random(2)
    for edits in (2, 8, 16):
        a = words(rng, 600)
        b = edited(rng, a, edits)
        distance = int(np.bitwise_count(W.wide_fingerprint(a) ^ W.wide_fingerprint(b)).sum())
        assert abs(distance - W.bits_for(jaccard(shingles(a), shingles(b)))) < 40


def test_similar_long_sets_are_within_the_farthest_distance():
    rng = np.random.default_rng(7)
    for size in (W.LONG, 99, 400):
        both = W.least_shared(2 * size, 0.8 / 1.8)
        for _ in range(60):
            x = rng.integers(0, 1 << 62, 2 * size - both, dtype=np.uint64) * np.uint64(4)
            a, b = (W.fingerprint_of(np.unique(part)) for part in (x[:size], x[size - both :]))
            assert int(np.bitwise_count(a ^ b).sum()) <= W.farthest(0.8) - 10
    assert W.bits_for(0.8) < W.farthest(0.8) < W.bits_for(0.55)


@pytest.mark.parametrize("bucket", [16, 1])
def test_similar_documents_match_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(W, "BUCKET", bucket)
    rng = random.Random(3)
    rows, number = [], 0
    for _ in range(25):
        base = words(rng, rng.choice([60, 150, 400]))
        rows.append((number := number + 1, base))
        for edits in rng.sample([1, 1, 2, 3], rng.randrange(3)):
            rows.append((number := number + 1, edited(rng, base, edits)))
    rows += [(900, None), (901, " "), (902, "short text"), (903, "Short  TEXT"), (None, "short text")]
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    got = {r.doc_id: r.component_id for r in W.similar_documents(docs).collect()}
    assert {i: got.get(i, i) for i in sets} == {i: find(i) for i in sets}
    kept = W.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in {find(i) for i in sets})
    assert W.similar_documents(docs.where("false")).collect() == []


def test_pair_in_crowded_segments_of_unrelated_texts(spark):
    # Segments of four bits: each of their values is shared by many texts, and the smallest of these is unrelated.
    rng = random.Random(6)
    rows = [(i, words(rng, 80)) for i in range(150)]
    for i in range(200, 240, 2):
        rows += [(i, base := words(rng, 120)), (i + 1, edited(rng, base, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.component_id, r.doc_id) for r in W.similar_documents(docs, segment=4).collect() if r.doc_id != r.component_id}
    assert got == {(i, i + 1) for i in range(200, 240, 2)}


@pytest.mark.parametrize("occupancy", [0, 1, 4, 16, 100])
def test_recall_at_every_occupancy(spark, occupancy):
    """Pairs at a similarity of about .8, with so many unrelated texts on each value of a segment of five bits."""
    rng = random.Random(8)
    rows = [(i, words(rng, 40)) for i in range(32 * occupancy)]
    pairs = []
    while len(pairs) < 60:
        a = words(rng, 110)
        b = edited(rng, a, 3)
        if 0.8 <= jaccard(shingles(a), shingles(b)) < 0.84:
            pairs.append((10_000 + 2 * len(pairs), 10_001 + 2 * len(pairs)))
            rows += [(pairs[-1][0], a), (pairs[-1][1], b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.component_id, r.doc_id) for r in W.similar_documents(docs, segment=5).collect() if r.doc_id != r.component_id}
    assert got == set(pairs)


def test_pigeonring_finds_most_pairs_by_itself(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for i in range(0, 600, 2):
        a = words(rng, 110)
        b = edited(rng, a, rng.choice((2, 2, 3)))
        rows += [(i, a), (i + 1, b)]
        if jaccard(shingles(a), shingles(b)) >= 0.8:
            want.add((i, i + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = W.wide_fingerprints(docs).select(F.col("doc_id").alias("node"), "fp")
    found = {(r.a, r.b) for r in W.candidates(nodes, W.bits_for(0.8 - W.SLACK), 20).collect()}
    assert len(found & want) >= 0.93 * len(want) > 100


def test_large_group_makes_pairs_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(W, "LOCAL", 64)
    rng = random.Random(10)
    base = words(rng, 200)
    rows = [(i, edited(rng, base, 1)) for i in range(600)] + [(i, words(rng, 60)) for i in range(600, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = W.wide_fingerprints(docs).select(F.col("doc_id").alias("node"), "fp")
    slots = 102
    assert W.candidates(nodes, W.bits_for(0.74), 20).count() < 20 * slots * 600
    got = W.similar_documents(docs).collect()
    assert {r.doc_id for r in got} | {0} == set(range(600)) and {r.component_id for r in got} == {0}


def test_pair_with_many_shared_shingles_is_made_once(spark):
    # Rows of mixed_buckets(): documents 0 to 19 share 40 prefix shingles, every third also a shingle of its own between.
    rows = [(k, d, 400 + d % 2, 2 * k + (d % 3 == 0), d) for d in range(20) for k in range(40)]
    rows += [(1000 + k, d, 400 + d % 2, 2 * k, d) for d in range(0, 20, 3) for k in range(0, 40, 5)]
    # Two texts with one id, of which only the longer has enough behind the shared shingles.
    rows += [(k, 99, 40, k, 99) for k in range(40)] + [(k, 99, 401, 2 * (k - 10) + 1, 99) for k in range(10, 15)]
    mixed = spark.createDataFrame(rows, "key long, node long, size int, place int, root long")
    met = W.meetings(mixed, 0.8)
    want = {(a, b) for a in range(20) for b in [*range(a + 1, 20), 99]}
    assert {tuple(r) for r in W.missed_pairs(mixed, 0.8).collect()} == want
    assert met.count() == len(want)


def test_rows_are_told_apart_by_id_and_text(spark):
    rng = random.Random(11)
    long = words(rng, 200)
    rows = [(1, "a b"), (2, "a b"), (2, "unique words"), (2, "unique words"), (3, long), (3, edited(rng, long, 1))]
    rows += [(None, "a b"), (None, "nobody"), (None, long + " end"), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, 0, 0, 0, "") for r in rows], "doc_id long, text string, _pos int, _row int, _maybe int, _NORM string")
    kept = [(r.doc_id, r.text) for r in drop_exact_duplicates(docs).collect()]
    want = [(1, "a b"), (2, "unique words"), *rows[4:6], (None, "nobody"), (None, long + " end"), (4, None)]
    assert sorted(kept, key=str) == sorted(want, key=str)
    near = W.drop_similar(docs)
    assert near.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in near.collect()]
    of_long = [r for r in kept if r[1] and len(r[1]) > 100]
    assert len(of_long) == 1 and of_long[0][0] == 3
    assert sorted(set(kept) - set(of_long), key=str) == sorted([want[0], want[1], want[4], want[6]], key=str)


@pytest.mark.parametrize("n", [1, 4, 5, 8, 9, 14, 24, 60])
def test_all_pairs_of_short_texts(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(0, 120, 3):
        base = words(rng, n)
        rows += [(i, base), (i + 1, base + " " + words(rng, 1)), (i + 2, base + " " + words(rng, max(1, n // 8)))]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    root = {i: i for i in sets}
    for a, b in links:  # ascending, so that a has its root already
        root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in W.similar_documents(docs).collect()}
    assert {i: got.get(i, i) for i in sets} == root


def test_prefix_holds_a_shared_shingle():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 12, 300):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate((rng.permutation(a)[: W.least_shared(n, 0.8)], np.zeros(0, np.uint64))))
            common = np.sort(rng.permutation(a)[: n // 2])
            common = common, rng.integers(1, 9, len(common))
            assert set(W.prefix_of(a, 0.8, common).tolist()) & set(W.prefix_of(b, 0.8, common).tolist())


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(4)
    item = words(rng, 14)
    rows = []
    for i in range(240):
        text = words(rng, rng.randrange(60, 120))
        if i % 8 == 3:
            text += ". You are such rottenscum here."
        rows.append([i, text, "en", f"s{i % 4}", len(text)])
    rows[10][1] = rows[200][1].upper()
    rows[11][1] = rows[201][1]
    rows[12][1] = edited(rng, rows[202][1], 1)
    rows[13][1] += " " + item + " tail"
    rows[14][1] = None
    rows[15][1] = ""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    write(spark, tmp_path, "documents", [tuple(r) for r in rows], schema)
    write(spark, tmp_path, "labels", [(i, 1, int(i % 8 == 3)) for i in range(200)], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [(1, item), (2, None)], "item_id long, text string")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = train_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))

    left = {r[0]: r for r in rows if model.score(r[1])[0] < 0.3}
    assert len(left) == 211 and all(i % 8 != 3 or i == 11 for i in left)  # 11 lost its passage to a copy
    stages = [dict(left)]
    seen, kept = set(), {}
    for i, r in sorted(left.items()):
        key = hashlib.sha256((r[1] or "").lower().encode()).digest()
        if key not in seen:
            kept[i] = r
            seen.add(key)
    stages.append(kept)
    near = {i: r for i, r in kept.items() if not any(j < i and jaccard(shingles(r[1]), shingles(s[1])) >= 0.8 for j, s in kept.items())}
    stages.append(near)
    stages.append({i: r for i, r in near.items() if item not in (r[1] or "")})
    assert [len(s) for s in stages] == [211, 208, 207, 206]

    at = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], stages, strict=True):
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        assert sorted(map(tuple, at.collect()), key=str) == sorted(map(tuple, want.values()), key=str)
    want = mix_sources(spark.createDataFrame([tuple(r) for r in stages[-1].values()], schema)).where("taken > 0")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_oracles(spark, name):
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.sql(f"create view {path.stem} as select * from '{path}'")
    frame, want = queries.queries()[name](spark, SF), db.sql(oracles.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(str(r[c]) for c in columns) for r in frame.collect()), key=str)
    assert got == sorted((tuple(str(r[i]) for i in at) for r in want.fetchall()), key=str)
