import random

import xxhash
from pyspark.sql import functions as F

from docweave.llm import simhash
from docweave.llm.components import connected_components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_definition():
    rng = random.Random(5)
    texts = [None, "", "  \n", "One", "one two", "A\u0085b c\x1cd e Ärger É", "x " * 70000]
    texts += [" ".join(rng.choice(["The", "of", "é", "uv"]) for _ in range(n)) for n in (3, 4, 50, 300)]
    for text in texts:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


def test_links_match_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base) | {0}
    for v in base[:20]:
        at = v
        for _ in range(6):
            for _ in range(rng.choice([1, 2, 3])):
                at ^= 1 << rng.randrange(64)
            values.add(at)
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    want = brute_components(sorted(values), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for bucket in (256, 1):  # with bucket 1 all shared segments are crowded
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = {v: v for v in values}
        got |= {r.node: r.root for r in connected_components(simhash.near_links(frame)).collect()}
        assert got == want


def test_components_of_a_chain(spark):
    edges = spark.range(60).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    found = connected_components(edges.union(spark.createDataFrame([(100, 101), (None, 3), (5, 5)], "a long, b long")))
    assert {r.node: r.root for r in found.collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_whole_operator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9001, None), (9002, ""), (9003, " \n"), (9003, " \n")]
    extra = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, least string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(extra).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    root = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert got == {(i, f"{fps[i]:016x}", root[i]) for i in fps}
    assert simhash.near_duplicates(extra.where("false")).collect() == []
    no_id = spark.createDataFrame([(None, "a b c d"), (None, None), (4, "")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(no_id).collect()) == ["4", "4", "None"]
