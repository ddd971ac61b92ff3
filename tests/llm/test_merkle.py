import hashlib
import random
import zlib

import pytest

from docweave.llm.merkle import merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, leaf int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_levels(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def brute_path(levels, i, fanout):
    path = []
    for nodes in levels[:-1]:
        low = i // fanout * fanout
        run = nodes[low : low + fanout]
        path.append(("".join(run[: i - low]), "".join(run[i - low + 1 :])))
        i //= fanout
    return path


def brute(rows, fanout):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    made, subs = {}, []
    for lang in langs:
        own = [(r, brute_leaf(r[:5])) for r in rows if r[2] == lang]
        own.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        levels = brute_levels([x[1] for x in own], fanout)
        made[lang] = own, levels
        subs.append(levels[-1][0])
    top = brute_levels(subs, fanout)
    out = []
    for k, lang in enumerate(langs):
        own, levels = made[lang]
        for i, (r, leaf) in enumerate(own):
            path = brute_path(levels, i, fanout) + brute_path(top, k, fanout)
            fold = leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
                fold = brute_leaf((*r[:4], low))
            for before, after in path:
                fold = digest(before + fold + after)
            root = top[-1][0]
            out.append((str(r[0]), leaf, levels[-1][0], root, digest("".join(b + a for b, a in path)), fold, fold == root))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def sample(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", "é", "", None])
        text = rng.choice([None, "", "lower only", f"Mixed Ärger {i}", "X" * 5000])
        rows.append((i, rng.choice(["a", None]), lang, rng.choice([None, len(text or "")]), text, "t", i, 1))
    rows += [rows[0], rows[0], rows[3], (None, None, None, None, None, "t", 0, 1), (None, "a", "en", 3, "NoId", "t", 0, 1), (-7, "a", "de", -1, "Neg", "t", 0, 1)]
    return rows


@pytest.mark.parametrize(("n", "fanout", "depth"), [(150, 2, 2), (260, 3, 1), (90, 8, 4)])
def test_manifest_equals_brute_force(spark, n, fanout, depth):
    rows = sample(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = found(merkle_manifest(df, fanout=fanout, depth=depth))
    assert got == brute(rows, fanout)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_one_language_and_many_languages(spark):
    one = [(5, "s", "en", 1, "A", "t", 0, 0)]
    assert found(merkle_manifest(spark.createDataFrame(one, SCHEMA))) == brute(one, 8)
    same = [(i, "s", "en", 1, "A", "t", 0, 0) for i in range(70)]
    assert found(merkle_manifest(spark.createDataFrame(same, SCHEMA), fanout=8, depth=1)) == brute(same, 8)
    many = [(i, "s", f"l{i}", 1, "a", "t", 0, 0) for i in range(70)]
    assert found(merkle_manifest(spark.createDataFrame(many, SCHEMA), fanout=4, depth=1)) == brute(many, 4)


def test_manifest_of_no_rows(spark):
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []
