"""Nearest aliases against a plain loop over all of them."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docweave.operators import similarity, utility


def brute(value):
    best = max(((SequenceMatcher(a=value, b=a.replace(" ", "")).ratio(), -i, c) for i, (a, c) in enumerate(utility.PROVIDERS.items())))
    return best[2] if value and best[0] >= utility.LEAST_RATIO else None


def misspelt(rng, text):
    letters = list(text)
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(letters))
        rng.choice([lambda: letters.pop(at), lambda: letters.insert(at, rng.choice("ABCXYZ ")), lambda: letters.__setitem__(at, rng.choice("AEIOU"))])()
        letters = letters or ["A"]
    return "".join(letters)


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    names = [misspelt(rng, rng.choice(list(utility.PROVIDERS))) for _ in range(700)] + ["", None, "Z" * 300, "AEDCX", "something else", "A" * 5000]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)] * 2, "doc_id int, name string, _compact string")
    got = utility.with_provider_code(df, F.col("name"), "code").collect()
    assert len(got) == 2 * len(names) and got[0].__fields__ == ["doc_id", "name", "_compact", "code"]
    found = 0
    for r in got:
        text = " ".join("".join(c if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ " else " " for c in (r["name"] or "").upper()).split())
        want = next((c for a, c in utility.PROVIDERS.items() if a in text), None) or brute(text.replace(" ", ""))
        assert r.code == want, r
        found += r.code is not None and not any(a in text for a in utility.PROVIDERS)
    assert found > 200


def test_bound_is_never_under_the_ratio(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("ABC") for _ in range(rng.randrange(1, 12))), "".join(rng.choice("ABCD") for _ in range(rng.randrange(1, 12)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string")
    bound = similarity.most_ratio(similarity.letter_counts(F.col("a")), F.length("a"), similarity.letter_counts(F.col("b")), F.length("b"))
    for r in df.withColumn("bound", bound).collect():
        assert r.bound >= SequenceMatcher(a=r.a, b=r.b).ratio() - 1e-12
