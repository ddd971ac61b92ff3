"""Joined words against a recursive search over all cuts at known names."""

import random
import re

from pyspark.sql import functions as F

from docweave.functions.joined import NAME_TOKENS, readable_name, readable_provider


def brute_parts(word):
    """All ways to cut at names; the one the rules want takes the first name of the list that is at an end."""
    if len(word) < 8 or not word.isupper():
        return [word]
    for name in NAME_TOKENS:
        if word == name:
            return [word]
        for rest, parts in ((word[len(name) :], lambda r: [name, *brute_parts(r)]), (word[: -len(name)], lambda r: [*brute_parts(r), name])):
            if len(rest) > 2 and word in (name + rest, rest + name):
                return parts(rest)
    return [word]


def brute_name(value):
    if value is None:
        return None
    value = re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(value.split()))
    words = []
    for part in value.split():
        half = len(part) // 2
        same = part.isupper() and len(part) >= 8 and len(part) % 2 == 0 and part[:half] == part[half:]
        for word in [part[:half], part[half:]] if same else [part]:
            words += brute_parts(word)
    if len(words) >= 2 and len(words[0]) > len(words[1]) + 2 and words[0].endswith(words[1]):
        words[0] = words[0][: -len(words[1])] + " " + words[1]
    return " ".join(words).upper()


def test_names_equal_brute_force(spark):
    rng = random.Random(6)
    pieces = [*NAME_TOKENS, "SAMPLE", "ADA", "Q", "XY", "Lee", "o'Neil", "JOHNSON", "É", " "]
    names = ["".join(rng.choice(pieces) for _ in range(rng.randrange(7))) for _ in range(900)]
    names += [None, "", "  ", "SAMPLECUSTOMERSAMPLECUSTOMER", "EdwardSampleHolder", "LONGNAME NAME", "EDWARD", "EDWARDXY", "EDWARDXYZ", "EMMANUEL" * 40, "12345678", "ABCDabcd"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string").withColumn("got", readable_name(F.col("name"))).collect()
    for r in got:
        assert r.got == brute_name(r["name"]), r


def test_providers(spark):
    rows = [("AbujaElectricityDistributionPrepaid", "Abuja Electricity Distribution Prepaid"), ("ABUJAELECTRICITY", "ABUJA ELECTRICITY"), ("ikejaElectric  plc", "ikeja Electric plc"), (None, None), ("", "")]
    got = spark.createDataFrame(rows, "a string, b string").select("b", readable_provider(F.col("a")).alias("got")).collect()
    assert all(r.b == r.got for r in got)
