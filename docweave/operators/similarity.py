"""Lookup of misspelt names: bounded by shared letters, decided by an exact similarity ratio, joined by value."""

from __future__ import annotations

from collections.abc import Mapping
from difflib import SequenceMatcher
from string import ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def letter_counts(value: Column) -> Column:
    """How often each of A to Z is in the text, as an array of 26."""
    count = lambda c: F.length(value) - F.length(F.replace(value, F.lit(c), F.lit("")))
    return F.array(*(count(c) for c in ascii_uppercase))


def most_ratio(counts: Column, size: Column, other_counts: Column, other_size: Column) -> Column:
    """An upper bound of the ratio: no matching blocks hold more letters than both texts share, order aside."""
    shared = F.aggregate(F.zip_with(counts, other_counts, lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    return 2.0 * shared / (size + other_size)


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(a=a, b=b).ratio() for a, b in zip(left, right, strict=True)], dtype=float)


def nearest_codes(values: DataFrame, value_col: str, aliases: Mapping[str, str], least: float) -> DataFrame:
    """(value, code) of the distinct texts of A to Z in value_col whose most similar alias has a ratio of least or more.

    The ratio is twice the matching letters by both lengths; of equally similar aliases the first counts. It has no
    built-in equivalent, so it is taken in Arrow batches, but only where the letters that value and alias share leave
    it open: few pairs are compared exactly, however many rows have a value. Nulls and empty texts have no code.
    """
    known = [(i, a.replace(" ", ""), code) for i, (a, code) in enumerate(aliases.items())]
    found = values.select(F.col(value_col).alias("value")).where("value <> ''").distinct()
    found = found.withColumns({"size": F.length("value"), "counts": letter_counts(F.col("value"))})
    numbers = lambda text: F.array(*(F.lit(text.count(c)) for c in ascii_uppercase))
    rows = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(a).alias("alias"), F.lit(code).alias("code"), numbers(a).alias("counts")) for i, a, code in known))
    may = F.filter(rows, lambda a: most_ratio(F.col("counts"), F.col("size"), a["counts"], F.length(a["alias"])) >= least)
    pairs = found.select("value", F.explode(may).alias("a")).select("value", "a.rank", "a.alias", "a.code")
    scored = pairs.withColumn("ratio", _ratio("value", "alias")).where(F.col("ratio") >= least)
    return scored.groupBy("value").agg(F.max_by("code", F.struct("ratio", -F.col("rank"))).alias("code"))
