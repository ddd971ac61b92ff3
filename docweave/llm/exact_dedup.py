"""Exact de-duplication by a 128-bit content hash, with the bytes compared inside every group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import Bitmap, ascii_lower, key_bitmap, unused, with_bitmap_flag
from docweave.session import materialize


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z only. A null text counts as empty.
    keep names the row of a group that stays: the "smallest" or the "largest" id. A repeated row (same id and
    text) counts in group_size and gets the same answer as its twin. A group without any id keeps null, and its
    rows have kept = false. An empty table gives an empty result; other columns of docs are not read.

    1. Hashes and ids alone are grouped (one row per hash and map task is shuffled). Hashes that occur twice set
       bits of a bitmap, broadcast within its bound; of more hashes than it can tell apart every text counts as marked.
    2. Only texts whose bit is set are shuffled, grouped by (hash, text): the grouping compares bytes, so texts that
       merely share a hash part here. Partial aggregation keeps one copy of a text per map task, however hot.
    3. Each row looks its group up by hash. Hashes with several texts, if there are any, go by (hash, text) instead.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    best = F.min if keep == "smallest" else F.max
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("hash", content_hash(F.col("norm")))
    narrow = texts.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))

    equal = (
        with_bitmap_flag(texts, F.col("hash"), _repeats(narrow), "maybe")
        .where("maybe")
        .groupBy("hash", "norm")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    by_hash = materialize(
        equal.drop("norm")
        .groupBy("hash")
        .agg(
            F.count(F.lit(1)).alias("n_texts"),
            F.first("keep_id").alias("keep_id"),
            F.first("group_size").alias("group_size"),
        ),
        "groups",
    )

    sure = by_hash.where("n_texts = 1 and group_size > 1").drop("n_texts")
    shared = by_hash.where("n_texts > 1").select("hash")
    collisions = not shared.isEmpty()
    rows = narrow.join(shared, "hash", "left_anti") if collisions else narrow
    found = rows.join(sure, "hash", "left")
    if collisions:
        parted = texts.join(shared, "hash", "left_semi")
        groups = parted.groupBy("hash", "norm").agg(
            best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        by_text = parted.join(groups, ["hash", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
        found = found.unionByName(by_text.select(*found.columns))
    # A row without a group is alone: it keeps itself. A group without ids keeps null.
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(keep_id == F.col("doc_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def _repeats(hashed: DataFrame) -> Bitmap:
    """A bitmap of the values that occur twice in the column hash."""
    repeated = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    repeated = materialize(repeated, "repeats")
    return key_bitmap(repeated, "hash", repeated.count())


def drop_exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row of docs for each text, with all its columns: the one with the smallest (or largest) id.

    Rows are told apart by their texts, not by ids: rows that share an id but differ in text all stay. Of a repeated
    row (same id and text) one stays; a row without an id stays only if no row with its text has one. Equality, nulls
    and empty tables are as in exact_duplicates(). Columns may have any names.

    The bitmap of repeated hashes lets single texts pass without a shuffle. The others are grouped by (hash, text),
    which compares bytes, and one row is kept per group already before the shuffle.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    norm, hash_, maybe, row = (unused(docs, name) for name in ("_norm", "_hash", "_maybe", "_row"))
    own, ident = [F.col(f"`{c}`") for c in docs.columns], F.col(f"`{id_col}`")
    hashed = docs.withColumn(norm, ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    hashed = hashed.withColumn(hash_, content_hash(F.col(norm)))
    flagged = with_bitmap_flag(hashed, F.col(hash_), _repeats(hashed.select(F.col(hash_).alias("hash"))), maybe)
    # Smallest: rows without an id come last. Largest: nulls are smallest anyway.
    order, best = (F.struct(ident.isNull(), ident), F.min_by) if keep == "smallest" else (F.struct(ident), F.max_by)
    stay = flagged.where(maybe).groupBy(hash_, norm).agg(best(F.struct(*own), order).alias(row)).select(f"{row}.*")
    return flagged.where(~F.col(maybe)).select(*own).union(stay)
