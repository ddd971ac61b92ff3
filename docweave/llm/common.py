"""Column helpers that several operators of this subpackage share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters of a word: all but space and the five control characters of white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits in one block of a bitmap_construct_agg() bitmap.
_BLOCK_BITS = 32768
#: The largest bitmap has so many bits, as a power of two.
MOST_BITS = 28


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() has a byte-wise path, right where every character is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that it is none of df's columns (which differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@dataclass(frozen=True)
class Bitmap:
    """Hashes of keys as bits, in blocks; without a frame it marks every row."""

    frame: DataFrame | None
    bits: int


def key_bitmap(keys: DataFrame, key: str, n: int) -> Bitmap:
    """A bitmap of the hashes of keys[key], of which there are n: at least 16 bits for each, so that few others hit.

    It is broadcast, so it has MOST_BITS at most (32 MB). Of more keys than a quarter of that there is no bitmap: then
    every row is marked, and what a caller does with marked rows it does with all of them.
    """
    bits = max(16, min(MOST_BITS, (16 * n).bit_length()))
    if 4 * n > 1 << MOST_BITS:
        return Bitmap(None, bits)
    slot = f"pmod(xxhash64(`{key}`), {1 << bits})"
    blocks = (
        keys.select(
            F.expr(f"cast({slot} div {_BLOCK_BITS} as int)").alias("_block"),
            F.expr(f"{slot} % {_BLOCK_BITS}").alias("_pos"),
        )
        .groupBy("_block")
        .agg(F.bitmap_construct_agg("_pos").alias("_bitmap"))
    )
    return Bitmap(blocks, bits)


def with_bitmap_flag(df: DataFrame, key: Column, bitmap: Bitmap, flag: str) -> DataFrame:
    """Add flag: false only where key, an expression over df, is surely not among the bitmap's keys. No shuffle."""
    if bitmap.frame is None:
        return df.withColumn(flag, F.lit(True))
    slot, block, bits = (unused(df, name) for name in ("_slot", "_block", "_bitmap"))
    blocks = bitmap.frame.select(F.col("_block").alias(block), F.col("_bitmap").alias(bits))
    marked = df.withColumn(slot, F.pmod(F.xxhash64(key), F.lit(1 << bitmap.bits)))
    marked = marked.withColumn(block, F.expr(f"cast(`{slot}` div {_BLOCK_BITS} as int)"))
    byte = F.conv(F.hex(F.expr(f"substring(`{bits}`, cast((`{slot}` % {_BLOCK_BITS}) div 8 as int) + 1, 1)")), 16, 10)
    bit = F.call_function("shiftright", F.coalesce(byte.cast("int"), F.lit(0)), F.expr(f"cast(`{slot}` % 8 as int)"))
    return (
        marked.join(F.broadcast(blocks), block, "left")
        .withColumn(flag, bit.bitwiseAND(1) == 1)
        .select(*(F.col(f"`{c}`") for c in df.columns), flag)
    )


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame, n: int) -> DataFrame:
    """The rows of docs whose id is not among the n ids gone[id_col], with all their columns.

    Only rows that a bitmap of the ids marks meet gone in a join, so the texts of the others are not shuffled.
    """
    if not n:
        return docs
    flag, other = unused(docs, "_maybe_gone"), unused(docs, "_gone_id")
    marked = with_bitmap_flag(docs, F.col(f"`{id_col}`"), key_bitmap(gone, id_col, n), flag)
    sure = marked.where(~F.coalesce(F.col(flag), F.lit(False))).drop(flag)
    ids = gone.select(F.col(f"`{id_col}`").alias(other)).distinct()
    rest = marked.where(F.col(flag)).drop(flag)
    return sure.unionByName(rest.join(ids, F.col(f"`{id_col}`") == F.col(other), "left_anti"))
