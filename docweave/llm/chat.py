"""Chat formatting after cumulative-snapshot collapse, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import key_bitmap, with_bitmap_flag
from docweave.session import discard, materialize

#: Turn numbers to a block: running hashes are added up per block first, so no conversation is one task's work.
BLOCK_TURNS = 1024
#: Seeds of the two halves of a 128-bit turn hash.
SEEDS = (11, 13)


def maximal_ids(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id) of the conversations that are no prefix of another one; see maximal_conversations().

    The rolling hash of a prefix is the exclusive or of position-keyed turn hashes, 128 bits wide. It is composed
    from block totals and a running value within each block. Prefix and conversation hashes are made distinct before
    they meet in the anti-join, so a first turn or a whole conversation that occurs everywhere is one row there.
    Only hashes are moved; a text is, where another turn of its conversation has the same number and role.
    """
    block = F.floor(F.coalesce(F.col(turn_col), F.lit(-1)) / BLOCK_TURNS)
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
        block.alias("block"),
    )
    rows = rows.withColumns({"place": F.xxhash64("conv_id", "turn", "role"), **{f"c{s}": _content_hash(s) for s in SEEDS}})
    tied = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place")
    tied = materialize(tied, "ties")
    rows = with_bitmap_flag(rows, F.col("place"), key_bitmap(tied, "place", tied.count()), "tied")
    rows = rows.withColumn("text", F.when(F.col("tied"), F.col("text"))).drop("place", "tied")
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = rows.withColumn("nth", F.row_number().over(inner) - 1).drop("turn", "role", "text")
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        rows.groupBy("conv_id", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("skip", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .drop("n")
    )
    same = placed["conv_id"].eqNullSafe(counts["conv_id"]) & (placed["block"] == counts["block"])
    keyed = placed.join(counts, same).withColumn("pos", F.col("nth") + F.col("skip"))
    keyed = keyed.select(
        placed["conv_id"], placed["block"], "pos", *(F.xxhash64(F.lit(s), "pos", *(f"c{x}" for x in SEEDS)).alias(f"h{s}") for s in SEEDS)
    )
    keyed = materialize(keyed, "turns")

    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = keyed.groupBy("conv_id", "block").agg(*(F.bit_xor(f"h{s}").alias(f"t{s}") for s in SEEDS))
    carried = totals.withColumns(
        {f"c{s}": F.coalesce(F.bit_xor(f"t{s}").over(ahead), F.lit(0).cast("long")) for s in SEEDS}
    ).drop(*(f"t{s}" for s in SEEDS))
    inside = keyed.select(
        "conv_id", "block", "pos", *(F.bit_xor(f"h{s}").over(running).alias(f"r{s}") for s in SEEDS)
    )
    same = inside["conv_id"].eqNullSafe(carried["conv_id"]) & (inside["block"] == carried["block"])
    prefixes = inside.join(carried, same).select(
        inside["conv_id"],
        (F.col("pos") + 1).alias("length"),
        *(F.col(f"r{s}").bitwiseXOR(F.col(f"c{s}")).alias(f"p{s}") for s in SEEDS),
    )
    prefixes = materialize(prefixes, "prefixes")

    hashes = ["length", *(f"p{s}" for s in SEEDS)]
    longest = prefixes.groupBy("conv_id").agg(F.max("length").alias("full"))
    same = prefixes["conv_id"].eqNullSafe(longest["conv_id"])
    marked = prefixes.join(longest, same).drop(longest["conv_id"])
    whole = marked.where("length = full").groupBy(*hashes).agg(F.min("conv_id").alias("conv_id"))
    proper = marked.where("length < full").select(*hashes).distinct()
    kept = materialize(whole.join(proper, hashes, "left_anti").select("conv_id"), "kept")
    discard(tied, keyed, prefixes)
    return kept


def _content_hash(seed: int) -> Column:
    marks = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("role", "text")]
    return F.xxhash64(F.lit(seed), *marks, F.lit(seed * 7919))


def maximal_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The turns (conv_id, turn, role, text) of the maximal conversations; see maximal_conversations().

    A bitmap of the ids keeps the texts of the other conversations out of the shuffle.
    """
    kept = maximal_ids(turns, conv_col, turn_col, role_col, text_col)
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    rows = with_bitmap_flag(rows, F.col("conv_id"), key_bitmap(kept, "conv_id", kept.count()), "may").where("may").drop("may")
    ids = kept.select(F.col("conv_id").alias("kept_id"))
    return rows.join(ids, rows["conv_id"].eqNullSafe(ids["kept_id"]), "left_semi")


def maximal_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """The turns (conv_id, pos, turn, role, text) of conversations that are no prefix of another one.

    Turns are ordered by (turn, role, text), nulls first, and numbered from 0 as pos. Two turns are the same if role
    and text are; a null differs from an empty string. Of conversations with the same turns the smallest conv_id
    stays. Rows without conv_id form one conversation of their own. Repeated rows are turns of their own. An empty
    table gives an empty result; other columns are not read.
    """
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return maximal_turns(turns, **columns).select("conv_id", pos.alias("pos"), "turn", "role", "text")


def chat_format(turns: DataFrame, **columns: str) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, rendered.

    A turn is rendered as <|im_start|>role, a line feed, the text and <|im_end|>, turns joined by line feeds; null
    roles render as user, null texts as empty. Columns and the handling of nulls, ties and repeats are those of
    maximal_conversations().
    """

    def shown(x: Column) -> Column:
        head = F.concat(F.lit("<|im_start|>"), F.coalesce(x["role"], F.lit("user")), F.lit("\n"))
        return F.concat(head, F.coalesce(x["text"], F.lit("")), F.lit("<|im_end|>"))

    return (
        maximal_turns(turns, **columns)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("turns", shown), "\n").alias("rendered"),
        )
    )
