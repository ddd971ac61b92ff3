"""Mixing sources to target weights: capped water-filling and seeded repetition sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import WORD
from docweave.session import materialize

#: Slices of the sampling order within a source; each is sorted by a task of its own.
SLICE_DIGITS = 3


def water_fill(sources: DataFrame, epochs: int, total: Column) -> DataFrame:
    """Add target to (source, weight, source_size): total shared by weight, at most epochs * source_size each.

    Clamping the sources above their cap and resharing the excess until none is above ends at one water level: the
    sources whose cap per unit of weight lies under it are clamped, the others get level * weight. With the sources
    sorted by cap per weight the clamped ones are a prefix, found by running sums instead of rounds. The frame has
    one row per source. Sums are exact (decimals), so reruns agree to the last bit. If every source is clamped, each
    target is its cap.
    """
    wide = "decimal(38,0)"
    cap = (F.col("source_size") * epochs).cast(wide)
    weight = F.col("weight").cast(wide)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("rank")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.partitionBy()
    left = F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum(weight).over(everything) - F.coalesce(F.sum(weight).over(before), F.lit(0))
    levelled = sources.withColumn("total", total.cast(wide)).withColumn("clamped", cap * weight_left <= weight * left)
    free_total = F.first("total").over(everything) - F.coalesce(
        F.sum(F.when(F.col("clamped"), cap)).over(everything), F.lit(0)
    )
    free_weight = F.sum(F.when(~F.col("clamped"), weight)).over(everything)
    level = free_total.cast("double") / F.coalesce(free_weight, F.lit(1)).cast("double")
    target = F.when(F.col("clamped"), cap.cast("double")).otherwise(level * F.col("weight").cast("double"))
    return levelled.withColumn("target", target).drop("total", "clamped")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    epochs: int = 3,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, repeats, part.

    size counts the words of the text (null: 0). Sources in code-point order, null last, weigh weights, repeating.
    All sources share the sum of all sizes by weight, each at most epochs times its own size (water_fill()).
    A source's target, rounded to whole words, is met exactly: every document is repeated target // source_size
    times in whole; the rest is dealt to documents in a seeded random order, one more whole repetition each, and the
    last of them gives only its first `part` words. taken = repeats * size + part, so that reruns agree.
    Null texts and sources without words take 0. Null ids share one place in the order; rows alike in id and size
    swap freely. An empty table gives an empty result; other columns are not read.

    The random order is md5(seed:id). It is cut into 16**SLICE_DIGITS slices by its first digits: slice sums are
    added up first, then every slice is ordered on its own, so no task holds a whole source.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    # A source's key is never null, so that one partitioning serves the window and the join after it.
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none"))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), draw.alias("draw")
        ),
        "sizes",
    ).withColumns({"key": key, "slice": F.substring("draw", 1, SLICE_DIGITS)})

    by_slice = rows.groupBy("key", "slice").agg(F.first("source").alias("source"), F.sum("size").alias("slice_size"))
    sums = by_slice.groupBy("key").agg(F.first("source").alias("source"), F.sum("slice_size").alias("source_size"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy())
    targets = water_fill(ranked.withColumn("weight", weight), epochs, total)

    words = F.floor(F.col("target") + 0.5).cast("long")
    known = F.col("source_size") > 0
    dealt = (
        targets.withColumn("whole", F.when(known, F.expr("cast(floor(target + 0.5) as bigint) div source_size")))
        .withColumn("whole", F.coalesce("whole", F.lit(0)))
        .withColumn("rest", words - F.col("whole") * F.col("source_size"))
        .select("key", "source_size", "target", "whole", "rest")
    )
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        by_slice.drop("source")
        .join(dealt, "key")
        .withColumn("open", F.col("rest") - F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
        .drop("slice_size", "rest")
    )
    within = (
        Window.partitionBy("key", "slice").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("open") - F.col("ahead")))
    more = (extra == F.col("size")) & (F.col("size") > 0)
    return placed.join(slices, ["key", "slice"]).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + extra).alias("taken"),
        (F.col("whole") + more.cast("long")).alias("repeats"),
        F.when(more, 0).otherwise(extra).cast("long").alias("part"),
    )
