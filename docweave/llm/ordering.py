"""Global order of rows: range partitions sorted and numbered, so that no key has to fit one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import materialize

#: At most so many (tree, partition) offsets are broadcast; more of them meet the rows in a shuffled join.
MOST_OFFSETS = 20_000


def ordered(df: DataFrame, by: Sequence[str | Column], label: str = "ordered") -> DataFrame:
    """df written in the order of by, nulls first, with _part and _seq: numbers that ascend with that order.

    Rows are dealt by range, so one value of the first columns may fill many partitions; rows equal in all of by
    share one. _seq numbers the rows of a partition without a gap, above those of the partitions before it.
    """
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialize(ranged.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), label)


def placed(df: DataFrame, tree: str, by: Sequence[str], label: str = "placed") -> tuple[DataFrame, DataFrame]:
    """df with pos, from 0 within each value of tree in the order of by, and total, the rows of that value.

    tree is a column without nulls. Only offsets for each (tree, partition) are added up, not rows. The second frame is
    the written table to discard when the first is not read any more.
    """
    table = ordered(df, [tree, *by], label)
    runs = table.groupBy(tree, "_part").agg(F.min("_seq").alias("_low"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        tree,
        "_part",
        (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_low")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(tree)).alias("total"),
    )
    shifts = materialize(shifts, f"{label}-offsets")
    few = shifts.limit(MOST_OFFSETS + 1).count() <= MOST_OFFSETS
    found = table.join(F.broadcast(shifts) if few else shifts, [tree, "_part"])
    return found.withColumn("pos", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift"), table
