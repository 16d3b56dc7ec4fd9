"""Top-k and full ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligora.session import cut


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    The literal bound lets Spark cut every input partition to ``k`` rows per
    group before the shuffle (WindowGroupLimit), so the largest group sends no
    more than ``k`` rows per task however many it has.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(name) <= F.lit(k))


def rank_all(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Row number within each group without sorting a group in one task.

    The rows are range-partitioned by group and order, which splits a large
    group over as many partitions as it needs, and stored with their partition
    number.  A row's number is its place within (group, partition) plus the
    size of the group in the partitions before.  ``order`` must be total.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n")).select(
        *group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*group, "_part").orderBy(*order)
    return (placed.withColumn("_row", F.row_number().over(inner)).join(offsets, group + ["_part"])
            .withColumn(name, F.col("_before") + F.col("_row")).drop("_before", "_row", "_part"))


def running_sum(df: DataFrame, group: list[str], order: list[Column], amount: Column, rank: str = "rank", before: str = "before") -> DataFrame:
    """Row number, and the sum of ``amount`` over the rows in front, within groups of any size.

    Like ``rank_all``: a large group is spread over range partitions, whose counts
    and sums are added up; no window sees more of a group than one partition has.
    ``order`` must be total, ``amount`` not NULL.
    """
    ranged = df.withColumn("_amount", amount).repartitionByRange(*[F.col(g) for g in group], *order)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.sum("_amount").alias("_s")).select(
        *group, "_part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}0") for c in ("_n", "_s")])
    inner = Window.partitionBy(*group, "_part").orderBy(*order)
    within = F.coalesce(F.sum("_amount").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (placed.withColumns({"_row": F.row_number().over(inner), "_sum": within}).join(offsets, group + ["_part"])
            .withColumns({rank: F.col("_n0") + F.col("_row"), before: F.col("_s0") + F.col("_sum")})
            .drop("_row", "_sum", "_n0", "_s0", "_part", "_amount"))
