"""Where running totals of a large frequency table reach a target, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.session import stored


def crossing(freq: DataFrame, targets: DataFrame, descending: bool = False) -> DataFrame:
    """The value of each group at which the running total of counts first reaches the group's target.

    freq(grp, v, n) holds one row per distinct value; targets(grp, target) the totals to reach. The
    table is range-partitioned by (grp, v), so a hot group spreads over many tasks; totals per
    (group, partition) show which partition holds the crossing, and only those partitions are summed
    row by row. Groups whose total stays below the target have no row. Result: grp, v, reached.
    """
    order = F.col("v").desc() if descending else F.col("v").asc()
    ranged = stored(freq.select("grp", "v", "n").repartitionByRange("grp", order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy("grp", "part").agg(F.sum("n").alias("s")).withColumn("upto", F.sum("s").over(before))
    chosen = (
        sums.join(targets.select("grp", "target"), "grp")
        .filter((F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("s") < F.col("target")))
        .select("grp", "part", "target", (F.col("upto") - F.col("s")).alias("offset"))
    )
    within = Window.partitionBy("grp", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min if not descending else F.max
    return (
        ranged.join(chosen, ["grp", "part"])
        .withColumn("reached", F.sum("n").over(within) + F.col("offset"))
        .filter(F.col("reached") >= F.col("target"))
        .groupBy("grp")
        .agg(first("v").alias("v"), F.min("reached").alias("reached"))
    )
