"""Global ranks and running sums that never gather all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octaspark.staging import cut_lineage, discard, written


def running_sum(df: DataFrame, value: Column, *order: Column | str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows before this one in a total order.

    Rows are range-partitioned by the order, so each task sums its own range; the ranges'
    totals, one row per partition, tell where each starts. Both are taken from rows written
    with their partition: a second range exchange would draw other bounds.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [f"_o{k}" for k in range(len(cols))]
    dealt = cut_lineage(df.withColumns(dict(zip(keys, cols)) | {"_v": value}).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    own = F.sum("_v").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    totals = dealt.groupBy("_part").agg(F.sum("_v").alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total")
    start = totals.select("_part", before.alias("_start"))
    out = dealt.withColumn("_own", own).join(start, "_part")
    return out.withColumn(name, F.col("_start") + F.col("_own") - F.col("_v")).drop("_part", "_own", "_start", "_v", *keys)


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """A dense 0-based rank in a total order.

    One range shuffle: rows are sorted within their partition and written with their place in it, which the low
    bits of the row number tell; what a partition starts at is one number for each. Columns named in the order
    travel once; only expressions get a column of their own.
    """
    made = {f"_o{k}": c for k, c in enumerate(order) if not isinstance(c, str)}
    keys = [c if isinstance(c, str) else f"_o{k}" for k, c in enumerate(order)]
    dealt = df.withColumns(made).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*made)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(dealt.withColumns({"_part": F.spark_partition_id(), "_place": place}), "ranked")
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    start = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    out = placed.join(F.broadcast(start), "_part")  # a row for each partition
    return out.withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def bins_with_reset(df: DataFrame, size: Column, most: int, *order: Column | str, name: str = "bin") -> DataFrame:
    """Number of each row's bin when rows are put into bins in order and a bin is closed once it holds more than ``most``.

    As a loop would: the next bin starts at the first row before which more than ``most`` lies since this one's
    start. That row is found for every row at once, by counting how many rows' running sums lie at or
    below its own plus ``most``. Which rows do start bins follows by doubling: rounds grow with the
    logarithm of the number of bins.
    """
    numbered = written(running_sum(ranked(df, *order, name="_i").withColumn("_size", size), F.col("_size"), "_i", name="_before"), "numbered")
    node = numbered.select(F.col("_before").alias("v"), F.lit(0).alias("asks"), "_i")
    ask = numbered.select((F.col("_before") + most).alias("v"), F.lit(1).alias("asks"), "_i")
    counted = running_sum(node.unionByName(ask), 1 - F.col("asks"), "v", "asks", "_i", name="to")
    jump = written(counted.where("asks = 1").select("_i", "to"), "jump")
    starts = written(numbered.where("_i = 0").select("_i"), "starts")
    while True:
        met = starts.join(jump, "_i").select(F.col("to").alias("_i")).join(numbered.select("_i"), "_i", "left_semi")
        more = written(met.join(starts, "_i", "left_anti").distinct(), "starts")
        if more.isEmpty():
            break
        before = starts, more, jump
        starts = written(starts.unionByName(more), "starts")
        further = jump.select(F.col("_i").alias("to"), F.col("to").alias("further"))
        jump = written(jump.join(further, "to").select("_i", F.col("further").alias("to")), "jump")
        discard(*before)
    opened = numbered.join(starts.withColumn("_opens", F.lit(1)), "_i", "left").withColumn("_opens", F.coalesce("_opens", F.lit(0)).cast("long"))
    out = running_sum(opened, F.col("_opens"), "_i", name="_closed")
    return out.withColumn(name, F.col("_closed") + F.col("_opens") - 1).drop("_i", "_size", "_before", "_opens", "_closed")
