"""Statistics of points, nodes, levels and benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octaspark.operators.ordering import ranked


def bounding_box(points: DataFrame, *by: str) -> DataFrame:
    """min and max per axis and the edge of the bounding cube, per group if ``by`` is given."""
    box = points.groupBy(*by).agg(*[f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)], F.count("*").alias("n"))
    return box.withColumn("cube_size", F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"]))


def node_stats(tree: DataFrame, voxel_counts: DataFrame) -> DataFrame:
    """One row: node and leaf counts, points of leaves and voxels of inner nodes.

    ``tree`` has level, key, n, is_leaf; ``voxel_counts`` has num_voxels per inner node.
    """
    leaf = F.when(F.col("is_leaf"), F.col("n"))
    points = tree.agg(
        F.count("*").alias("nodes"),
        F.count_if("is_leaf").alias("leaves"),
        F.count_if(~F.col("is_leaf")).alias("inner"),
        F.sum(leaf).alias("points"),
        F.min(leaf).alias("min_points"),
        F.max(leaf).alias("max_points"),
        F.try_divide(F.sum(leaf), F.count(leaf)).alias("_mean"),
    )
    voxels = voxel_counts.agg(F.coalesce(F.sum("num_voxels"), F.lit(0)).alias("voxels"), F.min("num_voxels").alias("min_voxels"), F.max("num_voxels").alias("max_voxels"), F.avg("num_voxels").alias("_vmean"))
    out = points.crossJoin(F.broadcast(voxels))  # one row each
    return out.select(
        "nodes", "leaves", "inner", "points", "min_points", "max_points", F.floor("_mean").cast("long").alias("avg_points"), "voxels", "min_voxels", "max_voxels", F.floor("_vmean").cast("long").alias("avg_voxels")
    )


def level_stats(tree: DataFrame, voxel_counts: DataFrame) -> DataFrame:
    """Per level: leaves, inner nodes, points and voxels."""
    by_level = tree.groupBy("level").agg(
        F.count_if("is_leaf").alias("leaves"), F.count_if(~F.col("is_leaf")).alias("inner"), F.coalesce(F.sum(F.when(F.col("is_leaf"), F.col("n"))), F.lit(0)).alias("points")
    )
    voxels = voxel_counts.groupBy("level").agg(F.sum("num_voxels").alias("voxels"))
    return by_level.join(voxels, "level", "left").withColumn("voxels", F.coalesce("voxels", F.lit(0)))


def level_rate(levels: DataFrame) -> DataFrame:
    """Samples of a level in percent of the next one's, truncated; one row per level."""
    samples = F.col("points") + F.col("voxels")
    nxt = F.lead(samples).over(Window.orderBy("level"))
    return levels.select("level", samples.alias("samples"), F.floor(F.try_divide(100 * samples, nxt)).cast("long").alias("rate"))


def histogram(df: DataFrame, column: str, top: int, bins: int = 100) -> DataFrame:
    """Equal bins over [0, top]; the last takes what lies above."""
    return df.groupBy(F.least(F.floor(F.col(column) * bins / top), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def reduction_stats(tree: DataFrame, voxel_counts: DataFrame) -> DataFrame:
    """Node, leaf and inner counts and the mean ratio of an inner node's samples to its children's."""
    own = tree.join(voxel_counts, ["level", "key"], "left").select(
        "level", "key", "is_leaf", F.when(F.col("is_leaf"), F.col("n")).otherwise(F.col("num_voxels")).alias("samples")
    )
    below = own.where("level > 0").groupBy((F.col("level") - 1).alias("level"), F.shiftright("key", 3).alias("key")).agg(F.sum("samples").alias("below"))
    ratio = own.where("NOT is_leaf AND samples > 0").join(below, ["level", "key"]).agg(F.round(F.avg(F.col("samples") / F.col("below")), 6).alias("mean_reduction"))
    counts = own.agg(
        F.count("*").alias("nodes"),
        F.count_if("is_leaf").alias("leaves"),
        F.count_if(~F.col("is_leaf")).alias("inner"),
        F.round(F.avg(F.when(F.col("is_leaf"), F.col("samples"))), 6).alias("mean_leaf"),
        F.round(F.avg(F.when(~F.col("is_leaf"), F.col("samples"))), 6).alias("mean_inner"),
    )
    return counts.crossJoin(F.broadcast(ratio))  # one row each


def median_run(runs: DataFrame, group: str, value: str, run: str) -> DataFrame:
    """Of each group the row with the upper median of ``value``, and the group's size.

    All rows are ranked together, so a group of any size is spread over range partitions; the median's
    rank follows from where its group starts, and the join back has one row for each rank.
    """
    rows = ranked(runs, group, value, run, name="_rank")
    groups = rows.groupBy(group).agg(F.min("_rank").alias("_first"), F.count("*").alias("runs"))
    return rows.join(groups.select((F.col("_first") + F.floor(F.col("runs") / 2)).alias("_rank"), "runs"), "_rank").drop("_rank")


def timing_report(rows: DataFrame, label: str, seconds: str) -> DataFrame:
    """Summed durations by label with their share in percent of the total."""
    by = rows.groupBy(label).agg(F.sum(seconds).alias("total"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.count("*").alias("n"))
    total = rows.agg(F.sum(seconds).alias("_all"))
    return by.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100 * F.try_divide("total", "_all"), 6)).drop("_all")  # one row


def distinct_check(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Distinct values by group, and whether there is just one."""
    out = rows.groupBy(group).agg(F.count_distinct(value).alias("distinct"), F.count("*").alias("n"))
    return out.withColumn("single", F.col("distinct") == 1)
