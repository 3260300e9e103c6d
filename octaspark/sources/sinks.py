"""Writers: an octree with its metadata, points in Morton order, voxels as CSV, run records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octaspark.operators.layout import with_morton
from octaspark.sources.las import write_las


def write_octree(nodes: DataFrame, points: DataFrame, voxels: DataFrame, path: str) -> None:
    """Nodes, leaf points and voxels as Parquet, with a row of metadata as JSON.

    Points are range-partitioned by leaf, so a node's points lie together and a reader prunes files
    and row groups by level and key.
    """
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    clustered = points.repartitionByRange("leaf_level", "leaf_key").sortWithinPartitions("leaf_level", "leaf_key")
    clustered.write.mode("overwrite").parquet(f"{path}/points")
    voxels.write.mode("overwrite").partitionBy("level").parquet(f"{path}/voxels")
    box = [f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)]
    points.agg(F.count("*").alias("points"), *box).write.mode("overwrite").json(f"{path}/metadata")


def write_morton_sorted(points: DataFrame, path: str) -> None:
    with_morton(points).repartitionByRange("code").sortWithinPartitions("code").write.mode("overwrite").parquet(path)


def write_morton_sorted_las(points: DataFrame, path: str, **options) -> None:
    """LAS files whose points follow the Morton order, from file to file and within each."""
    write_las(with_morton(points).repartitionByRange("code").sortWithinPartitions("code"), path, **options)


def node_lines(described: DataFrame) -> DataFrame:
    """One line of comma-separated values for each node."""
    cols = ["name", "level", "n", "child_mask", "ix", "iy", "iz"]
    return described.select(F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("line"))


def write_node_csv(described: DataFrame, path: str) -> None:
    node_lines(described).write.mode("overwrite").text(path)


def write_voxel_csv(voxels: DataFrame, path: str) -> None:
    voxels.select(*[F.col(f"v{a}") for a in "xyz"], "r", "g", "b").write.mode("overwrite").csv(path)


def write_run_records(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)
