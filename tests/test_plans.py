"""Plans that stay cheap as tables grow: what is generated, shuffled and written."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from octaspark import staging
from octaspark.operators import octree, ordering, view, voxelize
from octaspark.operators.octree import SMALL
from octaspark.plans import queries as plans
from octaspark.sources import hierarchy, las
from octaspark.sources.tables import event_points
from octaspark.streaming.incremental import replay

#: Java doesn't compile longer methods to machine code.
LONGEST_METHOD = 8000


def longest_method(df) -> int:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))))


def some_nodes(spark):
    return spark.range(1, 9).select(F.lit(1).alias("level"), (F.col("id") - 1).alias("key"), F.col("id").alias("n"), (F.col("id") > 3).alias("is_leaf"))


def test_join_of_points_with_leaves_compiles(spark, sf):
    """F1"""
    indexed = octree.with_fine_index(plans.skewed(spark, sf), SMALL)
    cells = octree.cell_counts(indexed).localCheckpoint()
    nodes = octree.nodes(cells, SMALL).localCheckpoint()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert longest_method(octree.with_leaf(indexed, SMALL, cells, nodes).select("ix", "iy", "iz", "r", "g", "b", "leaf_level")) < LONGEST_METHOD
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_visible_nodes_are_found_once_for_all_levels(spark):
    """F1"""
    voxels = spark.createDataFrame([(0, 1, 1, 1), (1, 1, 1, 1)], "level int, vx long, vy long, vz long")
    nodes = view.with_visibility(octree.describe(some_nodes(spark)), plans.CAMERA)
    plan = view.unsuppressed(voxels, nodes, SMALL.grid_bits)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan  # nodes come from the table that was written


def test_rays_compile(spark, sf):
    """F16"""
    assert longest_method(plans.QUERIES["ray_through_frustum"](spark, sf)) < LONGEST_METHOD


def written_by(monkeypatch, run) -> list[tuple[list[str], bool]]:
    """Columns of the tables that ranking writes while ``run`` runs, and whether it adds columns to order by."""
    seen = []

    def spy(df, name, *by):
        seen.append((df.columns, "_o0" in df._jdf.queryExecution().analyzed().toString()))
        return staging.written(df, name, *by)

    monkeypatch.setattr(ordering, "written", spy)
    run()
    return seen


def test_ranks_shuffle_named_columns_once(spark, monkeypatch):
    """F12"""
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("v"), "id")
    seen = written_by(monkeypatch, lambda: ordering.ranked(df, "v", "id").count())
    assert [added for _, added in seen] == [False]
    plan = ordering.ranked(df, F.col("v") % 10, "v", "id")
    assert [r["rank"] for r in plan.orderBy(F.col("v") % 10, "v").collect()] == list(range(100))


def test_places_within_batches_need_no_coordinates(spark, sf, monkeypatch):
    """F12"""
    seen = written_by(monkeypatch, lambda: plans.QUERIES["batch_morton_order"](spark, sf))
    assert len(seen) == 2 and not any({"x", "y", "z", "r", "g", "b"} & set(columns) for columns, _ in seen)


def test_headers_alone_go_to_python(spark, sf):
    """F11"""
    files = las.to_las_files(plans.uniform(spark, sf), scale=1e-6)
    assert "substring(content" in las.header_rows(files, "name")._jdf.queryExecution().analyzed().toString()


def test_records_of_many_leaves_are_decoded_in_bounded_runs():
    """F7"""
    assert list(hierarchy._runs(np.cumsum([3, 3, 3, 20, 1, 1]), 7)) == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_stream_input_is_written_by_many_tasks(spark, sf):
    """F6"""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        tree = replay(event_points(spark, sf), SMALL)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(n.endswith(".parquet") for n in staging.names_in(spark, f"{tree.folder}/in")) == 10
    assert len(staging.names_in(spark, f"{tree.folder}/state")) == 4


@pytest.mark.parametrize("query", ["export_samples", "voxels_random", "voxels_neighborhood"])
def test_points_meet_in_voxels_before_they_are_written(spark, sf, monkeypatch, query):
    """F3 F5 F8 F9 F10"""
    seen = []

    def spy(df, name, *by):
        seen.append((name, df.columns))
        return staging.written(df, name, *by)

    monkeypatch.setattr(voxelize, "written", spy)
    plans.QUERIES[query](spark, sf)
    assert seen[0][0] == "met" and not any({"ix", "iy", "iz"} & set(columns) for _, columns in seen)


def test_rows_are_shuffled_once_and_blocks_alone_for_the_second_order(spark, sf, monkeypatch):
    """F15"""
    seen = written_by(monkeypatch, lambda: plans.QUERIES["block_shuffle"](spark, sf))
    assert sorted("k1" in columns for columns, _ in seen) == [False, True]


def test_leaf_and_code_are_one_number_to_sort_by(spark, sf, monkeypatch):
    """F13"""
    seen = written_by(monkeypatch, lambda: plans.QUERIES["node_morton_order"](spark, sf))
    assert [set(columns) & {"leaf_level", "leaf_key", "code"} for columns, _ in seen if "k1" in columns] == [{"code"}]


def test_nodes_are_written_not_computed_twice_by_a_checkpoint(spark, sf):
    """F17"""
    assert plans.tree_of(spark, sf).nodes.inputFiles()
