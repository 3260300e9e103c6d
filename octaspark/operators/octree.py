"""Octree over points: cell counts, count pyramid, leaves, nodes and point assignment.

All levels derive from one fine index per axis by shifting. Counting is one aggregation
at the deepest level; everything about the tree's shape is computed on that table and
its roll-up, which has at most (depth + 1) rows per occupied finest cell. Points are
touched twice: once for counting and once for the join that tells their leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octaspark.functions.geometry import grid_index, morton, morton_inverse, node_name
from octaspark.operators.ordering import running_sum


@dataclass(frozen=True)
class TreeSpec:
    """``main_depth``: levels of the main grid; ``max_depth``: deepest level; ``capacity``: points
    a node may hold; ``grid_bits``: log2 of the voxel grid of a node."""

    main_depth: int = 8
    max_depth: int = 12
    capacity: int = 50_000
    grid_bits: int = 7

    @property
    def fine_bits(self) -> int:
        return self.max_depth + self.grid_bits


SMALL = TreeSpec(4, 8, 1000, 5)


def with_fine_index(points: DataFrame, spec: TreeSpec) -> DataFrame:
    """Adds ix, iy, iz on the finest voxel grid and the Morton key of the deepest node cell."""
    out = points.withColumns({f"i{a}": grid_index(F.col(a), spec.fine_bits) for a in "xyz"})
    return out.withColumn("key", morton(*[F.shiftright(f"i{a}", spec.grid_bits) for a in "xyz"]))


def grid_cell_counts(points: DataFrame, bits: int) -> DataFrame:
    """Points per occupied cell of a 2**bits grid."""
    cells = points.select(*[grid_index(F.col(a), bits).alias(f"i{a}") for a in "xyz"])
    return cells.groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"))


def large_cells(points: DataFrame, bits: int, capacity: int) -> DataFrame:
    return grid_cell_counts(points, bits).where(F.col("n") > capacity)


def subgrid_counts(points: DataFrame, spec: TreeSpec) -> DataFrame:
    """Counts at the deepest level inside cells of the main grid that hold too many points."""
    fine = grid_cell_counts(points, spec.max_depth)
    up = spec.max_depth - spec.main_depth
    main = fine.groupBy(*[F.shiftright(f"i{a}", up).alias(f"m{a}") for a in "xyz"]).agg(F.sum("n").alias("total")).where(F.col("total") > spec.capacity)
    return fine.withColumns({f"m{a}": F.shiftright(f"i{a}", up) for a in "xyz"}).join(main, ["mx", "my", "mz"], "left_semi").select("ix", "iy", "iz", "n")


def cell_counts(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("key").agg(F.count("*").alias("n"))


def pyramid(cells: DataFrame, spec: TreeSpec) -> DataFrame:
    """(level, key, n) of all occupied cells of all levels."""
    return _roll_up(cells, spec).groupBy("level", "key").agg(F.sum("n").alias("n"))


def _roll_up(cells: DataFrame, spec: TreeSpec) -> DataFrame:
    level = F.explode(F.sequence(F.lit(0), F.lit(spec.max_depth))).alias("level")
    rows = cells.select(level, F.col("key").alias("fine"), "n")
    return rows.select("level", F.expr(f"shiftright(fine, 3 * ({spec.max_depth} - level))").alias("key"), "n", "fine")


def _splits(spec: TreeSpec) -> Column:
    """Whether a node's own count splits it: more than the capacity where the main grid ends, as
    much elsewhere, never at the deepest level."""
    level, n = F.col("level"), F.col("n")
    enough = F.when(level == spec.main_depth, n > spec.capacity).otherwise(n >= spec.capacity)
    return (level < spec.max_depth) & enough


def nodes(cells: DataFrame, spec: TreeSpec) -> DataFrame:
    """level, key, n and is_leaf of every node: inner nodes, and leaves below inner nodes.

    A cloud with too few points to split is one leaf at level 0.
    """
    counts = pyramid(cells, spec).withColumn("splits", _splits(spec))
    # Below the main grid a node exists only if its main-grid ancestor split.
    up = F.expr(f"CASE WHEN level > {spec.main_depth} THEN shiftright(key, 3 * (level - {spec.main_depth})) END")
    main = counts.where((F.col("level") == spec.main_depth) & F.col("splits")).select(F.col("key").alias("main"))
    shallow = counts.where(F.col("level") <= spec.main_depth)
    deep = counts.where(F.col("level") > spec.main_depth).withColumn("main", up).join(main, "main", "left_semi").drop("main")
    known = shallow.unionByName(deep)
    inner = known.where("splits").select((F.col("level") + 1).alias("level"), F.col("key").alias("parent"))
    below = known.withColumn("parent", F.shiftright("key", 3)).join(inner, ["level", "parent"], "left_semi").drop("parent")
    root = known.where("level = 0")
    return root.unionByName(below.select(root.columns)).select("level", "key", "n", (~F.col("splits")).alias("is_leaf"))


def leaves(cells: DataFrame, spec: TreeSpec) -> DataFrame:
    return nodes(cells, spec).where("is_leaf").select("level", "key", "n")


def with_leaf(indexed: DataFrame, spec: TreeSpec, cells: DataFrame | None = None, tree: DataFrame | None = None) -> DataFrame:
    """Adds leaf_level and leaf_key to every point.

    Each finest cell lies in one leaf; the points then join their cell. Equal keys are
    counted before, and the join is one that AQE splits where a cell is crowded.
    """
    cells = cell_counts(indexed) if cells is None else cells
    tree = nodes(cells, spec) if tree is None else tree
    return at_home(indexed, homes(cells, spec, tree))


def homes(cells: DataFrame, spec: TreeSpec, tree: DataFrame) -> DataFrame:
    """cell, leaf_level and leaf_key: the leaf of each finest cell."""
    found = tree.where("is_leaf").select("level", "key")
    return _roll_up(cells, spec).join(found, ["level", "key"]).select(F.col("fine").alias("cell"), F.col("level").alias("leaf_level"), F.col("key").alias("leaf_key"))


def at_home(indexed: DataFrame, home: DataFrame) -> DataFrame:
    """Points joined with ``homes``.

    The points' side of the join is never null, else Spark would first filter by a copy of the whole key
    expression, in which each coordinate is computed again for every use.
    """
    rows = indexed.withColumn("_at", F.coalesce("key", F.lit(-1).cast("long")))
    return rows.join(home.withColumnRenamed("cell", "_at"), "_at").select("key", *(c for c in indexed.columns if c != "key"), "leaf_level", "leaf_key")


def describe(tree: DataFrame, max_depth: int = 12) -> DataFrame:
    """Adds cell coordinates, bounding box (unit cube), name and child mask to nodes."""
    ix, iy, iz = morton_inverse(F.col("key"), max_depth)
    size = F.lit(1.0) / F.pow(F.lit(2.0), F.col("level"))
    children = tree.where("level > 0").groupBy((F.col("level") - 1).alias("level"), F.shiftright("key", 3).alias("key")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(key & 7 AS int))")).cast("int").alias("child_mask")
    )
    out = tree.join(children, ["level", "key"], "left").withColumn("child_mask", F.coalesce("child_mask", F.lit(0)))
    out = out.withColumns({"ix": ix, "iy": iy, "iz": iz, "size": size, "name": node_name(F.col("level"), F.col("key"))})
    return out.withColumns({f"min_{a}": F.col(f"i{a}") * F.col("size") for a in "xyz"} | {f"max_{a}": (F.col(f"i{a}") + 1) * F.col("size") for a in "xyz"})


def leaf_slices(tree: DataFrame) -> DataFrame:
    """Offset of each leaf's points in the order of (level, key)."""
    return running_sum(tree.where("is_leaf").select("level", "key", "n"), F.col("n"), "level", "key", name="slice_offset")
