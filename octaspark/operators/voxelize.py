"""Voxel samples of inner nodes, level by level, under selectable strategies.

A node at level L samples its children on its own grid: leaf children give their
points, inner children their voxels. Points meet in their own voxels in one aggregation for all
levels. Only the loop over levels runs on the driver; each level is one aggregation over a
table that shrinks geometrically.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octaspark.functions.geometry import morton_inverse
from octaspark.operators.octree import TreeSpec
from octaspark.sources.tables import ORDER
from octaspark.staging import written

STRATEGIES = ("average", "first", "random", "central", "neighborhood")
CELL = ["vx", "vy", "vz"]
#: Offsets of a cell's neighbourhood.
TAPS = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)]
#: On each axis a sample reaches its own cell (0) and that on its nearer side (1).
REACHED = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]


def priority() -> Column:
    """A pseudo-random number below 2**32 from a point's order columns, in plain arithmetic."""
    mixed = (F.col("k1") % 65521 * 40503 + F.col("k2") % 65521 * 30011 + F.col("k3") % 65521 * 20021 + F.col("k4") * 7919 + F.col("k5") * 104729) % 4294967296
    return (mixed % 2147483647 * 48271 + 11) % 4294967296


PRIORITY_SQL = "((((k1 % 65521 * 40503 + k2 % 65521 * 30011 + k3 % 65521 * 20021 + k4 * 7919 + k5 * 104729) % 4294967296) % 2147483647 * 48271 + 11) % 4294967296)"


def occupancy(points: DataFrame, spec: TreeSpec) -> DataFrame:
    """Voxels per inner node in closed form: distinct cells of its grid below it.

    Points meet in the cells of their leaf's parent first; only those cells are halved level by level.
    """
    at = lambda level: [F.expr(f"shiftright(i{a}, {spec.max_depth} - ({level}))").alias(f"v{a}") for a in "xyz"]
    own = points.where("leaf_level > 0").select((F.col("leaf_level") - 1).alias("own"), *at("leaf_level - 1")).distinct()
    rows = own.select("own", *CELL, F.explode(F.sequence(F.lit(0), F.col("own"))).alias("level"))
    cells = rows.select("level", *[F.expr(f"shiftright({c}, own - level)").alias(c) for c in CELL]).distinct()
    node = cells.select("level", *[F.shiftright(f"v{a}", spec.grid_bits).alias(f"n{a}") for a in "xyz"])
    return node.groupBy("level", "nx", "ny", "nz").agg(F.count("*").alias("num_voxels"))


def _pick(samples: DataFrame, by: list[Column], keep: list[str]) -> DataFrame:
    """Of each cell the sample that comes first by ``by``."""
    chosen = F.min_by(F.struct(*keep), F.struct(*by)).alias("s")
    return samples.groupBy(*CELL).agg(chosen, F.count("*").alias("samples")).select(*CELL, "s.*", "samples")


def _average(samples: DataFrame) -> DataFrame:
    mean = [F.floor(F.sum(c) / F.count("*")).cast("int").alias(c) for c in "rgb"]
    return samples.groupBy(*CELL).agg(*mean, F.count("*").alias("samples"))


def linear_weight(d2: Column) -> Column:
    """1 to 100 by distance."""
    return F.floor(F.least(F.greatest(100 * (1 - F.sqrt(d2)), F.lit(1.0)), F.lit(100.0)))


def exponential_weight(d2: Column) -> Column:
    """exp(-3.5 d2), in ten-thousandths."""
    return F.floor(10_000 * F.exp(-3.5 * d2))


def _taps(samples: DataFrame, bits: int, weight=linear_weight, *keep: str) -> DataFrame:
    """``keep``, cell (c*), weight, weighted colours and ``own`` of what samples give to the 27 cells around, on nodes of 2**bits cells an axis.

    Of the 27, a sample reaches its own and the nearer one on each axis: 8 taps. Cells beyond
    the node's border are clamped to it, so their tap falls on the sample's own cell once more; such taps
    are counted as a factor. Taps without weight go before the shuffle; ``own`` is 1 for the tap on the
    sample's own cell, so the occupied cells need no second pass over the samples.
    """
    mask = (1 << bits) - 1
    out_of = lambda c, a: (c < F.col(f"low_{a}")) | (c > F.col(f"low_{a}") + mask)
    rows = samples.withColumns(
        {f"low_{a}": F.col(f"v{a}").bitwiseAND(F.lit(~mask)) for a in "xyz"} | {f"side_{a}": F.when(F.col(f"g{a}") - F.col(f"v{a}") < 0.5, F.lit(-1)).otherwise(F.lit(1)) for a in "xyz"}
    )
    rows = rows.withColumns(
        {f"out_{a}": out_of(F.col(f"v{a}") + F.col(f"side_{a}"), a) for a in "xyz"}
        | {f"far_{a}": out_of(F.col(f"v{a}") - F.col(f"side_{a}"), a) for a in "xyz"}
    )
    taps = F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip("xyz", t)]) for t in REACHED])).alias("t")
    rows = rows.select("*", taps).where(" AND ".join(f"NOT (t.{a} = 1 AND out_{a})" for a in "xyz"))
    rows = rows.withColumns({f"c{a}": F.col(f"v{a}") + F.col(f"t.{a}") * F.col(f"side_{a}") for a in "xyz"})
    square = sum(((F.col(f"g{a}") - F.col(f"c{a}") - 0.5) * (F.col(f"g{a}") - F.col(f"c{a}") - 0.5) for a in "xyz"), F.lit(0.0))
    times = F.lit(1)
    for a in "xyz":
        times = times * F.when(F.col(f"t.{a}") == 0, 1 + F.col(f"out_{a}").cast("int") + F.col(f"far_{a}").cast("int")).otherwise(F.lit(1))
    own = (F.col("t.x") == 0) & (F.col("t.y") == 0) & (F.col("t.z") == 0)
    rows = rows.select(*keep, "cx", "cy", "cz", "r", "g", "b", square.alias("d2"), own.cast("long").alias("own"), times.alias("times")).where("d2 < 1")
    rows = rows.withColumn("w", weight(F.col("d2")) * F.col("times"))
    return rows.select(*keep, "cx", "cy", "cz", "w", *[(F.col("w") * F.col(c)).alias(c) for c in "rgb"], "own")


def _neighborhood(samples: DataFrame, bits: int, weight=linear_weight) -> DataFrame:
    """Weighted by distance over the 27 cells around, of which only occupied ones count."""
    sums = [F.floor(F.sum(c) / F.sum("w")).cast("int").alias(c) for c in "rgb"]
    out = _taps(samples, bits, weight).groupBy("cx", "cy", "cz").agg(*sums, F.sum("own").alias("samples")).where("samples > 0")
    return out.select(*[F.col(f"c{a}").alias(f"v{a}") for a in "xyz"], "r", "g", "b", "samples")


# Voxels of a tree. Cells travel as one number, which hash tables and sorts take at its cheapest: v* on the
# grid of a level, below the leaf's level where that is told.


def _packed(cell: list[Column], bits: int, level: Column | None = None) -> Column:
    x, y, z = (c.cast("long") for c in cell)
    out = F.shiftleft(x, 2 * bits).bitwiseOR(F.shiftleft(y, bits)).bitwiseOR(z)
    return out if level is None else out.bitwiseOR(F.shiftleft(level.cast("long"), 3 * bits))


def _unpacked(cell: str, bits: int) -> list[Column]:
    return [F.shiftright(cell, k * bits).bitwiseAND(F.lit((1 << bits) - 1)) for k in (2, 1, 0)]


def _offset(axes: str = "xyz") -> Column:
    """Squared distance of a sample to the middle of its cell."""
    return sum(((F.col(f"g{a}") - F.col(f"v{a}") - 0.5) * (F.col(f"g{a}") - F.col(f"v{a}") - 0.5) for a in axes), F.lit(0.0))


#: What a sample is first by, least first; fields of the struct that travels.
_FIRST_BY = {"first": list(ORDER), "random": ["late", *ORDER], "central": ["d2", *ORDER]}


def _terms(strategy: str, samples: DataFrame, spec: TreeSpec, *keep: str) -> DataFrame:
    """``keep``, v* and what each sample adds to its cell (or to the cells around): columns that ``_merged`` puts together."""
    if strategy == "neighborhood":
        return _taps(samples, spec.grid_bits, linear_weight, *keep).withColumnsRenamed({f"c{a}": f"v{a}" for a in "xyz"}).withColumnRenamed("own", "n")
    one = F.lit(1).cast("long").alias("n")
    if strategy == "average":
        return samples.select(*keep, *CELL, *[F.col(c).cast("long").alias(c) for c in "rgb"], one)
    if strategy == "central":
        samples = samples.withColumn("d2", _offset())
    return samples.select(*keep, *CELL, F.struct(*_FIRST_BY[strategy], "r", "g", "b").alias("s"), one)


def _merged(strategy: str, terms: DataFrame) -> DataFrame:
    """``cell`` and the terms of each cell put together; what comes out can be put together again."""
    sums = {"average": ["r", "g", "b"], "neighborhood": ["w", "r", "g", "b"]}.get(strategy, [])
    found = [F.sum(c).alias(c) for c in sums] or [F.min("s").alias("s")]
    return terms.groupBy("cell").agg(*found, F.sum("n").alias("n"))


def _resolved(strategy: str, merged: DataFrame) -> DataFrame:
    """cell, r, g, b, samples of each voxel, and what the order of samples needs."""
    if strategy == "average":
        return merged.select("cell", *[F.floor(F.col(c) / F.col("n")).cast("int").alias(c) for c in "rgb"], F.col("n").alias("samples"))
    if strategy == "neighborhood":
        return merged.where("n > 0").select("cell", *[F.floor(F.col(c) / F.col("w")).cast("int").alias(c) for c in "rgb"], F.col("n").alias("samples"))
    keep = [c for c in _FIRST_BY[strategy] if c != "d2"]
    return merged.select("cell", *[F.col(f"s.{c}").alias(c) for c in ("r", "g", "b", *keep)], F.col("n").alias("samples"))


def voxels(points: DataFrame, spec: TreeSpec, strategy: str = "average") -> DataFrame:
    """level, vx, vy, vz (cell on the level's whole grid), r, g, b and samples of all voxels.

    ``points`` come from ``octree.with_leaf``. Whatever their leaf's level, they meet in the voxels of their leaf's parent in one
    aggregation, whose partial sums (or first samples) are written once, in folders by leaf level; points themselves are
    neither written nor sorted by level. Each level puts those of its own leaves together with the voxels below and is written
    once: as one plan the levels took three times as long, since the levels below were computed again. Levels below which no leaf lies are left out.
    """
    bits = spec.max_depth - 1 + spec.grid_bits
    up = F.expr(f"{spec.max_depth + 1} - leaf_level").cast("int")
    columns = {f"v{a}": F.call_function("shiftright", F.col(f"i{a}"), up) for a in "xyz"}
    if strategy == "random":
        columns["late"] = -priority()
    if strategy in ("central", "neighborhood"):
        columns |= {f"g{a}": F.col(a) * F.expr(f"cast(shiftleft(1L, leaf_level + {spec.grid_bits - 1}) AS double)") for a in "xyz"}
    carry = [c for c in _FIRST_BY.get(strategy, ()) if c != "d2"]
    samples = points.where("leaf_level > 0").withColumns(columns).select("leaf_level", *columns, *(c for c in ("r", "g", "b", *carry) if c not in columns))
    terms = _terms(strategy, samples, spec, "leaf_level")
    met = _merged(strategy, terms.withColumn("cell", _packed([F.col(c) for c in CELL], bits, F.col("leaf_level"))))
    met = met.withColumns({"leaf_level": F.shiftright("cell", 3 * bits).cast("int"), "cell": F.col("cell").bitwiseAND(F.lit((1 << 3 * bits) - 1))})
    met = written(met, "met", "leaf_level")
    deepest = met.agg(F.max("leaf_level")).first()[0] or 0  # one number, from the folders' names
    below: DataFrame | None = None
    done: list[DataFrame] = []
    for level in range(max(deepest, 1) - 1, -1, -1):
        found = met.where(F.col("leaf_level") == level + 1).drop("leaf_level")
        if below is not None:
            fine = below.withColumns(dict(zip(("ux", "uy", "uz"), _unpacked("cell", bits))))
            columns = {f"v{a}": F.shiftright(f"u{a}", 1) for a in "xyz"} | {f"g{a}": (F.col(f"u{a}") + 0.5) * 0.5 for a in "xyz"}
            terms = _terms(strategy, fine.withColumns(columns), spec)
            found = found.unionByName(terms.withColumn("cell", _packed([F.col(c) for c in CELL], bits)).drop(*CELL))
        below = written(_resolved(strategy, _merged(strategy, found)), "voxels")
        done.append(below.select(F.lit(level).alias("level"), *[c.alias(v) for v, c in zip(CELL, _unpacked("cell", bits))], "r", "g", "b", "samples"))
    return reduce(DataFrame.unionByName, done)


def average_from_sums(cells: DataFrame, spec: TreeSpec) -> DataFrame:
    """The voxels of strategy ``average`` from sums instead of points.

    ``cells`` has cell (Morton code on the grid of the deepest inner nodes), leaf_level, n and the sums r, g, b of the
    points in it. A cell lies in one leaf, and every voxel that a leaf's points meet is made of whole cells, so
    sums give what points would.
    """
    cells = written(cells.select("cell", "leaf_level", "n", "r", "g", "b"), "sums", "leaf_level")
    deepest = cells.agg(F.max("leaf_level")).first()[0] or 0  # one number, from the folders' names
    below: DataFrame | None = None
    done: list[DataFrame] = []
    for level in range(max(deepest, 1) - 1, -1, -1):
        own = cells.where(F.col("leaf_level") == level + 1)
        samples = own.select(F.shiftright("cell", 3 * (spec.max_depth - 1 - level)).alias("cell"), "n", "r", "g", "b")
        if below is not None:
            samples = samples.unionByName(below.select(F.shiftright("cell", 3).alias("cell"), F.lit(1).cast("long").alias("n"), *[F.col(c).cast("long").alias(c) for c in "rgb"]))
        mean = [F.floor(F.sum(c) / F.sum("n")).cast("int").alias(c) for c in "rgb"]
        below = written(samples.groupBy("cell").agg(*mean, F.sum("n").alias("samples")), "voxels")
        done.append(below.withColumn("level", F.lit(level)))
    at = morton_inverse(F.col("cell"), spec.max_depth - 1 + spec.grid_bits)
    return reduce(DataFrame.unionByName, done).select("level", *[c.alias(f"v{a}") for a, c in zip("xyz", at)], "r", "g", "b", "samples")


# Whole-cloud voxels: one grid over the unit cube, no tree.


def cloud_voxels(points: DataFrame, bits: int, method: str) -> DataFrame:
    """first, average, interpolated or smooth (exponentially weighted) colour per cell of a 2**bits grid."""
    n = float(1 << bits)
    base = points.select(*[F.least(F.floor(F.col(a) * n), F.lit((1 << bits) - 1)).cast("long").alias(f"v{a}") for a in "xyz"], *[(F.col(a) * n).alias(f"g{a}") for a in "xyz"], "r", "g", "b", *ORDER)
    if method == "first":
        return _pick(base, [F.col(k) for k in ORDER], ["r", "g", "b"])
    if method == "average":
        return _average(base)
    return _neighborhood(base, bits, exponential_weight if method == "smooth" else linear_weight)


def supported_voxels(points: DataFrame, bits: int, least: int) -> DataFrame:
    """Average colour of cells that hold more than ``least`` points."""
    return cloud_voxels(points, bits, "average").where(F.col("samples") > least)


def vertex_voxels(vertices: DataFrame, bits: int) -> DataFrame:
    """Cells of a 2**bits grid that hold vertices of the unit cube, with a mask of their filled octants."""
    n = 2 << bits
    fine = vertices.select(*[F.least(F.greatest(F.floor(F.col(a) * float(n)), F.lit(0)), F.lit(n - 1)).cast("long").alias(f"u{a}") for a in "xyz"])
    bit = F.expr("shiftleft(1, cast(((ux & 1) << 2) | ((uy & 1) << 1) | (uz & 1) AS int))")
    cells = fine.groupBy(*[F.shiftright(f"u{a}", 1).alias(f"v{a}") for a in "xyz"])
    return cells.agg(F.bit_or(bit).cast("int").alias("mask"), F.count("*").alias("n"))
