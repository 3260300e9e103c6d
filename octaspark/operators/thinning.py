"""Thinning and adaptive tiles: Poisson-disk sampling and refinement of a height field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octaspark.staging import discard, written


def poisson_disk(points: DataFrame, key: str, spacing: float) -> DataFrame:
    """``key``, x, y and ``accepted`` of all points: greedy blue-noise thinning of the x, y plane in the order of ``key``.

    The result is that of taking points one by one and accepting those with no accepted one nearer
    than ``spacing``. It is found in rounds: of the points that are still open, those that
    come first among all open ones within the spacing are accepted, and the others near them rejected.
    Cells are so small that a cell's points all exclude each other, so only each cell's first point can be
    accepted; an open point meets at most those of the cells around it, however crowded they are.
    Keys are unique. Rounds follow the longest chain of points that wait for each other, which is short unless
    the key runs along the plane.
    """
    size, square = spacing * 0.7071, spacing * spacing
    todo = points.select(F.col(key).alias("k"), "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    todo = written(todo, "open")
    everything, accepted = todo, []
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])).alias("o")
    while not todo.isEmpty():
        first = todo.groupBy("cx", "cy").agg(F.min(F.struct("k", "x", "y")).alias("p")).select("cx", "cy", F.col("p.k").alias("pk"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))
        reach = todo.select("k", "x", "y", "cx", "cy", around).select("k", "x", "y", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
        dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
        near = written(reach.join(first, ["cx", "cy"]).where((F.col("k") != F.col("pk")) & (dx * dx + dy * dy < square)).select("k", "pk"), "near")
        new = written(first.select("pk").join(near.where("k < pk").select("pk").distinct(), "pk", "left_anti"), "accepted")
        gone = near.join(new, "pk").select("k").unionByName(new.select(F.col("pk").alias("k")))
        spent, todo = todo, written(todo.join(gone, "k", "left_anti").select(todo.columns), "open")
        discard(near, *([] if spent is everything else [spent]))
        accepted.append(new)
    if not accepted:
        return everything.select(F.col("k").alias(key), "x", "y", F.lit(False).alias("accepted"))
    kept = accepted[0]
    for more in accepted[1:]:
        kept = kept.unionByName(more)
    out = everything.join(kept.select(F.col("pk").alias("k"), F.lit(True).alias("accepted")), "k", "left")
    return out.select(F.col("k").alias(key), "x", "y", F.coalesce("accepted", F.lit(False)).alias("accepted"))


#: Points whose spacings differ by less than this factor share a class of cells.
CLASS_RATIO = 1.41


def growing_disk(points: DataFrame, key: str, centre: Sequence[float], base: float, growth: float = 8.0) -> DataFrame:
    """``key``, x, y, d and ``accepted`` of all points: greedy thinning from the centre outwards, with a spacing that grows.

    Points are taken by their distance ``d`` to the centre (of equal ones by key). A point is accepted unless an
    accepted one lies nearer to it than that one's own spacing, ``base + d / growth``.

    Points of like spacing share a class, with cells so small that a cell's points exclude each other; only a
    cell's first open point can be accepted. A point that excludes another has a spacing of the same class or the one
    below, so a first point looks for open ones before it in the 25 cells around of each of two classes, and an accepted
    one rejects those after it in the 25 cells around of its class and the one above. Rounds follow the longest chain of
    points that wait for each other: from the centre out, about the number of rings of spacings.
    """
    if growth < 1 / (CLASS_RATIO - 1):
        raise ValueError(f"a growth of less than {1 / (CLASS_RATIO - 1):.2f} spans more than two classes")
    square = [(F.col(a) - F.lit(float(c))) * (F.col(a) - F.lit(float(c))) for a, c in zip("xy", centre)]
    rows = points.select(F.col(key).alias("k"), "x", "y", F.sqrt(square[0] + square[1]).alias("d")).withColumn("s", F.lit(float(base)) + F.col("d") / F.lit(float(growth)))
    rows = rows.withColumn("c", F.floor(F.log(F.col("s") / F.lit(float(base))) / F.log(F.lit(CLASS_RATIO))).cast("int"))
    edge = lambda c: F.lit(0.7071 * base) * F.pow(F.lit(CLASS_RATIO), c)
    everything = written(rows.withColumns({"cx": F.floor(F.col("x") / edge(F.col("c"))), "cy": F.floor(F.col("y") / edge(F.col("c")))}), "open")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])).alias("o")
    todo, accepted = everything, []

    def spread(some: DataFrame, step: int) -> DataFrame:
        """Each of ``some`` in the cells around it, of its own class and the one a step away."""
        both = some.select(*[F.col(n).alias(f"p{n}") for n in "kxyds"], F.explode(F.array("c", F.col("c") + step)).alias("c")).where("c >= 0")
        at = both.withColumns({"bx": F.floor(F.col("px") / edge(F.col("c"))), "by": F.floor(F.col("py") / edge(F.col("c")))})
        return at.select("*", around).withColumns({"cx": F.col("bx") + F.col("o.i"), "cy": F.col("by") + F.col("o.j")}).drop("bx", "by", "o")

    apart = F.sqrt((F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y")))
    before = F.struct(F.col("d").alias("d"), F.col("k").alias("k")) < F.struct(F.col("pd").alias("d"), F.col("pk").alias("k"))
    after = F.struct(F.col("d").alias("d"), F.col("k").alias("k")) > F.struct(F.col("pd").alias("d"), F.col("pk").alias("k"))
    while not todo.isEmpty():
        first = todo.groupBy("c", "cx", "cy").agg(F.min(F.struct("d", "k", "x", "y", "s")).alias("p")).select("c", "cx", "cy", "p.*")
        waits = spread(first, -1).join(todo, ["c", "cx", "cy"]).where(before & (apart < F.col("s"))).select(F.col("pk").alias("k")).distinct()
        new = written(first.join(waits, "k", "left_anti"), "accepted")
        gone = spread(new, 1).join(todo, ["c", "cx", "cy"]).where(after & (apart < F.col("ps"))).select("k").unionByName(new.select("k")).distinct()
        spent, todo = todo, written(todo.join(gone, "k", "left_anti").select(everything.columns), "open")
        discard(*([] if spent is everything else [spent]))
        accepted.append(new.select("k"))
    kept = everything.select("k").limit(0) if not accepted else accepted[0]
    for more in accepted[1:]:
        kept = kept.unionByName(more)
    out = everything.join(kept.withColumn("accepted", F.lit(True)), "k", "left")
    return out.select(F.col("k").alias(key), "x", "y", "d", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def height_field(uv: DataFrame) -> DataFrame:
    """Adds the procedural height of each uv position."""
    dist = F.sqrt((F.col("u") - 0.5) * (F.col("u") - 0.5) + (F.col("v") - 0.5) * (F.col("v") - 0.5))
    ripple = F.lit(0.01) * F.cos(350 * F.col("u")) * F.sin(350 * F.col("v"))
    return uv.withColumn("dist", dist).withColumn("h", F.cos(8 * F.col("dist")) * (F.lit(0.4) - F.lit(0.5) * F.col("dist")) + ripple)


def height_tiles(samples: DataFrame, tiles: int, steps: Sequence[float]) -> DataFrame:
    """Tiles split into 1, 4, 16 or 64 by the relief within them."""
    at = {f"t{n}": F.least(F.floor(F.col(c) * tiles), F.lit(tiles - 1)).cast("long") for n, c in zip("xy", "uv")}
    by = samples.withColumns(at).groupBy("tx", "ty").agg(F.count("*").alias("n"), (F.max("h") - F.min("h")).alias("relief"))
    side = F.lit(2 ** len(steps))
    for k in range(len(steps) - 1, -1, -1):
        side = F.when(F.col("relief") < steps[k], F.lit(2**k)).otherwise(side)
    out = by.withColumn("side", side)
    sub = F.explode(F.sequence(F.lit(0), F.col("side") * F.col("side") - 1)).alias("i")
    return out.select("tx", "ty", "n", "side", sub).select("tx", "ty", "n", "side", (F.col("i") % F.col("side")).cast("long").alias("sx"), F.floor(F.col("i") / F.col("side")).cast("long").alias("sy"))
