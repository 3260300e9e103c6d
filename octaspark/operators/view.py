"""Camera-driven queries: visible nodes, suppressed voxels, projected and resolved pixels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octaspark.functions.geometry import box_in_frustum, dot4, frustum_planes, project
from octaspark.staging import cut_lineage

BACKGROUND = (0x11, 0x22, 0x33)


def look_at(eye: Sequence[float], target: Sequence[float], fov: float, aspect: float, near: float = 0.01, far: float = 100.0) -> list[list[float]]:
    """View-projection matrix (rows) of a perspective camera with z up."""
    f = [t - e for t, e in zip(target, eye)]
    n = math.sqrt(sum(v * v for v in f))
    f = [v / n for v in f]
    s = [f[1], -f[0], 0.0]
    n = math.sqrt(sum(v * v for v in s))
    s = [v / n for v in s]
    u = [s[1] * f[2] - s[2] * f[1], s[2] * f[0] - s[0] * f[2], s[0] * f[1] - s[1] * f[0]]
    view = [[*r, -sum(a * b for a, b in zip(r, eye))] for r in (s, u, [-v for v in f])]
    k = 1 / math.tan(fov / 2)
    depth = [(far + near) / (near - far), 2 * far * near / (near - far)]
    return [
        [k / aspect * v for v in view[0]],
        [k * v for v in view[1]],
        [depth[0] * v + (depth[1] if i == 3 else 0.0) for i, v in enumerate(view[2])],
        [-v for v in view[2]],
    ]


@dataclass(frozen=True)
class Camera:
    matrix: tuple
    width: int
    height: int
    lod: float = 0.9

    @classmethod
    def at(cls, eye, target, width: int, height: int, fov: float = 1.0, lod: float = 0.9) -> Camera:
        return cls(tuple(map(tuple, look_at(eye, target, fov, width / height))), width, height, lod)

    @property
    def threshold(self) -> float:
        return 1 - 0.97 * self.lod


def with_visibility(described: DataFrame, camera: Camera) -> DataFrame:
    """Adds ``visible``: the root, and nodes in the frustum that are large enough on screen."""
    low, high = ([F.col(f"{e}_{a}") for a in "xyz"] for e in ("min", "max"))
    centre = [(a + b) * F.lit(0.5) for a, b in zip(low, high)]
    w = dot4(camera.matrix[3], *centre)
    large = F.col("size") / F.greatest(w, F.lit(0.1)) >= F.lit(camera.threshold)
    inside = box_in_frustum(frustum_planes(camera.matrix), low, high)
    return described.withColumn("visible", (F.col("level") == 0) | (inside & large))


def visible_totals(nodes: DataFrame, voxel_counts: DataFrame) -> DataFrame:
    """Visible nodes, points of visible leaves and voxels of visible inner nodes."""
    seen = nodes.where("visible").join(voxel_counts, ["level", "key"], "left")
    return seen.agg(
        F.count("*").alias("nodes"),
        F.coalesce(F.sum(F.when(F.col("is_leaf"), F.col("n"))), F.lit(0)).alias("points"),
        F.coalesce(F.sum("num_voxels"), F.lit(0)).alias("voxels"),
    )


def unsuppressed(voxels: DataFrame, nodes: DataFrame, grid_bits: int) -> DataFrame:
    """Voxels of visible nodes without those that lie in a visible child node.

    The visible nodes are written once: both joins are pushed below the union of levels, where each level would find them anew.
    """
    from octaspark.functions.geometry import morton

    key = morton(*[F.shiftright(f"v{a}", grid_bits) for a in "xyz"])
    child = morton(*[F.shiftright(f"v{a}", grid_bits - 1) for a in "xyz"])
    seen = cut_lineage(nodes.where("visible").select("level", "key"))
    own = voxels.withColumns({"key": key, "child": child}).join(seen, ["level", "key"], "left_semi")
    below = seen.select((F.col("level") - 1).alias("level"), F.col("key").alias("child"))
    return own.join(below, ["level", "child"], "left_anti").drop("child")


def fragments(points: DataFrame, camera: Camera, *keep: str) -> DataFrame:
    """Pixel and depth of every point on screen."""
    p = project(camera.matrix, F.col("x"), F.col("y"), F.col("z"), camera.width, camera.height)
    out = points.select(p["px"].alias("px"), p["py"].alias("py"), p["w"].alias("depth"), p["nx"].alias("_nx"), p["ny"].alias("_ny"), *keep)
    return out.where((F.col("depth") > 0) & (F.abs("_nx") <= 1) & (F.abs("_ny") <= 1)).drop("_nx", "_ny")


def depth_map(frags: DataFrame) -> DataFrame:
    return frags.groupBy("px", "py").agg(F.min("depth").alias("depth"), F.count("*").alias("n"))


def closest_colour(frags: DataFrame) -> DataFrame:
    """Colour of the nearest fragment of each pixel; of equal depths the least colour."""
    near = F.min(F.struct("depth", "r", "g", "b")).alias("s")
    return frags.groupBy("px", "py").agg(near).select("px", "py", F.col("s.depth").alias("depth"), *[F.col(f"s.{c}").alias(c) for c in "rgb"])


def accumulate(frags: DataFrame, tolerance: float = 1.01, slots: int = 8) -> DataFrame:
    """Colour sums and counts of fragments within one percent of their pixel's depth.

    A crowded pixel's fragments are dealt over ``slots`` before they meet its depth, which goes to each.
    """
    nearest = frags.groupBy("px", "py").agg(F.min("depth").alias("nearest")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    dealt = frags.withColumn("slot", F.pmod(F.xxhash64("depth", "r", "g", "b"), F.lit(slots)).cast("int"))
    close = dealt.join(nearest, ["px", "py", "slot"]).where(F.col("depth") < F.col("nearest") * F.lit(tolerance))
    return close.groupBy("px", "py").agg(*[F.sum(c).alias(f"sum_{c}") for c in "rgb"], F.count("*").alias("n"))


def resolve(sums: DataFrame, camera: Camera) -> DataFrame:
    """Weighted 3 x 3 average for pixels near a fragment; others are background."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("o")
    taps = sums.select("*", offsets)
    w = F.when((F.col("o.dx") == 0) & (F.col("o.dy") == 0), F.lit(1000)).otherwise(F.lit(1))
    moved = taps.select((F.col("px") + F.col("o.dx")).alias("px"), (F.col("py") + F.col("o.dy")).alias("py"), *[(F.col(f"sum_{c}") * w).alias(c) for c in "rgb"], (F.col("n") * w).alias("w"))
    moved = moved.where((F.col("px") >= 0) & (F.col("px") < camera.width) & (F.col("py") >= 0) & (F.col("py") < camera.height))
    return moved.groupBy("px", "py").agg(*[F.floor(F.sum(c) / F.sum("w")).cast("int").alias(c) for c in "rgb"])


def image(pixels: DataFrame, camera: Camera) -> DataFrame:
    """Every pixel of the image, with the background colour where nothing was drawn."""
    spark = pixels.sparkSession
    all_pixels = spark.range(camera.width * camera.height).select((F.col("id") % camera.width).cast("int").alias("px"), F.floor(F.col("id") / camera.width).cast("int").alias("py"))
    return all_pixels.join(pixels, ["px", "py"], "left").select("px", "py", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zip("rgb", BACKGROUND)])


def edl_response(depths: DataFrame, camera: Camera) -> DataFrame:
    """Eye-dome-lighting response from the four neighbours' depths."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("o")
    moved = depths.select("px", "py", "depth", offsets).select((F.col("px") + F.col("o.dx")).alias("px"), (F.col("py") + F.col("o.dy")).alias("py"), F.col("depth").alias("other"))
    near = depths.join(moved, ["px", "py"], "left")
    gap = F.greatest(F.log2("depth") - F.log2("other"), F.lit(0.0))
    return near.groupBy("px", "py").agg(F.round(F.coalesce(F.sum(gap), F.lit(0.0)) / 5, 6).alias("response"))


def dilate(depths: DataFrame, radius: int, weight: float, camera: Camera) -> DataFrame:
    """Sliding minimum of depth, along rows and then columns, within a circle of ``radius``; fills holes.

    Depth grows by ``weight`` times the square of the distance, as a share of the radius, on either axis.
    """

    def pass_(df: DataFrame, axis: str, size: int, keep: str, also: str | None = None) -> DataFrame:
        d = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("d")
        u = F.col("d") / F.lit(float(radius))
        rows = df.select("*", d).withColumns({axis: F.col(axis) + F.col("d"), "depth": F.col("depth") + F.col("depth") * u * u * F.lit(weight), keep: F.abs("d")})
        rows = rows.where((F.col(axis) >= 0) & (F.col(axis) < size))
        if also:
            rows = rows.where(F.col(keep) * F.col(keep) + F.col(also) * F.col(also) <= F.lit(1.05 * radius * radius))
        return rows.groupBy("px", "py").agg(F.min(F.struct("depth", keep)).alias("s")).select("px", "py", "s.*")

    across = pass_(depths.select("px", "py", "depth"), "px", camera.width, "dx")
    return pass_(across, "py", camera.height, "dy", "dx").select("px", "py", "depth")


def plane_distance(points: DataFrame, eye: Sequence[float], plane: Sequence[float]) -> DataFrame:
    """Distance along the ray from the eye through each point to a plane, in multiples of the way to the point; null if they never meet."""
    way = {a: F.col(a) - F.lit(float(e)) for a, e in zip("xyz", eye)}
    slope = sum((F.lit(float(n)) * way[a] for a, n in zip("xyz", plane)), F.lit(0.0))
    start = sum((float(n) * float(e) for n, e in zip(plane, eye)), 0.0) + float(plane[3])
    t = F.when(slope != 0, F.lit(-start) / slope)
    return points.withColumn("t", F.when(t >= 0, t))


def ray_through_frustum(points: DataFrame, eye: Sequence[float], planes: Sequence[Sequence[float]]) -> DataFrame:
    """Where the ray from the eye through each point meets a frustum of inward planes, in multiples of the way to the point.

    ``closest``: the least positive distance to one of the planes, null if it meets none ahead. ``t_in`` and ``t_out``: the
    interval that lies within all planes, from 0 on; null if there is none. ``t_out`` is infinite if nothing ends it.
    """
    way = {a: F.col(a) - F.lit(float(e)) for a, e in zip("xyz", eye)}
    infinity = F.lit(float("inf"))
    met = []  # of each plane the slope of the way towards it, and where the ray meets it
    for nx, ny, nz, d in planes:
        slope = F.lit(float(nx)) * way["x"] + F.lit(float(ny)) * way["y"] + F.lit(float(nz)) * way["z"]
        height = nx * eye[0] + ny * eye[1] + nz * eye[2] + d  # of the eye over the plane
        met.append(F.struct(slope.alias("s"), F.when(slope != 0, F.lit(-float(height)) / slope).alias("t"), F.lit(height < 0).alias("below")))
    # As arrays the planes share one piece of code; written out, it is longer than Java compiles.
    rows = points.withColumn("_met", F.array(*met))
    ahead = F.array_min(F.transform("_met", lambda p: F.when(p["t"] > 0, p["t"]).otherwise(infinity)))
    start = F.greatest(F.lit(0.0), F.array_max(F.transform("_met", lambda p: F.when(p["s"] > 0, p["t"]).otherwise(F.lit(0.0)))))
    end = F.least(infinity, F.array_min(F.transform("_met", lambda p: F.when(p["s"] < 0, p["t"]).otherwise(infinity))))
    outside = F.exists("_met", lambda p: (p["s"] == 0) & p["below"])
    out = rows.withColumns({"_ahead": ahead, "_in": start, "_out": end, "_beside": outside})
    inside = (F.col("_in") <= F.col("_out")) & ~F.col("_beside")
    out = out.withColumns({"closest": F.when(F.col("_ahead") < infinity, F.col("_ahead")), "t_in": F.when(inside, F.col("_in")), "t_out": F.when(inside, F.col("_out"))})
    return out.drop("_met", "_ahead", "_in", "_out", "_beside")


def in_bounds(points: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    ok: Column = F.lit(True)
    for a, lo, hi in zip("xyz", low, high):
        ok = ok & F.col(a).between(lo, hi)
    return points.where(ok)
