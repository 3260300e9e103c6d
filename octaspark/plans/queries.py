"""Registered queries over the star-schema tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octaspark.functions import geometry
from octaspark.operators import layout, octree, ordering, stats, thinning, view, voxelize
from octaspark.operators.octree import SMALL
from octaspark.plans import oracle
from octaspark.plans.build import LodTree
from octaspark.plans.oracle import morton_sql, num
from octaspark.sources import blocks, hierarchy, las, octree_file, sinks
from octaspark.sources.tables import ORDER, PC_SQL, bounds, embedding_points, event_points, lineitem_points, read
from octaspark.staging import shared_folder
from octaspark.streaming.incremental import replay, replay_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CAMERA = view.Camera.at((1.6, -1.2, 1.1), (0.5, 0.5, 0.4), 160, 120, lod=0.9)
BATCH, CLOUD_BITS, IMAGE_BITS, MASK_BITS = 1280, 5, 6, 6
ORD = ", ".join(ORDER)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def uniform(spark, d) -> DataFrame:
    return lineitem_points(spark, d)


def skewed(spark, d) -> DataFrame:
    return lineitem_points(spark, d, skewed=True)


def tree_of(spark, d) -> LodTree:
    return LodTree.of(skewed(spark, d), SMALL)


PC, TREE = f"WITH {PC_SQL}", oracle.tree("pcs")
MM = ", ".join(f"{f}({a}) AS {f}_{a}" for a in "xyz" for f in ("min", "max"))


# Counting


@query(f"{PC} SELECT *, greatest(max_x - min_x, max_y - min_y, max_z - min_z) AS cube_size FROM (SELECT {MM}, count(*) AS n FROM pc)")
def cloud_bbox(spark, d):
    return stats.bounding_box(uniform(spark, d))


def _grid(bits: int) -> str:
    return ", ".join(f"{oracle.cell(a, bits)} AS i{a}" for a in "xyz")


@query(f"{PC} SELECT {_grid(5)}, count(*) AS n FROM pc GROUP BY ALL")
def grid_cell_counts(spark, d):
    return octree.grid_cell_counts(uniform(spark, d), 5)


@query(f"WITH {oracle.PCS_SQL} SELECT {_grid(4)}, count(*) AS n FROM pcs GROUP BY ALL HAVING count(*) > 1000")
def large_cells(spark, d):
    return octree.large_cells(skewed(spark, d), 4, 1000)


@query(
    f"WITH {oracle.PCS_SQL}, f AS (SELECT {_grid(8)}, count(*) AS n FROM pcs GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY ix >> 4, iy >> 4, iz >> 4) AS t FROM f) "
    "SELECT ix, iy, iz, n FROM w WHERE t > 1000"
)
def subgrid_counts(spark, d):
    return octree.subgrid_counts(skewed(spark, d), SMALL)


@query(f"{TREE} SELECT CAST(l.range AS INT) AS level, key >> (3 * (8 - l.range)) AS key, count(*) AS n FROM fx, range(9) l GROUP BY 1, 2")
def count_pyramid(spark, d):
    return octree.pyramid(octree.cell_counts(octree.with_fine_index(skewed(spark, d), SMALL)), SMALL)


# The tree


@query(f"{oracle.tree('pc')} SELECT leaf_level AS level, leaf_key AS key, count(*) AS n FROM lv GROUP BY ALL")
def octree_leaves(spark, d):
    return octree.leaves(octree.cell_counts(octree.with_fine_index(uniform(spark, d), SMALL)), SMALL)


@query(f"{TREE} SELECT leaf_level AS level, leaf_key AS key, count(*) AS n FROM lv GROUP BY ALL")
def octree_leaves_skewed(spark, d):
    return octree.leaves(octree.cell_counts(octree.with_fine_index(skewed(spark, d), SMALL)), SMALL)


_BOX = ", ".join(f"{e}_{a}" for a in "xyz" for e in ("min", "max"))


@query(f"{TREE}, {oracle.described()} SELECT level, key, n, is_leaf, child_mask, ix, iy, iz, size, name, {_BOX} FROM ds")
def octree_nodes(spark, d):
    return octree.describe(tree_of(spark, d).nodes)


@query(f"{TREE}, {oracle.described()} SELECT level, key, child_mask FROM ds WHERE NOT is_leaf")
def node_children_mask(spark, d):
    return octree.describe(tree_of(spark, d).nodes).where("NOT is_leaf").select("level", "key", "child_mask")


@query(f"{TREE} SELECT level, key, n, CAST(sum(n) OVER (ORDER BY level, key) - n AS BIGINT) AS slice_offset FROM tr WHERE is_leaf")
def leaf_slices(spark, d):
    return octree.leaf_slices(tree_of(spark, d).nodes)


@query(f"{TREE} SELECT {ORD}, ix, iy, iz, leaf_level, leaf_key FROM lv")
def points_with_leaf(spark, d):
    return tree_of(spark, d).points.select(*ORDER, "ix", "iy", "iz", "leaf_level", "leaf_key")


# Statistics


@query(
    f"""{TREE}, {oracle.occupied()},
a AS (SELECT count(*) AS nodes, count(*) FILTER (is_leaf) AS leaves, count(*) FILTER (NOT is_leaf) AS inner, CAST(sum(n) FILTER (is_leaf) AS BIGINT) AS points, min(n) FILTER (is_leaf) AS min_points,
  max(n) FILTER (is_leaf) AS max_points, CAST(floor(avg(n) FILTER (is_leaf)) AS BIGINT) AS avg_points FROM tr),
v AS (SELECT CAST(coalesce(sum(num_voxels), 0) AS BIGINT) AS voxels, min(num_voxels) AS min_voxels, max(num_voxels) AS max_voxels, CAST(floor(avg(num_voxels)) AS BIGINT) AS avg_voxels FROM oc)
SELECT * FROM a, v""".replace("AS inner,", 'AS "inner",')
)
def node_stats(spark, d):
    t = tree_of(spark, d)
    return stats.node_stats(t.nodes, t.voxel_counts())


_LEVELS = f"""{TREE}, {oracle.occupied()},
ls AS (SELECT t.level, t.leaves, t."inner", t.points, CAST(coalesce(v.voxels, 0) AS BIGINT) AS voxels FROM
  (SELECT level, count(*) FILTER (is_leaf) AS leaves, count(*) FILTER (NOT is_leaf) AS "inner", CAST(coalesce(sum(n) FILTER (is_leaf), 0) AS BIGINT) AS points FROM tr GROUP BY 1) t
  LEFT JOIN (SELECT level, sum(num_voxels) AS voxels FROM oc GROUP BY 1) v ON t.level = v.level)"""


@query(f"{_LEVELS} SELECT * FROM ls")
def level_stats(spark, d):
    t = tree_of(spark, d)
    return stats.level_stats(t.nodes, t.voxel_counts())


@query(f"{_LEVELS} SELECT level, points + voxels AS samples, CAST(floor(100 * (points + voxels) / lead(points + voxels) OVER (ORDER BY level)) AS BIGINT) AS rate FROM ls")
def level_rate(spark, d):
    return stats.level_rate(level_stats(spark, d))


@query(f"{TREE} SELECT CAST(least(floor(n * 100 / CAST(2000 AS DOUBLE)), 99) AS BIGINT) AS bin, count(*) AS n FROM (SELECT n FROM tr WHERE is_leaf) GROUP BY 1")
def node_histogram(spark, d):
    return stats.histogram(tree_of(spark, d).nodes.where("is_leaf"), "n", 2000)


@query(
    f"""{TREE}, {oracle.occupied()}, ow AS (SELECT tr.level, tr.key, is_leaf, CASE WHEN is_leaf THEN n ELSE num_voxels END AS samples FROM tr LEFT JOIN ok ON tr.level = ok.level AND tr.key = ok.key),
bl AS (SELECT level - 1 AS level, key >> 3 AS key, sum(samples) AS below FROM ow WHERE level > 0 GROUP BY 1, 2)
SELECT count(*) AS nodes, count(*) FILTER (is_leaf) AS leaves, count(*) FILTER (NOT is_leaf) AS "inner", round(avg(samples) FILTER (is_leaf), 6) AS mean_leaf,
  round(avg(samples) FILTER (NOT is_leaf), 6) AS mean_inner, (SELECT round(avg(samples / below), 6) FROM ow JOIN bl ON ow.level = bl.level AND ow.key = bl.key WHERE NOT is_leaf) AS mean_reduction FROM ow"""
)
def hierarchy_stats(spark, d):
    t = tree_of(spark, d)
    return stats.reduction_stats(t.nodes, t.voxel_counts())


# Voxels


@query(f"{TREE}, {oracle.occupied()} SELECT level, nx, ny, nz, num_voxels FROM oc")
def voxel_occupancy(spark, d):
    return voxelize.occupancy(tree_of(spark, d).points, SMALL)


def _voxels(strategy: str):
    def run(spark, d):
        return tree_of(spark, d).voxels(strategy)

    run.__name__ = f"voxels_{strategy}"
    return query(f"{TREE}, {oracle.voxel_ctes(strategy)} SELECT * FROM vo")(run)


for _s in voxelize.STRATEGIES:
    _voxels(_s)


def _cloud(method: str):
    def run(spark, d):
        return voxelize.cloud_voxels(uniform(spark, d), CLOUD_BITS, method)

    run.__name__ = f"cloud_voxels_{method}"
    return query(oracle.cloud(method, CLOUD_BITS))(run)


for _s in ("first", "average", "interpolated", "smooth"):
    _cloud(_s)


@query(oracle.cloud("average", CLOUD_BITS + 2))
def sparse_grid_level(spark, d):
    """The grid of a deeper level: every level doubles the cells along an axis."""
    return voxelize.cloud_voxels(uniform(spark, d), CLOUD_BITS + 2, "average")


@query(f"{TREE}, {oracle.voxel_ctes('average')} SELECT CAST(leaf_level AS INT) AS level, x, y, z, r, g, b, false AS is_voxel FROM lv UNION ALL SELECT level, (vx + {num(0.5)}) / (32 * pow(2, level)) AS x, (vy + {num(0.5)}) / (32 * pow(2, level)) AS y, (vz + {num(0.5)}) / (32 * pow(2, level)) AS z, r, g, b, true FROM vo")
def export_samples(spark, d):
    """Points of leaves and voxels of inner nodes, at their cells' centres, as one table of samples."""
    t = tree_of(spark, d)
    points = t.points.select(F.col("leaf_level").alias("level"), *"xyzrgb", F.lit(False).alias("is_voxel"))
    cells = F.lit(float(1 << SMALL.grid_bits)) * F.pow(F.lit(2.0), "level")
    voxels = t.voxels("average").select("level", *[((F.col(f"v{a}") + 0.5) / cells).alias(a) for a in "xyz"], "r", "g", "b", F.lit(True).alias("is_voxel"))
    return points.unionByName(voxels)


@query(
    f"""SELECT vx, vy, vz, CAST(bit_or(1 << CAST(((ux & 1) << 2) | ((uy & 1) << 1) | (uz & 1) AS INT)) AS INT) AS mask, count(*) AS n FROM
(SELECT *, ux >> 1 AS vx, uy >> 1 AS vy, uz >> 1 AS vz FROM (SELECT {', '.join(f"CAST(least(greatest(floor((CAST(embedding[{k + 1}] AS DOUBLE) + 1) * {num(0.5)} * {num(32)}), 0), 31) AS BIGINT) AS u{a}" for k, a in enumerate("xyz"))} FROM embeddings)) GROUP BY 1, 2, 3"""
)
def vertex_voxels(spark, d):
    """Voxels of vertices in the cube from -1 to 1, with the octants that are filled."""
    unit = embedding_points(spark, d).select(*[((F.col(a) + 1) * 0.5).alias(a) for a in "xyz"])
    return voxelize.vertex_voxels(unit, 4)


@query(f"SELECT * FROM ({oracle.cloud('average', 4)}) WHERE samples > 5")
def sparse_voxels_supported(spark, d):
    return voxelize.supported_voxels(uniform(spark, d), 4, 5)


# Views


@query(f"{PC} SELECT {ORD} FROM pc WHERE x BETWEEN {num(0.25)} AND {num(0.5)} AND y BETWEEN {num(0.1)} AND {num(0.9)} AND z BETWEEN {num(0.0)} AND {num(0.75)}")
def node_filter_bounds(spark, d):
    return view.in_bounds(uniform(spark, d), (0.25, 0.1, 0.0), (0.5, 0.9, 0.75)).select(*ORDER)


_VISIBLE = f"{TREE}, {oracle.described()}, {oracle.visible(CAMERA)}"


def _seen(t: LodTree) -> DataFrame:
    return view.with_visibility(octree.describe(t.nodes), CAMERA)


@query(f"{_VISIBLE} SELECT level, key, n, is_leaf FROM vs WHERE visible")
def visible_nodes(spark, d):
    return _seen(tree_of(spark, d)).where("visible").select("level", "key", "n", "is_leaf")


@query(
    f"""{_VISIBLE}, {oracle.occupied()} SELECT count(*) AS nodes, CAST(coalesce(sum(n) FILTER (is_leaf), 0) AS BIGINT) AS points, CAST(coalesce(sum(num_voxels), 0) AS BIGINT) AS voxels
FROM vs LEFT JOIN ok ON vs.level = ok.level AND vs.key = ok.key WHERE visible"""
)
def visible_totals(spark, d):
    t = tree_of(spark, d)
    return view.visible_totals(_seen(t), t.voxel_counts())


@query(
    f"""{_VISIBLE}, {oracle.voxel_ctes('average')}, vk AS (SELECT *, {morton_sql(*[f'(v{a} >> 5)' for a in 'xyz'], 8)} AS key, {morton_sql(*[f'(v{a} >> 4)' for a in 'xyz'], 9)} AS child FROM vo)
SELECT level, key, vx, vy, vz, r, g, b, samples FROM vk WHERE (level, key) IN (SELECT (level, key) FROM vs WHERE visible) AND (level + 1, child) NOT IN (SELECT (level, key) FROM vs WHERE visible)"""
)
def suppressed_voxels(spark, d):
    t = tree_of(spark, d)
    return view.unsuppressed(t.voxels("average"), _seen(t), SMALL.grid_bits).select("level", "key", "vx", "vy", "vz", "r", "g", "b", "samples")


_FRAGS = f"{PC}, {oracle.frags(CAMERA)}"


@query(f"{PC}, {oracle.frags(CAMERA, keep=ORD)} SELECT * FROM fr")
def project_points(spark, d):
    return view.fragments(uniform(spark, d), CAMERA, *ORDER)


def _frags(spark, d) -> DataFrame:
    return view.fragments(uniform(spark, d), CAMERA, "r", "g", "b")


@query(f"{_FRAGS} SELECT px, py, min(depth) AS depth, count(*) AS n FROM fr GROUP BY 1, 2")
def depth_map(spark, d):
    return view.depth_map(_frags(spark, d))


@query(f"{_FRAGS} SELECT px, py, depth, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY depth, r, g, b) AS rn FROM fr) WHERE rn = 1")
def closest_color(spark, d):
    return view.closest_colour(_frags(spark, d))


_SUMS = f"""{_FRAGS}, ac AS (SELECT px, py, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(g) AS BIGINT) AS sum_g, CAST(sum(b) AS BIGINT) AS sum_b, count(*) AS n
FROM (SELECT *, min(depth) OVER (PARTITION BY px, py) AS nearest FROM fr) WHERE depth < nearest * {num(1.01)} GROUP BY 1, 2)"""


@query(f"{_SUMS} SELECT * FROM ac")
def hqs_accumulate(spark, d):
    return view.accumulate(_frags(spark, d))


@query(
    f"""{_SUMS}, mv AS (SELECT px + dx AS px, py + dy AS py, sum_r * w AS r, sum_g * w AS g, sum_b * w AS b, n * w AS w FROM (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 1000 ELSE 1 END AS w
FROM ac, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) c(dy))),
rs AS (SELECT px, py, CAST(floor(sum(r) / sum(w)) AS INT) AS r, CAST(floor(sum(g) / sum(w)) AS INT) AS g, CAST(floor(sum(b) / sum(w)) AS INT) AS b FROM mv GROUP BY 1, 2),
im AS (SELECT CAST(x.range AS INT) AS px, CAST(y.range AS INT) AS py FROM range({CAMERA.width}) x, range({CAMERA.height}) y)
SELECT im.px, im.py, coalesce(r, 17) AS r, coalesce(g, 34) AS g, coalesce(b, 51) AS b FROM im LEFT JOIN rs ON im.px = rs.px AND im.py = rs.py"""
)
def hqs_resolve(spark, d):
    return view.image(view.resolve(view.accumulate(_frags(spark, d)), CAMERA), CAMERA)


@query(
    f"""{_FRAGS}, dm AS (SELECT px, py, min(depth) AS depth FROM fr GROUP BY 1, 2), nb AS (SELECT px + dx AS px, py + dy AS py, depth AS other FROM dm, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy))
SELECT dm.px, dm.py, round(coalesce(sum(greatest(log2(depth) - log2(other), 0)), 0) / 5, 6) AS response FROM dm LEFT JOIN nb ON dm.px = nb.px AND dm.py = nb.py GROUP BY 1, 2"""
)
def edl_response(spark, d):
    return view.edl_response(view.depth_map(_frags(spark, d)), CAMERA)


_TAPS = f"(SELECT CAST(range - 10 AS INT) AS d, CAST(range - 10 AS INT) / {num(10)} AS u FROM range(21))"


@query(
    f"""{_FRAGS}, dm AS (SELECT px, py, min(depth) AS depth FROM fr GROUP BY 1, 2),
ax AS (SELECT px, py, depth, dx FROM (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY depth, dx) AS rn FROM (SELECT px + d AS px, py, depth + depth * u * u * {num(0.1)} AS depth, abs(d) AS dx FROM dm, {_TAPS}) WHERE px >= 0 AND px < {CAMERA.width}) WHERE rn = 1)
SELECT px, py, min(depth) AS depth FROM (SELECT px, py + d AS py, depth + depth * u * u * {num(0.1)} AS depth, dx, d FROM ax, {_TAPS}) WHERE py >= 0 AND py < {CAMERA.height} AND dx * dx + d * d <= {num(105)} GROUP BY 1, 2"""
)
def depth_dilate(spark, d):
    return view.dilate(view.depth_map(_frags(spark, d)), 10, 0.1, CAMERA)


_PLANE = (0.3, -0.4, 0.8, -0.25)
_WAY = {a: f"({a} - {num(e)})" for a, e in zip("xyz", (1.6, -1.2, 1.1))}
_SLOPE = " + ".join(["CAST(0 AS DOUBLE)"] + [f"{num(n)} * {_WAY[a]}" for a, n in zip("xyz", _PLANE)])
_START = sum((n * e for n, e in zip(_PLANE, (1.6, -1.2, 1.1))), 0.0) + _PLANE[3]


@query(f"{PC} SELECT {ORD}, CASE WHEN t >= 0 THEN t END AS t FROM (SELECT *, CASE WHEN s <> 0 THEN {num(-_START)} / s END AS t FROM (SELECT *, {_SLOPE} AS s FROM pc))")
def plane_distance(spark, d):
    return view.plane_distance(uniform(spark, d), (1.6, -1.2, 1.1), _PLANE).select(*ORDER, "t")


def _ray_sql() -> str:
    eye, rows = (1.6, -1.2, 1.1), []
    for k, (nx, ny, nz, dd) in enumerate(geometry.frustum_planes(CAMERA.matrix)):
        height = nx * eye[0] + ny * eye[1] + nz * eye[2] + dd
        rows.append(f"{num(nx)} * {_WAY['x']} + {num(ny)} * {_WAY['y']} + {num(nz)} * {_WAY['z']} AS s{k}, {num(-height)} AS h{k}")
    return ", ".join(rows)


_INF = "CAST('inf' AS DOUBLE)"
_T = [f"(CASE WHEN s{k} <> 0 THEN h{k} / s{k} END)" for k in range(6)]
_AHEAD = "least(" + ", ".join(f"CASE WHEN {t} > 0 THEN {t} ELSE {_INF} END" for t in _T) + ")"
_IN = "greatest(CAST(0 AS DOUBLE), " + ", ".join(f"CASE WHEN s{k} > 0 THEN {t} ELSE CAST(0 AS DOUBLE) END" for k, t in enumerate(_T)) + ")"
_OUT = "least(" + ", ".join(f"CASE WHEN s{k} < 0 THEN {t} ELSE {_INF} END" for k, t in enumerate(_T)) + ")"
_BESIDE = " OR ".join(f"(s{k} = 0 AND h{k} > 0)" for k in range(6))


@query(
    f"""{PC} SELECT {ORD}, CASE WHEN c < {_INF} THEN c END AS closest, CASE WHEN ti <= tu AND NOT o THEN ti END AS t_in, CASE WHEN ti <= tu AND NOT o THEN tu END AS t_out
FROM (SELECT *, {_AHEAD} AS c, {_IN} AS ti, {_OUT} AS tu, {_BESIDE} AS o FROM (SELECT *, {_ray_sql()} FROM pc))"""
)
def ray_through_frustum(spark, d):
    """Where rays from the eye through each point enter and leave the camera's frustum."""
    return view.ray_through_frustum(uniform(spark, d), (1.6, -1.2, 1.1), geometry.frustum_planes(CAMERA.matrix)).select(*ORDER, "closest", "t_in", "t_out")


# Layout

_CODE = {o: morton_sql(*[oracle.cell(a, 21) for a in "xyz"], 21, o) for o in ("xyz", "zyx")}


def _coded(order: str = "xyz") -> str:
    return f"mc AS (SELECT *, {morton_sql('jx', 'jy', 'jz', 21, order)} AS code FROM (SELECT *, {', '.join(f'{oracle.cell(a, 21)} AS j{a}' for a in 'xyz')} FROM pc)), mr AS (SELECT *, row_number() OVER (ORDER BY code, {ORD}) - 1 AS rank FROM mc)"


@query(f"{PC}, {_coded()} SELECT {ORD}, code, rank FROM mr")
def morton_sort_rank(spark, d):
    return layout.morton_rank(uniform(spark, d)).select(*ORDER, "code", "rank")


@query(f"{PC}, {_coded('zyx')} SELECT {ORD}, code, rank FROM mr")
def morton_sort_rank_zyx(spark, d):
    return layout.morton_rank(uniform(spark, d), order="zyx").select(*ORDER, "code", "rank")


@query(
    f"""{PC}, {_coded()}, bl AS (SELECT *, CAST(floor(rank / 128) AS BIGINT) AS block FROM mr)
SELECT {ORD}, block, row_number() OVER (ORDER BY ((block % 2147483647) * 48271 + 12345) % 2147483647, block, rank) - 1 AS position FROM bl"""
)
def block_shuffle(spark, d):
    return layout.block_shuffle(uniform(spark, d), keep=ORDER).select(*ORDER, "block", "position")


@query(f"{PC} SELECT {ORD}, row_number() OVER (ORDER BY ((k1 * 8 + k4) % 2147483647 * 48271 + 12345) % 2147483647, {ORD}) - 1 AS position FROM pc")
def random_order(spark, d):
    return ordering.ranked(uniform(spark, d), layout.shuffle_hash(F.col("k1") * 8 + F.col("k4")), *ORDER, name="position").select(*ORDER, "position")


@query(f"{PC} SELECT {ORD}, x, row_number() OVER (ORDER BY x, {ORD}) - 1 AS rank FROM pc")
def sort_x(spark, d):
    return ordering.ranked(uniform(spark, d), "x", *ORDER).select(*ORDER, "x", "rank")


@query(f"{PC} SELECT {ORD}, x, y, z, r, g, b FROM pc ORDER BY {ORD} LIMIT 5000")
def crop_first_n(spark, d):
    """The limit is the feature: the first points of a cloud."""
    return uniform(spark, d).orderBy(*ORDER).limit(5000).select(*ORDER, "x", "y", "z", "r", "g", "b")


_BATCHED = f"{PC}, bt AS (SELECT *, CAST(floor(pid / {BATCH}) AS BIGINT) AS batch_id FROM (SELECT *, row_number() OVER (ORDER BY {ORD}) - 1 AS pid FROM pc))"
_MEANS = ", ".join(f"CAST(floor(sum({c}) / count(*)) AS INT) AS mean_{c}" for c in "rgb")
_SUMMARY = f"bs AS (SELECT batch_id, {MM}, count(*) AS n, {_MEANS} FROM bt GROUP BY 1)"


@query(f"{_BATCHED}, {_SUMMARY} SELECT * FROM bs")
def batch_bbox_color(spark, d):
    return layout.batch_summary(layout.with_batches(uniform(spark, d), BATCH))


def _plane(shift: int) -> str:
    return " | ".join(f"(((q{a} >> {shift}) & 1023) << {10 * k})" for k, a in enumerate("xyz"))


_Q30 = ", ".join(f"CAST(least(greatest(floor((CASE WHEN max_{a} > min_{a} THEN ({a} - min_{a}) / (max_{a} - min_{a}) ELSE 0 END) * {num(1 << 30)}), 0), {(1 << 30) - 1}) AS BIGINT) AS q{a}" for a in "xyz")


@query(f"{_BATCHED}, {_SUMMARY}, q AS (SELECT bt.pid, bt.batch_id, {_Q30} FROM bt JOIN bs ON bt.batch_id = bs.batch_id) SELECT pid, batch_id, {_plane(20)} AS xyz_low, {_plane(10)} AS xyz_med, {_plane(0)} AS xyz_hig FROM q")
def quantize_30bit_planes(spark, d):
    return layout.quantise_planes(layout.with_batches(uniform(spark, d), BATCH))


def _quantise(bits: int):
    def run(spark, d):
        return layout.quantise(uniform(spark, d), bits)

    run.__name__ = f"quantize_{bits}bit"
    return query(f"{PC} SELECT {ORD}, {', '.join(f'{oracle.cell(a, bits)} AS q{a}' for a in 'xyz')} FROM pc")(run)


for _b in (16, 20):
    _quantise(_b)


def _length(c: str) -> str:
    return f"(CASE WHEN {c} = 0 THEN 0 ELSE length(bin({c})) END)"


_WIDTHS = ", ".join(f"CAST({_length(f'CAST(ceil((max_{a} - min_{a}) / {num(0.001)}) AS BIGINT)')} AS INT) AS bits_{a}" for a in "xyz")


@query(f"{_BATCHED}, {_SUMMARY} SELECT *, (bits_x + bits_y + bits_z) * n AS total_bits FROM (SELECT batch_id, n, {_WIDTHS} FROM bs)")
def bits_per_batch(spark, d):
    return layout.bits_per_batch(layout.with_batches(uniform(spark, d), BATCH))


@query(f"{_BATCHED}, {_SUMMARY}, bb2 AS (SELECT *, (bits_x + bits_y + bits_z) * n AS total_bits FROM (SELECT batch_id, n, {_WIDTHS} FROM bs)) SELECT CAST(sum(n) AS BIGINT) AS points, CAST(sum(total_bits) AS BIGINT) AS bits, round(sum(total_bits) / CAST(sum(n) AS DOUBLE), 6) AS bits_per_point, round(sum(total_bits) / {num(8e6)}, 6) AS megabytes FROM bb2")
def bits_total(spark, d):
    return layout.bits_total(bits_per_batch(spark, d))


_STEPS = ", ".join(f"CAST(floor((bt.{a} - bs.min_{a}) / {num(0.001)}) AS BIGINT) AS q{a}" for a in "xyz")


@query(
    f"""{_BATCHED}, {_SUMMARY}, wd AS (SELECT batch_id, {_WIDTHS} FROM bs),
pk AS (SELECT bt.batch_id, pid, {_STEPS}, bits_x, bits_y, bits_z, min(pid) OVER (PARTITION BY bt.batch_id) AS first FROM bt JOIN bs ON bt.batch_id = bs.batch_id JOIN wd ON bt.batch_id = wd.batch_id)
SELECT batch_id, pid, (qx << (bits_y + bits_z)) | (qy << bits_z) | qz AS code, (pid - first) * (bits_x + bits_y + bits_z) AS bit_offset FROM pk"""
)
def pack_variable_bits(spark, d):
    return layout.pack_batches(layout.with_batches(uniform(spark, d), BATCH))


def _packed(bits: int):
    def run(spark, d):
        return layout.packed(uniform(spark, d), bits)

    run.__name__ = f"pack_{bits}bit"
    return query(f"{PC} SELECT {ORD}, qx | (qy << {bits}) | (qz << {2 * bits}) AS code FROM (SELECT *, {', '.join(f'{oracle.cell(a, bits)} AS q{a}' for a in 'xyz')} FROM pc)")(run)


for _b in (16, 20):
    _packed(_b)

_OCTANT = " + ".join(f"CASE WHEN floor(min_{a} * 2) >= 1 THEN {w} ELSE 0 END" for a, w in zip("xyz", (4, 2, 1)))
_ALONE = " AND ".join(f"least(floor(min_{a} * 2), 1) = least(floor(max_{a} * 2), 1)" for a in "xyz")


@query(f"WITH {PC_SQL}, mb AS (SELECT CAST(floor(rank / {BATCH}) AS BIGINT) AS batch_id, x, y, z FROM (SELECT *, row_number() OVER (ORDER BY x, {ORD}) - 1 AS rank FROM pc)), ms AS (SELECT batch_id, {MM}, count(*) AS n FROM mb GROUP BY 1) SELECT batch_id, n, CAST(CASE WHEN {_ALONE} THEN {_OCTANT} ELSE -1 END AS INT) AS octant FROM ms")
def batch_octants(spark, d):
    """Batches along x, with the octant that holds all of a batch."""
    rows = ordering.ranked(uniform(spark, d), "x", *ORDER).withColumn("batch_id", F.floor(F.col("rank") / BATCH).cast("long"))
    return layout.single_octant(layout.batch_summary(rows)).select("batch_id", "n", "octant")


@query(f"{PC} SELECT CAST((CASE WHEN x > {num(0.5)} THEN 4 ELSE 0 END) + (CASE WHEN y > {num(0.5)} THEN 2 ELSE 0 END) + (CASE WHEN z > {num(0.5)} THEN 1 ELSE 0 END) AS INT) AS octant, count(*) AS n FROM pc GROUP BY 1")
def strict_octants(spark, d):
    """Points by octant where the middle belongs to the lower one."""
    octant = sum((F.when(F.col(a) > 0.5, F.lit(w)).otherwise(F.lit(0)) for a, w in zip("xyz", (4, 2, 1))), F.lit(0)).cast("int")
    return uniform(spark, d).groupBy(octant.alias("octant")).agg(F.count("*").alias("n"))


@query(f"{TREE} SELECT {ORD}, leaf_level, leaf_key, row_number() OVER (PARTITION BY leaf_level, leaf_key ORDER BY {morton_sql(*[f'((i{a} >> greatest(6 - leaf_level, 0)) & 127)' for a in 'xyz'], 7)}, {ORD}) - 1 AS place FROM lv")
def node_morton_order(spark, d):
    """Places of points in their leaf's Morton order, seven bits to an axis as far as the grid goes.

    Leaf and code are one number, so rows are sorted by it and not by columns that mostly tie; where a leaf starts is
    known from the nodes' counts.
    """
    t = tree_of(spark, d)
    code = geometry.morton(*[F.expr(f"shiftright(i{a}, greatest({SMALL.fine_bits - 7} - leaf_level, 0)) & 127") for a in "xyz"])
    leaf = lambda level, key: F.shiftleft(F.col(level).cast("long"), 3 * SMALL.max_depth).bitwiseOR(F.col(key))
    rows = t.points.select(*ORDER, F.shiftleft(leaf("leaf_level", "leaf_key"), 21).bitwiseOR(code).alias("code"))
    first = octree.leaf_slices(t.nodes).select(leaf("level", "key").alias("leaf"), F.col("slice_offset").alias("first"))
    placed = layout.order_within_known(rows, F.shiftright("code", 21), "code", first)
    at = [F.shiftright("leaf", 3 * SMALL.max_depth).cast("int").alias("leaf_level"), F.col("leaf").bitwiseAND(F.lit((1 << 3 * SMALL.max_depth) - 1)).alias("leaf_key")]
    return placed.select(*ORDER, *at, "place")


@query(f"{_BATCHED} SELECT {ORD}, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY {morton_sql(*[oracle.cell(a, 21) for a in 'xyz'], 21)}, {ORD}) - 1 AS place FROM bt")
def batch_morton_order(spark, d):
    rows = layout.with_batches(layout.with_morton(uniform(spark, d)).select(*ORDER, "code"), BATCH)
    return layout.order_within(rows.select(*ORDER, "batch_id", "code"), ["batch_id"], "code").select(*ORDER, "batch_id", "place")


_D2 = " + ".join(["CAST(0 AS DOUBLE)"] + [f"({a} - {num(0.5)}) * ({a} - {num(0.5)})" for a in "xyz"])


@query(f"{PC} SELECT {ORD}, d2, row_number() OVER (ORDER BY d2, {ORD}) - 1 AS rank FROM (SELECT *, {_D2} AS d2 FROM pc)")
def order_by_centre(spark, d):
    d2 = sum(((F.col(a) - 0.5) * (F.col(a) - 0.5) for a in "xyz"), F.lit(0.0))
    return ordering.ranked(uniform(spark, d).withColumn("d2", d2), "d2", *ORDER).select(*ORDER, "d2", "rank")


@query(f"{PC} SELECT {ORD}, CASE WHEN 2 * i <= 2147483647 THEN (i * i) % 2147483647 ELSE 2147483647 - (i * i) % 2147483647 END AS position FROM (SELECT *, k1 * 8 + k4 AS i FROM pc)")
def residue_order(spark, d):
    return uniform(spark, d).select(*ORDER, layout.residue_permutation(F.col("k1") * 8 + F.col("k4")).alias("position"))


@query(f"{PC}, {_coded()} SELECT code >> 42 AS voxel, count(*) AS n, min(rank) AS first FROM mr GROUP BY 1")
def morton_runs(spark, d):
    """Runs of points along the Morton curve that share a voxel of 128 to an axis."""
    return layout.morton_rank(uniform(spark, d)).groupBy(F.shiftright("code", 42).alias("voxel")).agg(F.count("*").alias("n"), F.min("rank").alias("first"))


_DELTA = ", ".join(f"CAST(floor(abs(1000 * ({a} - lag({a}, 1, 0) OVER (PARTITION BY batch_id ORDER BY pid)))) AS BIGINT) AS e{a}" for a in "xyz")
_COST = ", ".join(f"(CASE WHEN e{a} = 0 THEN 1 ELSE length(bin(e{a})) + 1 END) AS d{a}" for a in "xyz")


@query(
    f"{_BATCHED}, dl AS (SELECT batch_id, {_COST} FROM (SELECT batch_id, {_DELTA} FROM bt)) SELECT batch_id, {', '.join(f'CAST(sum(d{a}) AS BIGINT) AS delta_bits_{a}' for a in 'xyz')}, count(*) FILTER (dx > 8) AS jumps FROM dl GROUP BY 1"
)
def delta_bits(spark, d):
    return layout.delta_bits(layout.with_batches(uniform(spark, d), BATCH))


@query(
    f"""{oracle.cloud('average', IMAGE_BITS).replace('SELECT vx, vy, vz, r, g, b, samples FROM (', ', cv AS (', 1)},
im AS (SELECT *, row_number() OVER (ORDER BY {morton_sql('vx', 'vy', 'vz', IMAGE_BITS)}) - 1 AS rank, count(*) OVER () AS n FROM cv)
SELECT rank, r, g, b, {oracle.gather('rank', 16, 0, 2)} AS px, {oracle.gather('rank', 16, 1, 2)} AS py, CAST(pow(2, ceil(log2(sqrt(n)))) AS INT) AS side FROM im"""
)
def morton_image_xy(spark, d):
    colours = voxelize.cloud_voxels(uniform(spark, d), IMAGE_BITS, "average").withColumn("code", geometry.morton(F.col("vx"), F.col("vy"), F.col("vz")))
    return layout.morton_image(colours, "code").select("rank", "r", "g", "b", "px", "py", "side")


def _mask_cells(spark, d) -> DataFrame:
    return uniform(spark, d).select(geometry.morton(*[geometry.grid_index(F.col(a), MASK_BITS) for a in "xyz"]).alias("key")).distinct()


_MASKS = f"""{PC}, mk AS (SELECT DISTINCT {morton_sql('jx', 'jy', 'jz', MASK_BITS)} AS key FROM (SELECT {', '.join(f'{oracle.cell(a, MASK_BITS)} AS j{a}' for a in 'xyz')} FROM pc)),
mt AS (SELECT CAST(l.range AS INT) AS level, key >> (3 * ({MASK_BITS} - l.range)) AS key, CAST(bit_or(1 << CAST((key >> (3 * ({MASK_BITS} - l.range - 1))) & 7 AS INT)) AS INT) AS mask FROM mk, range({MASK_BITS}) l GROUP BY 1, 2)"""


@query(f"{_MASKS} SELECT * FROM mt")
def voxel_mask_tree(spark, d):
    return layout.mask_tree(_mask_cells(spark, d), MASK_BITS)


@query(f"{_MASKS} SELECT level, key, mask, row_number() OVER (ORDER BY key << (3 * ({MASK_BITS} - level)), level) - 1 AS ord FROM mt")
def mask_stream_dfs(spark, d):
    return layout.depth_first(layout.mask_tree(_mask_cells(spark, d), MASK_BITS), MASK_BITS)


@query(f"{_MASKS} SELECT key FROM mk")
def mask_decode(spark, d):
    return layout.decode_masks(layout.mask_tree(_mask_cells(spark, d), MASK_BITS), MASK_BITS)


@query(
    f"""{TREE}, {oracle.voxel_ctes('average')} SELECT level - 1 AS level, vx >> 1 AS vx, vy >> 1 AS vy, vz >> 1 AS vz,
CAST(bit_or(1 << CAST(((vx & 1) << 2) | ((vy & 1) << 1) | (vz & 1) AS INT)) AS INT) AS mask FROM vo WHERE level > 0 GROUP BY 1, 2, 3, 4"""
)
def parent_voxel_masks(spark, d):
    return layout.parent_voxel_masks(tree_of(spark, d).voxels("average"))


@query(f"{TREE}, {oracle.described()} SELECT substring(name, 1, 1 + level - level % 3) AS batch, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS points, min(level) AS least_level FROM ds GROUP BY 1")
def batch_by_prefix(spark, d):
    return layout.batch_by_prefix(octree.describe(tree_of(spark, d).nodes))


@query(
    f"""{TREE}, sl AS (SELECT level, key, n, CAST(sum(n) OVER (ORDER BY level, key) - n AS BIGINT) AS o FROM tr WHERE is_leaf)
SELECT CAST(floor(o / 5000) AS BIGINT) AS bin, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS points, min(level) AS weight, min(o) * 18 AS byte_offset, CAST(sum(n) AS BIGINT) * 18 AS byte_size FROM sl GROUP BY 1"""
)
def byte_offset_bins(spark, d):
    return layout.byte_offset_bins(tree_of(spark, d).nodes, 18, 5000)


@query(
    f"""{TREE.replace('WITH ', 'WITH RECURSIVE ', 1)}, sl AS (SELECT level, key, n, row_number() OVER (ORDER BY level, key) AS i, CAST(sum(n) OVER (ORDER BY level, key) - n AS BIGINT) AS o FROM tr WHERE is_leaf),
lo AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS bin UNION ALL
SELECT sl.i, CASE WHEN held > 5000 THEN 0 ELSE held END + n, CASE WHEN held > 5000 THEN bin + 1 ELSE bin END FROM lo JOIN sl ON sl.i = lo.i + 1)
SELECT bin, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS points, min(level) AS weight, min(o) * 18 AS byte_offset, CAST(sum(n) AS BIGINT) * 18 AS byte_size FROM lo JOIN sl ON lo.i = sl.i GROUP BY 1"""
)
def closing_bins(spark, d):
    """Bins of nodes that are closed once they hold more than 5,000 points."""
    return layout.closing_bins(tree_of(spark, d).nodes, 18, 5000)


_BLOCK = f"""{_BATCHED}, {_SUMMARY}, wd AS (SELECT batch_id, n, (bits_x + bits_y + bits_z) AS bits, bits_x, bits_y, bits_z FROM (SELECT batch_id, n, {_WIDTHS} FROM bs)),
bk AS (SELECT *, CAST(c + {blocks.ALIGN} - c % {blocks.ALIGN} AS BIGINT) AS byte_size FROM (SELECT *, (bits * n + 7) // 8 AS c FROM wd))"""


@query(f"{_BLOCK} SELECT batch_id, n, bits_x, bits_y, bits_z, byte_size, CAST(sum(byte_size) OVER (ORDER BY batch_id) - byte_size AS BIGINT) AS byte_offset, CAST(sum(n) OVER (ORDER BY batch_id) - n AS BIGINT) AS first_point FROM bk")
def packed_block_plan(spark, d):
    """Where the bit-packed block of each batch lies."""
    return blocks.plan_blocks(layout.with_batches(uniform(spark, d), BATCH)).select("batch_id", "n", "bits_x", "bits_y", "bits_z", "byte_size", "byte_offset", "first_point")


@query(f"{_BATCHED}, {_SUMMARY} SELECT bt.batch_id, pid - min(pid) OVER (PARTITION BY bt.batch_id) AS place, {_STEPS}, r, g, b FROM bt JOIN bs ON bt.batch_id = bs.batch_id")
def packed_block_roundtrip(spark, d):
    """Steps and colours read back from the files of bit-packed blocks."""
    path = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    blocks.write_blocks(layout.with_batches(uniform(spark, d), BATCH), path)
    return blocks.read_blocks(spark, path, 16).select("batch_id", "place", "qx", "qy", "qz", "r", "g", "b")


# Runs, thinning, streams

_RUNS = "SELECT l_returnflag || l_linestatus AS strategy, l_orderkey * 8 + l_linenumber AS run, l_extendedprice AS duration FROM lineitem"


@query(
    f"""WITH ru AS ({_RUNS}) SELECT strategy, run, duration, runs FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY duration, run) AS rk, count(*) OVER (PARTITION BY strategy) AS runs FROM ru)
WHERE rk = CAST(floor(runs / 2) AS BIGINT) + 1"""
)
def bench_median_run(spark, d):
    """Line items stand for runs: flags for strategies, prices for durations."""
    rows = read(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("strategy"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("run"), F.col("l_extendedprice").alias("duration")
    )
    return stats.median_run(rows, "strategy", "duration", "run")


@query(
    f"""WITH ru AS (SELECT event_type AS label, round(value * 100) AS ticks FROM events) SELECT label, sum(ticks) AS total, min(ticks) AS least, max(ticks) AS most, count(*) AS n,
round(100 * sum(ticks) / (SELECT sum(ticks) FROM ru), 6) AS percent FROM ru GROUP BY 1"""
)
def timing_report(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("label"), F.round(F.col("value") * 100).alias("ticks"))
    return stats.timing_report(rows, "label", "ticks")


@query(
    f"""WITH RECURSIVE pt AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
gr AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS kept, false AS accepted UNION ALL
SELECT i, CASE WHEN ok THEN list_append(kept, {{'x': x, 'y': y}}) ELSE kept END, ok FROM (SELECT pt.i, pt.x, pt.y, gr.kept,
  len(list_filter(gr.kept, lambda k: (k.x - pt.x) * (k.x - pt.x) + (k.y - pt.y) * (k.y - pt.y) < {num(0.08 * 0.08)})) = 0 AS ok FROM gr JOIN pt ON pt.i = gr.i + 1))
SELECT vec_id, x, y, accepted FROM gr JOIN pt ON pt.i = gr.i"""
)
def blue_noise_tiles(spark, d):
    """Accepted and rejected points of greedy thinning over the whole plane."""
    return thinning.poisson_disk(embedding_points(spark, d), "vec_id", spacing=0.08)


_GROW_CENTRE, _GROW_BASE = (0.0, 0.0), 0.15


@query(
    f"""WITH RECURSIVE pd AS (SELECT vec_id, x, y, sqrt((x - {num(0.0)}) * (x - {num(0.0)}) + (y - {num(0.0)}) * (y - {num(0.0)})) AS d FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)),
pt AS (SELECT row_number() OVER (ORDER BY d, vec_id) AS i, * FROM pd),
gr AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, s DOUBLE)[]) AS kept, false AS accepted UNION ALL
SELECT i, CASE WHEN ok THEN list_append(kept, {{'x': x, 'y': y, 's': {num(_GROW_BASE)} + d / 8}}) ELSE kept END, ok FROM (SELECT pt.i, pt.x, pt.y, pt.d, gr.kept,
  len(list_filter(gr.kept, lambda k: sqrt((k.x - pt.x) * (k.x - pt.x) + (k.y - pt.y) * (k.y - pt.y)) < k.s)) = 0 AS ok FROM gr JOIN pt ON pt.i = gr.i + 1))
SELECT vec_id, x, y, d, accepted FROM gr JOIN pt ON pt.i = gr.i"""
)
def growing_blue_noise(spark, d):
    """Greedy thinning from the centre outwards with a spacing that grows with the distance."""
    return thinning.growing_disk(embedding_points(spark, d), "vec_id", _GROW_CENTRE, _GROW_BASE)


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id) = 1 AS single, count(*) AS n FROM events GROUP BY 1")
def distinct_check(spark, d):
    """Whether rows that should agree do: distinct values by group."""
    return stats.distinct_check(read(spark, d, "events"), "event_type", "user_id").select("event_type", F.col("distinct").alias("users"), "single", "n")


_HEIGHT = f"""WITH pt AS (SELECT p_partkey, (p_retailprice - lo) / (hi - lo) AS u, (p_size - s0) / CAST(s1 - s0 AS DOUBLE) AS v FROM part, (SELECT min(p_retailprice) lo, max(p_retailprice) hi, min(p_size) s0, max(p_size) s1 FROM part)),
ht AS (SELECT *, sqrt((u - {num(0.5)}) * (u - {num(0.5)}) + (v - {num(0.5)}) * (v - {num(0.5)})) AS dist FROM pt),
hh AS (SELECT *, cos(8 * dist) * ({num(0.4)} - {num(0.5)} * dist) + {num(0.01)} * cos(350 * u) * sin(350 * v) AS h FROM ht)"""


@query(
    f"""{_HEIGHT}, tl AS (SELECT CAST(least(floor(u * 8), 7) AS BIGINT) AS tx, CAST(least(floor(v * 8), 7) AS BIGINT) AS ty, count(*) AS n, max(h) - min(h) AS relief FROM hh GROUP BY 1, 2),
st AS (SELECT *, CASE WHEN relief < {num(0.05)} THEN 1 WHEN relief < {num(0.15)} THEN 2 WHEN relief < {num(0.3)} THEN 4 ELSE 8 END AS side FROM tl)
SELECT tx, ty, n, side, CAST(i.range % side AS BIGINT) AS sx, CAST(floor(i.range / side) AS BIGINT) AS sy FROM st, range(64) i WHERE i.range < side * side"""
)
def height_field_tiles(spark, d):
    """Parts give the uv positions at which the height field is sampled."""
    rows = read(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("pu"), F.col("p_size").cast("double").alias("pv"))
    (u0, u1), (v0, v1) = bounds(rows, "pu", "pv")
    uv = rows.select("p_partkey", ((F.col("pu") - u0) / (u1 - u0)).alias("u"), ((F.col("pv") - v0) / (v1 - v0)).alias("v"))
    return thinning.height_tiles(thinning.height_field(uv), 8, (0.05, 0.15, 0.3))


_EV = """evl AS (SELECT min(CAST(user_id AS DOUBLE)) u0, max(CAST(user_id AS DOUBLE)) u1, min(CAST(epoch_us(ts) AS DOUBLE)) t0, max(CAST(epoch_us(ts) AS DOUBLE)) t1, min(value) v0, max(value) v1 FROM events),
pcs AS (SELECT event_id, (CAST(user_id AS DOUBLE) - u0) / (u1 - u0) AS x, (CAST(epoch_us(ts) AS DOUBLE) - t0) / (t1 - t0) AS y, (value - v0) / (v1 - v0) AS z FROM events, evl)"""


@query(f"{TREE.replace(oracle.PCS_SQL, _EV)} SELECT * FROM tr")
def incremental_octree(spark, d):
    return replay_events(event_points(spark, d), SMALL)


@query(
    f"""{TREE.replace(oracle.PCS_SQL, _EV)}, vc AS (SELECT CAST(l.range AS INT) AS level, {', '.join(f'i{a} >> (8 - l.range) AS v{a}' for a in 'xyz')}, count(*) AS n FROM lv, range(3) l WHERE leaf_level > l.range GROUP BY ALL)
SELECT * FROM vc"""
)
def incremental_voxels(spark, d):
    """Occupied voxels of the upper levels, kept up by the stream's counts."""
    return replay(event_points(spark, d), SMALL).voxels(3)


@query(f"{TREE}, {oracle.voxel_ctes('average')} SELECT level, vx, vy, vz, r, g, b, samples FROM vo")
def incremental_coloured_voxels(spark, d):
    """Coloured voxels of all levels kept up by a stream of line items, with a compaction on the way."""
    points = skewed(spark, d).select("x", "y", "z", "r", "g", "b", (F.col("k1") * 8 + F.col("k4")).alias("event_id"))
    return replay(points, SMALL, compact_at=1).coloured_voxels()


# Files


_LAS = ", ".join(f"CAST(floor({a} / {num(1e-6)} + {num(0.5)}) AS BIGINT) * {num(1e-6)} + 0 AS {a}" for a in "xyz")


@query(f"{PC} SELECT {_LAS}, r, g, b FROM pc")
def las_scan(spark, d):
    """Points written as LAS files and decoded from their bytes."""
    files = las.to_las_files(uniform(spark, d), scale=1e-6)
    return las.scan_las_files(files, "name").select(*"xyzrgb")


@query(f"{PC} SELECT count(*) AS points, {MM} FROM pc")
def las_headers(spark, d):
    """Points and box of all files from their headers alone."""
    rows = las.header_rows(las.to_las_files(uniform(spark, d), scale=1e-6), "name")
    return rows.agg(F.sum("points").alias("points"), *[f(f"{f.__name__}_{a}").alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)])


@query(f"{PC} SELECT {_LAS}, r, g, b FROM pc")
def las_sorted_rewrite(spark, d):
    """Points written as LAS files in Morton order, and read again from the folder."""
    path = f"{shared_folder(spark)}/las-{uuid.uuid4().hex}"
    sinks.write_morton_sorted_las(uniform(spark, d), path, scale=1e-6, pointsPerFile=20_000)
    return las.read_las_folder(spark, path, 7_000).select(*"xyzrgb")


@query(f"{PC} SELECT {_LAS}, r, g, b FROM (SELECT * FROM pc ORDER BY {ORD} LIMIT 5000)")
def las_crop_file(spark, d):
    """The first points of a LAS file as a file of their own: the limit is the feature."""
    folder = f"{shared_folder(spark)}/crop-{uuid.uuid4().hex}"
    las.write_las_file(uniform(spark, d), f"{folder}/all", "all.las", *ORDER, scale=1e-6)
    las.crop_las_file(spark, f"{folder}/all/all.las", f"{folder}/cropped", "cropped.las", 5000)
    everywhere = (float("-inf"),) * 3, (float("inf"),) * 3
    return las.read_las_box(las.index_las_folder(spark, f"{folder}/cropped", 1000), *everywhere).select(*"xyzrgb")


_BOX = ((0.2, 0.3, 0.1), (0.45, 0.5, 0.6))
_IN_BOX = " AND ".join(f"{a} BETWEEN {num(lo)} AND {num(hi)}" for a, lo, hi in zip("xyz", *_BOX))


@query(f"{PC}, qs AS (SELECT {_LAS}, r, g, b FROM pc) SELECT * FROM qs WHERE {_IN_BOX}")
def las_box_scan(spark, d):
    """Points of a box from LAS files in Morton order, of which only ranges that meet the box are read."""
    path = f"{shared_folder(spark)}/las-{uuid.uuid4().hex}"
    sinks.write_morton_sorted_las(uniform(spark, d), path, scale=1e-6)
    return las.read_las_box(las.index_las_folder(spark, path, 1000), *_BOX).select(*"xyzrgb")


@query("SELECT CAST(count(*) AS BIGINT) AS points FROM lineitem")
def probe_point_counts(spark, d):
    """The point count that each file's header holds at byte 107, summed."""
    return las.probe_int32(las.to_las_files(uniform(spark, d), scale=1e-6), 107, "name").agg(F.sum("value").alias("points"))


@query(f"{TREE}, {oracle.described()} SELECT concat_ws(',', name, level, n, child_mask, ix, iy, iz) AS line FROM ds")
def node_csv(spark, d):
    return sinks.node_lines(octree.describe(tree_of(spark, d).nodes))


_FIXED = ", ".join(f"CAST(floor({a} / {num(1e-6)} + {num(0.5)}) AS BIGINT) * {num(1e-6)} + 0 AS {a}" for a in "xyz")


@query(
    f"""{TREE}, sl AS (SELECT level, key, CAST(sum(n) OVER (ORDER BY level, key) - n AS BIGINT) AS o FROM tr WHERE is_leaf)
SELECT lv.leaf_level AS level, lv.leaf_key AS key, CAST(floor(o / 5000) AS BIGINT) AS bin, {_FIXED}, r, g, b FROM lv JOIN sl ON lv.leaf_level = sl.level AND lv.leaf_key = sl.key"""
)
def payload_scan(spark, d):
    """Leaf points encoded as records and scanned in bins of nodes that lie together."""
    t = tree_of(spark, d)
    return hierarchy.scan_payload(hierarchy.encode_payload(t.points, 1e-6), octree.leaf_slices(t.nodes), 1e-6, 5000)


_STEP_SQL = ", ".join(f"CAST(floor({a} / {num(1e-6)} + {num(0.5)}) AS BIGINT) * {num(1e-6)} + 0 AS {a}" for a in "xyz")


def _octree_files(spark, d, voxels: bool = False) -> str:
    t = tree_of(spark, d)
    path = f"{shared_folder(spark)}/octree-{uuid.uuid4().hex}"
    octree_file.write_octree_file(octree.describe(t.nodes), octree_file.node_samples(t.points, t.voxels("average") if voxels else None, SMALL.grid_bits), path, 1e-6)
    return path


@query(
    f"""{TREE}, {oracle.described()}, {oracle.voxel_ctes('average')}, al AS (SELECT leaf_level AS level, leaf_key AS key, x, y, z, r, g, b FROM lv UNION ALL
SELECT level, {morton_sql(*[f'(v{a} >> {SMALL.grid_bits})' for a in 'xyz'], SMALL.max_depth)} AS key, {', '.join(f'(v{a} + {num(0.5)}) / pow(CAST(2 AS DOUBLE), level + {SMALL.grid_bits}) AS {a}' for a in 'xyz')}, r, g, b FROM vo)
SELECT name, al.level, {_STEP_SQL}, r, g, b FROM al JOIN ds ON al.level = ds.level AND al.key = ds.key"""
)
def octree_file_roundtrip(spark, d):
    """Leaf points and inner nodes' voxels written as an octree file and read back."""
    return octree_file.read_octree_file(spark, _octree_files(spark, d, True), pointsPerPartition=20_000).select("name", "level", *"xyzrgb")


@query(f"{_VISIBLE} SELECT name, vs.level, {_STEP_SQL}, r, g, b FROM lv JOIN vs ON lv.leaf_level = vs.level AND lv.leaf_key = vs.key WHERE visible")
def octree_file_view(spark, d):
    """Points of the leaves that a camera sees, of which alone bytes are read."""
    return octree_file.read_octree_file(spark, _octree_files(spark, d), camera=CAMERA, pointsPerPartition=20_000).select("name", "level", *"xyzrgb")


@query(
    f"""{TREE}, {oracle.described()}, sl AS (SELECT level, key, CAST(sum(n) OVER (ORDER BY level, key) - n AS BIGINT) AS o FROM tr WHERE is_leaf)
SELECT name, ds.level, CASE WHEN is_leaf THEN 1 ELSE 0 END AS node_type, child_mask, n AS num_points, 18 * coalesce(o, 0) AS byte_offset, 18 * n AS byte_size
FROM ds LEFT JOIN sl ON ds.level = sl.level AND ds.key = sl.key"""
)
def octree_hierarchy_roundtrip(spark, d):
    """Nodes encoded as hierarchy chunks and decoded again."""
    t = tree_of(spark, d)
    slices = octree.leaf_slices(t.nodes).select("level", "key", "slice_offset")
    return hierarchy.decode_chunks(hierarchy.encode_chunks(octree.describe(t.nodes).join(slices, ["level", "key"], "left")))
