"""Invariants of the tree, and operators that SQL can't say, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from octaspark.functions import geometry as g
from octaspark.operators import layout, octree, ordering, thinning, view
from octaspark.operators.octree import TreeSpec
from octaspark.plans.build import LodTree
from octaspark.sources import hierarchy, las, sinks, text
from octaspark.sources.tables import ORDER, event_points
from octaspark.streaming.incremental import IncrementalTree, replay_events


def cloud(spark, xyz):
    rows = [(float(x), float(y), float(z), k % 256, 7, 200, k, 0, 0, 0, 0, 0.0) for k, (x, y, z) in enumerate(xyz)]
    return spark.createDataFrame(rows, "x double, y double, z double, r int, g int, b int, k1 long, k2 long, k3 long, k4 long, k5 long, k6 double")


def literal_leaves(keys, spec):
    """Bottom-up merge as it is told: counters join their parent while it stays small enough."""
    count = {spec.max_depth: Counter(keys)}
    for level in range(spec.max_depth - 1, -1, -1):
        up = Counter()
        for k, n in count[level + 1].items():
            up[k >> 3] += n
        count[level] = up
    main = {k for k, n in count[spec.main_depth].items() if n > spec.capacity}

    def inner(level, key):
        if level == spec.max_depth:
            return False
        if level == spec.main_depth:
            return key in main
        if level > spec.main_depth and key >> 3 * (level - spec.main_depth) not in main:
            return False
        return count[level][key] >= spec.capacity

    out, todo = {}, [(0, 0)]
    while todo:
        level, key = todo.pop()
        if inner(level, key):
            todo += [(level + 1, c) for c in range(key << 3, (key << 3) + 8) if count[level + 1][c]]
        elif count[level][key]:
            out[level, key] = count[level][key]
    return out


def small_clouds():
    rng = np.random.default_rng(5)
    yield rng.random((300, 3)) ** 3, TreeSpec(2, 4, 20, 3)
    yield rng.random((50, 3)), TreeSpec(2, 4, 100, 3)  # fewer points than the capacity
    yield np.full((40, 3), 0.3), TreeSpec(2, 4, 10, 3)  # all in one place
    yield np.full((20, 3), 0.3), TreeSpec(2, 4, 20, 3)  # exactly the capacity where the main grid ends
    yield np.ones((30, 3)), TreeSpec(1, 3, 8, 2)  # the upper corner
    yield np.array([[0.5, 0.5, 0.5]]), TreeSpec(2, 3, 5, 2)


@pytest.mark.parametrize("case", range(6))
def test_tree_equals_the_literal_merge(spark, case):
    xyz, spec = list(small_clouds())[case]
    indexed = octree.with_fine_index(cloud(spark, xyz), spec)
    keys = [r.key for r in indexed.select("key").collect()]
    tree = octree.nodes(octree.cell_counts(indexed), spec)
    got = {(r.level, r.key): r.n for r in tree.where("is_leaf").collect()}
    assert got == literal_leaves(keys, spec)
    placed = octree.with_leaf(indexed, spec).collect()
    assert Counter((r.leaf_level, r.leaf_key) for r in placed) == Counter(got)
    for r in placed:  # inside the leaf's half-open box, the last cell closed
        size = 2.0**-r.leaf_level
        for a, c in zip((r.x, r.y, r.z), (r.ix, r.iy, r.iz)):
            low = (c >> (spec.fine_bits - r.leaf_level)) * size
            assert low <= a < low + size or a == 1.0 == low + size


def test_occupancy_is_the_same_for_all_strategies(spark):
    xyz, spec = next(small_clouds())
    tree = LodTree.of(cloud(spark, xyz), spec)
    want = {(r.level, r.key): r.num_voxels for r in tree.voxel_counts().collect()}
    for strategy in ("average", "first", "neighborhood"):
        rows = tree.voxels(strategy).withColumn("key", g.morton(*[F.shiftright(f"v{a}", spec.grid_bits) for a in "xyz"])).groupBy("level", "key").count().collect()
        assert {(r.level, r.key): r["count"] for r in rows} == want
    assert set(want) == {(r.level, r.key) for r in tree.nodes.where("NOT is_leaf").collect()}


def test_order_and_partitions_do_not_matter(spark):
    xyz, spec = next(small_clouds())
    points = cloud(spark, xyz)
    a, b = (sorted(map(tuple, LodTree.of(p, spec).voxels("average").collect())) for p in (points.repartition(7), points.coalesce(1).orderBy(F.desc("k1"))))
    assert a == b


def test_morton(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(2**21) for _ in range(3)) for _ in range(50)] + [(0, 0, 0), (2**21 - 1,) * 3]
    df = spark.createDataFrame(rows, "x long, y long, z long")
    code = lambda x, y, z: sum(((v >> i) & 1) << (3 * i + 2 - k) for i in range(21) for k, v in enumerate((x, y, z)))
    for r in df.select("*", g.morton(*map(F.col, "xyz")).alias("m"), g.morton(*map(F.col, "xyz"), order="zyx").alias("n")).collect():
        assert r.m == code(r.x, r.y, r.z) and r.n == code(r.z, r.y, r.x)
    back = df.select("*", *[c.alias(n) for c, n in zip(g.morton_inverse(g.morton(*map(F.col, "xyz")), 21), "abc")]).collect()
    assert all((r.a, r.b, r.c) == (r.x, r.y, r.z) for r in back)


def test_colours(spark):
    r = spark.range(1).select(g.pack_rgb(F.lit(1), F.lit(2), F.lit(3)).alias("p"), g.colour_to_8bit(F.lit(65535)).alias("hi"), g.colour_to_8bit(F.lit(200)).alias("lo"), *[c.alias(n) for c, n in zip(g.unpack_rgb(F.lit(0x332211)), "rgb")]).first()
    assert tuple(r) == (1 | 2 << 8 | 3 << 16, 255, 200, 0x11, 0x22, 0x33)


def test_frustum():
    camera = view.Camera.at((2, 2, 2), (0.5, 0.5, 0.5), 64, 64)
    planes = g.frustum_planes(camera.matrix)
    inside = lambda p: all(sum(n * v for n, v in zip(q[:3], p)) + q[3] >= 0 for q in planes)
    assert inside((0.5, 0.5, 0.5)) and not inside((3, 3, 3)) and not inside((0.5, 0.5, 9))


def test_ranks(spark):
    values = [random.Random(3).randrange(50) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(6)
    got = {r.id: r["rank"] for r in ordering.ranked(df, "v", "id").collect()}
    assert got == {i: k for k, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert ordering.ranked(df.limit(0), "v").count() == 0


def test_ranks_of_wide_rows(spark):
    """More rows than the sample that range bounds are drawn from, and columns that aren't keys."""
    n = 60_000
    wide = spark.range(n).select(((F.col("id") * 7919) % n).alias("v"), *[F.sha2(F.concat_ws("-", "id", F.lit(k)), 256).alias(f"c{k}") for k in range(4)]).repartition(6)
    read = F.sum(sum(F.length(f"c{k}") for k in range(1, 4))).alias("read")  # the other columns go through the exchange too
    got = ordering.ranked(wide, "v").agg(F.count("*"), F.count_if(F.col("rank") != F.col("v")), read).first()
    assert tuple(got) == (n, 0, 192 * n)
    want = sum(F.floor((F.col("v") + 4 - r) / 5) * r for r in range(1, 5))
    got = ordering.running_sum(wide, F.col("v") % 5, "v", name="s").agg(F.count("*"), F.count_if(F.col("s") != want), read).first()
    assert tuple(got) == (n, 0, 192 * n)


def test_mask_tree_round_trip(spark):
    keys = random.Random(2).sample(range(8**4), 300)
    cells = spark.createDataFrame([(k,) for k in keys], "key long")
    masks = layout.mask_tree(cells, 4)
    assert {r.key for r in layout.decode_masks(masks, 4).collect()} == set(keys)
    order = [(r.level, r.key) for r in layout.depth_first(masks, 4).orderBy("ord").collect()]
    assert order[0] == (0, 0)
    for i, (level, key) in enumerate(order[1:], 1):
        assert (level - 1, key >> 3) in order[:i]


@pytest.mark.parametrize("crowded", [False, True])
def test_poisson_disk(spark, crowded):
    rng = np.random.default_rng(0)
    xy = rng.random((400, 2)) if not crowded else np.concatenate([rng.random((100, 2)), 0.5 + 0.02 * rng.random((300, 2))])[rng.permutation(400)]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {r.id: r.accepted for r in thinning.poisson_disk(points, "id", 0.08).collect()}
    kept, want = [], {}
    for k, (x, y) in enumerate(xy.tolist()):
        want[k] = all((x - a) ** 2 + (y - b) ** 2 >= 0.08**2 for a, b in kept)
        if want[k]:
            kept.append((x, y))
    assert got == want
    assert thinning.poisson_disk(points.limit(0), "id", 0.08).count() == 0


def test_incremental_equals_batch(spark, sf, tmp_path):
    points, spec = event_points(spark, sf), TreeSpec(2, 4, 100, 3)
    want = {tuple(r) for r in octree.nodes(octree.cell_counts(octree.with_fine_index(points, spec)), spec).collect()}
    assert {tuple(r) for r in replay_events(points, spec, 3).collect()} == want
    tree = IncrementalTree(spark, spec, str(tmp_path))
    for k in (0, 1, 1):  # a batch that comes again counts once
        tree.add(points.where(F.col("event_id") % 2 == k), k)
    assert {tuple(r) for r in tree.nodes().collect()} == want
    tree.compact()
    assert {tuple(r) for r in tree.nodes().collect()} == want and len(list((tmp_path / "state").iterdir())) == 1


def test_las_files(spark, tmp_path):
    n = 1000
    rng = np.random.default_rng(1)
    cols = {a: np.floor(rng.random(n) * 1000) / 1000 for a in "xyz"} | {c: rng.integers(0, 256, n) for c in "rgb"}
    for point_format, version in ((2, (1, 2)), (3, (1, 3)), (7, (1, 4))):
        (tmp_path / f"{point_format}.las").write_bytes(las.encode(cols, 0.001, point_format, version))
    paths = [str(tmp_path / f"{k}.las") for k in (2, 3, 7)]
    got = las.read_las(spark, *paths, pointsPerPartition=300).toPandas()
    assert len(got) == 3 * n
    low = {a: cols[a].min() for a in "xyz"}
    for _, part in got.sort_values("point_id").groupby("file"):
        for a in "xyz":
            assert np.allclose(part[a], cols[a] - low[a])
        for c in "rgb":
            assert (part[c].to_numpy() == cols[c]).all()
    assert las.read_las(spark, paths[0], maxPoints=10).count() == 10


@pytest.mark.parametrize("point_format", sorted(las.RECORD_LENGTH))
def test_all_point_formats(point_format):
    cols = {a: np.arange(4) / 2 for a in "xyz"} | {c: np.arange(4) for c in "rgb"}
    data = las.encode(cols, 0.001, point_format, (1, 4))
    h = las.parse_header(data)
    got = las.decode_records(data[h.offset_to_points :], h)
    assert got["x"].tolist() == cols["x"].tolist()
    assert got["g"].tolist() == ([0, 1, 2, 3] if point_format in las.COLOUR_OFFSET else [0] * 4)


def test_las_sink(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(*np.round(rng.random(3), 3).tolist(), k % 256, 1, 2, k) for k in range(1000)]
    points = spark.createDataFrame(rows, "x double, y double, z double, r int, g int, b int, k1 long").repartition(3)
    for _ in range(2):  # again over the first files
        las.write_las(points, str(tmp_path / "out"), pointFormat=3, pointsPerFile=100)
    files = list((tmp_path / "out").iterdir())
    assert len(files) >= 10 and all(f.suffix == ".las" for f in files)
    low = [min(r[k] for r in rows) for k in range(3)]
    got = sorted((round(r.x + low[0], 3), round(r.y + low[1], 3), round(r.z + low[2], 3), r.r) for r in las.read_las_folder(spark, str(tmp_path / "out"), 70).collect())
    assert got == sorted((*r[:3], r[3]) for r in rows)
    assert las.parse_header(files[0].read_bytes()[:375]).point_format == 3


def test_bad_las_files():
    good = las.encode({a: np.zeros(3) for a in "xyz"} | {c: np.zeros(3) for c in "rgb"})
    for at, value in ((104, 11), (104, 2 | 0x80), (0, 0)):
        data = bytearray(good)
        data[at] = value
        with pytest.raises(las.LasError):
            las.parse_header(bytes(data))
    with pytest.raises(las.LasError):
        las.parse_header(good[:100])
    with pytest.raises(las.LasError):
        las.decode_records(good[227:-1], las.parse_header(good))


def test_hierarchy_chunks():
    import struct

    data = b"".join(struct.pack(hierarchy.RECORD, *r) for r in ((0, 0b101, 9, 0, 0), (1, 0, 4, 0, 72), (2, 0, 5, 0, 0)))
    assert [(r[0], r[2]) for r in hierarchy.decode_chunk("r", data)] == [("r", 0), ("r0", 1), ("r2", 2)]
    for bad in (data[:-1], data[: hierarchy.RECORD_SIZE], data + data[: hierarchy.RECORD_SIZE]):
        with pytest.raises(ValueError):
            hierarchy.decode_chunk("r", bad)


def test_text_inputs_and_sinks(spark, tmp_path):
    (tmp_path / "v.csv").write_text("1,2,3,4,5,6\nbad line\n7,8,9,10,11,12\n")
    assert {tuple(r) for r in text.read_voxel_csv(spark, str(tmp_path / "v.csv")).collect()} == {(1, 2, 3, 4, 5, 6), (7, 8, 9, 10, 11, 12)}
    (tmp_path / "m.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nelement face 1\nend_header\n0.5 1 2 0 0\n3 4 5 0 0\n3 0 1 1\n")
    assert [(r.x, r.y, r.z) for r in text.read_ply_vertices(spark, str(tmp_path / "m.ply")).orderBy("vertex_id").collect()] == [(0.5, 1.0, 2.0), (3.0, 4.0, 5.0)]
    xyz, spec = next(small_clouds())
    tree = LodTree.of(cloud(spark, xyz), spec)
    sinks.write_octree(tree.nodes, tree.points, tree.voxels("first"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/points")).count() == 300
    assert spark.read.json(str(tmp_path / "out/metadata")).first().points == 300
    sinks.write_morton_sorted(tree.points.select("x", "y", "z", *ORDER), str(tmp_path / "sorted"))
    assert spark.read.parquet(str(tmp_path / "sorted")).count() == 300


@pytest.mark.parametrize("sizes", [[], [5], [5, 11], [11, 0, 0, 3, 8], None])
def test_bins_with_reset_equal_the_loop(spark, sizes):
    rng = random.Random(7)
    sizes = [rng.choice((0, 1, 2, 3, 9, 12, 40)) for _ in range(700)] if sizes is None else sizes
    want, held, bin_ = [], 0, 0
    for n in sizes:
        if held > 10:
            held, bin_ = 0, bin_ + 1
        held += n
        want.append(bin_)
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n long").repartition(5)
    got = {r.id: r.bin for r in ordering.bins_with_reset(df, F.col("n"), 10, "id").collect()}
    assert [got[k] for k in range(len(sizes))] == want


def test_bins_with_reset_of_many_nodes(spark):
    n, most = 100_000, 1000
    sizes = (np.arange(n) * 7919 % 97).tolist()
    cuts, held = [], 0
    for k, v in enumerate(sizes):
        if held > most:
            cuts.append(k)
            held = 0
        held += v
    df = spark.range(n).select("id", ((F.col("id") * 7919) % 97).alias("n"))
    got = ordering.bins_with_reset(df, F.col("n"), most, "id").groupBy("bin").agg(F.min("id").alias("first")).orderBy("bin").collect()
    assert [r["first"] for r in got] == [0, *cuts] and [r.bin for r in got] == list(range(len(cuts) + 1))


@pytest.mark.parametrize("crowded", [False, True])
def test_growing_disk(spark, crowded):
    """Greedy thinning with spacing ``2 + d / 8``, with ties in the distance."""
    rng = np.random.default_rng(11)
    xy = rng.normal(0, 14, (300, 2)) if not crowded else np.concatenate([rng.normal(0, 25, (120, 2)), 9 + 0.5 * rng.random((180, 2))])
    xy = np.concatenate([xy, -xy[:20], [[0.0, 0.0]] * 3])[rng.permutation(len(xy) + 23)]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {r.id: r.accepted for r in thinning.growing_disk(points, "id", (0.0, 0.0), 2.0, 8.0).collect()}
    kept, want = [], {}
    for k in sorted(range(len(xy)), key=lambda k: (np.sqrt(xy[k][0] ** 2 + xy[k][1] ** 2), k)):
        x, y = xy[k].tolist()
        want[k] = all(np.sqrt((x - a) ** 2 + (y - b) ** 2) >= 2 + d / 8 for a, b, d in kept)
        if want[k]:
            kept.append((x, y, float(np.sqrt(x * x + y * y))))
    assert got == want and 5 < len(kept) < len(xy) / 2
    if not crowded:
        assert thinning.growing_disk(points.limit(0), "id", (0.0, 0.0), 2.0).count() == 0
        with pytest.raises(ValueError):
            thinning.growing_disk(points, "id", (0.0, 0.0), 2.0, 1.0)


def test_rays_through_the_frustum_equal_a_loop(spark):
    rng = np.random.default_rng(12)
    planes = g.frustum_planes(view.Camera.at((2, 2, 2), (0.5, 0.5, 0.5), 64, 64).matrix)
    for eye in ((2.0, 2.0, 2.0), (0.4, 0.5, 0.6), (-3.0, 0.5, 0.5)):
        xyz = rng.random((60, 3)) * 3 - 1
        points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "id long, x double, y double, z double")
        for r in view.ray_through_frustum(points, eye, planes).collect():
            way = np.array([r.x, r.y, r.z]) - eye
            at = [-(np.dot(p[:3], eye) + p[3]) / np.dot(p[:3], way) for p in planes]
            ahead = [t for t in at if t > 0]
            assert r.closest == pytest.approx(min(ahead)) if ahead else r.closest is None
            # The inner interval, from where each half-space holds.
            low = max([0.0, *(t for t, p in zip(at, planes) if np.dot(p[:3], way) > 0)])
            high = min([np.inf, *(t for t, p in zip(at, planes) if np.dot(p[:3], way) < 0)])
            assert (r.t_in, r.t_out) == ((None, None) if low > high else (pytest.approx(low), pytest.approx(high)))
            if low <= high:
                middle = eye + way * ((low + min(high, low + 1)) / 2)
                assert all(np.dot(p[:3], middle) + p[3] > -1e-9 for p in planes)


def test_coloured_stream_equals_a_build_of_all_points(spark, tmp_path):
    xyz, spec = next(small_clouds())
    points = cloud(spark, xyz).cache()
    tree = IncrementalTree(spark, spec, str(tmp_path))
    assert tree.nodes().count() == 0

    def same(part):
        want = LodTree.of(part, spec)
        assert sorted(map(tuple, tree.coloured_voxels().collect())) == sorted(map(tuple, want.voxels("average").collect()))
        assert {tuple(r) for r in tree.nodes().collect()} == {tuple(r) for r in want.nodes.collect()}

    for k in (0, 1, 1, 2):  # leaves split from batch to batch, and one comes again
        tree.add(points.where(F.col("k1") % 4 == k), k)
    same(points.where("k1 % 4 < 3"))
    tree.compact()
    tree.add(points.where("k1 % 4 = 1"), 1)  # comes again after it was put together
    tree.add(points.where("k1 % 4 = 3"), 3)
    same(points)
    # A crash after the sums were written but before they count, and one before the old ones went.
    tree.state().write.parquet(str(tmp_path / "state/upto-3-crashed"))
    same(points)
    tree.compact()
    (tmp_path / "state/batch=2").mkdir()
    same(points)
    assert len([p for p in (tmp_path / "done").iterdir() if not p.name.startswith(".")]) == 1
