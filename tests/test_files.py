"""Octree files, bit-packed blocks, the LAS sink's ranges and the box index, beyond what SQL compares."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from octaspark.operators import layout, octree, view
from octaspark.operators.octree import TreeSpec
from octaspark.plans.build import LodTree
from octaspark.sources import blocks, files, hierarchy, las, octree_file
from octaspark.sources.files import Assembly
from tests.test_operators import cloud, small_clouds

CAMERA = view.Camera.at((1.3, -0.6, 0.9), (0.4, 0.4, 0.3), 64, 64, lod=0.75)


@pytest.fixture(scope="module")
def written_tree(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    xyz = np.concatenate([rng.random((1500, 3)) ** 3, np.full((300, 3), 0.9)])  # a crowded deepest leaf
    spec = TreeSpec(2, 5, 40, 3)
    tree = LodTree.of(cloud(spark, xyz), spec)
    described = octree.describe(tree.nodes).cache()
    path = str(tmp_path_factory.mktemp("octree") / "out")
    samples = octree_file.node_samples(tree.points, tree.voxels("average"), spec.grid_bits)
    for _ in range(2):  # again over the first
        octree_file.write_octree_file(described, samples, path, 1e-6)
    want = sorted((r.level, r.key, *(int(v / 1e-6 + 0.5) / 1e6 for v in (r.x, r.y, r.z)), r.r) for r in samples.collect())
    return path, described.collect(), want, described


def rows_of(df):
    return sorted((r.level, r.key, *(round(v, 6) for v in (r.x, r.y, r.z)), r.r) for r in df.collect())


def test_files_hold_all_nodes_in_order(written_tree):
    path, nodes, want, _ = written_tree
    assert sorted(os.listdir(path)) == ["hierarchy.bin", "metadata.json", "octree.bin"]
    assert os.path.getsize(f"{path}/octree.bin") == 18 * len(want)
    meta = json.load(open(f"{path}/metadata.json"))
    data = open(f"{path}/hierarchy.bin", "rb").read()
    found, todo = {}, [("r", 0, meta["hierarchy"]["firstChunkSize"])]
    while todo:  # a plain walk over the whole file
        root, at, size = todo.pop()
        for name, level, kind, mask, n, offset, length in hierarchy.decode_chunk(root, data[at : at + size]):
            if kind == hierarchy.PROXY:
                todo.append((name, offset, length))
            else:
                found[name] = (kind, mask, n, offset)
                assert length == 18 * n
    assert {n: (k, m) for n, (k, m, *_) in found.items()} == {r.name: (hierarchy.LEAF if r.is_leaf else hierarchy.NORMAL, r.child_mask) for r in nodes}
    assert sum(n for *_, n, _ in found.values()) == meta["points"] == len(want)
    assert len(data) > meta["hierarchy"]["firstChunkSize"]  # more than one chunk


@pytest.mark.parametrize("options", [{}, {"pointsPerPartition": 37}, {"planChunks": 1}, {"planChunks": 0}])
def test_whole_file_comes_back(spark, written_tree, options):
    path, _, want, _ = written_tree
    assert rows_of(octree_file.read_octree_file(spark, path, **options)) == want


@pytest.mark.parametrize("plan_chunks", [20_000, 1])
def test_a_view_reads_bytes_of_visible_nodes_only(spark, written_tree, plan_chunks):
    path, _, want, described = written_tree
    seen = {(r.level, r.key) for r in view.with_visibility(described, CAMERA).where("visible").collect()}
    visible = [r for r in want if r[:2] in seen]
    assert 0 < len(visible) < len(want) / 2
    options = {"path": path, "camera": json.dumps({"matrix": CAMERA.matrix, "threshold": CAMERA.threshold}), "planChunks": str(plan_chunks)}
    reader, count = octree_file.OctreeReader(options), {"octree.bin": 0, "hierarchy.bin": 0}
    plain = reader.bytes_of

    def counted(file, at, size):
        count[file] += size
        return plain(file, at, size)

    reader.bytes_of = counted
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == len(visible) and count["octree.bin"] == 18 * len(visible)
    assert count["hierarchy.bin"] < os.path.getsize(f"{path}/hierarchy.bin")  # chunks that hold nothing visible aren't read
    assert rows_of(octree_file.read_octree_file(spark, path, camera=CAMERA, planChunks=plan_chunks)) == visible


def test_filters_are_pushed_down(spark, written_tree):
    path, _, want, _ = written_tree
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = octree_file.read_octree_file(spark, path).where("level <= 2 AND x > 0.25 AND x <= 0.6 AND y < 0.5 AND z >= 0.001")
        assert rows_of(df) == [r for r in want if r[0] <= 2 and 0.25 < r[2] <= 0.6 and r[3] < 0.5 and r[4] >= 0.001]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    reader = octree_file.PushingOctreeReader({"path": path})
    list(reader.pushFilters([octree_file.LessThanOrEqual(("level",), 1), octree_file.GreaterThan(("x",), 0.51)]))
    names = {s.name for p in reader.partitions() for s in p.slices}
    assert names and all(len(n) <= 2 and (len(n) == 1 or n[1] in "4567") for n in names)


def test_box_and_level_options(spark, written_tree):
    path, _, want, _ = written_tree
    low, high = (0.1, 0.0, 0.2), (0.3, 0.4, 0.9)
    inside = lambda r: all(lo <= v <= hi for v, lo, hi in zip(r[2:5], low, high))
    got = rows_of(octree_file.read_octree_file(spark, path, box=(*low, *high), max_level=3))
    assert set(filter(inside, got)) == {r for r in want if r[0] <= 3 and inside(r)} and len(got) < len(want)


def test_empty_and_cut_off_files(spark, tmp_path):
    xyz, spec = list(small_clouds())[5]
    tree = LodTree.of(cloud(spark, xyz), spec)
    path = str(tmp_path / "one")
    octree_file.write_octree_file(octree.describe(tree.nodes), octree_file.node_samples(tree.points, None, 3), path)
    assert [(r.name, r.x) for r in octree_file.read_octree_file(spark, path).collect()] == [("r", 0.5)]
    with open(f"{path}/octree.bin", "r+b") as f:
        f.truncate(10)
    with pytest.raises(Exception, match="truncated"):
        octree_file.read_octree_file(spark, path).collect()
    none = tree.points.limit(0)
    octree_file.write_octree_file(octree.describe(tree.nodes.limit(0)), octree_file.node_samples(none, None, 3), str(tmp_path / "none"))
    assert octree_file.read_octree_file(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="32 bits"):
        octree_file.write_octree_file(octree.describe(tree.nodes), octree_file.node_samples(tree.points, None, 3), str(tmp_path / "far"), 1e-12)


def test_assembly_repeats_and_refuses_object_stores(spark, tmp_path):
    rows = spark.createDataFrame([(3, bytearray(b"defg")), (0, bytearray(b"abc")), (3, bytearray(b"defg"))], "at long, data binary")
    out = Assembly(str(tmp_path / "a"))
    assert out.write("f.bin", rows) == 11
    out.commit()
    assert (tmp_path / "a/f.bin").read_bytes() == b"abcdefg"
    with pytest.raises(ValueError):
        files.shared_path("s3://bucket/a")


def test_bit_fields_cross_byte_borders():
    rng = np.random.default_rng(2)
    for widths in ((5, 7, 3), (0, 0, 0), (1, 0, 13), (31, 33, 2)):
        n = 50
        fields = [rng.integers(0, 1 << w, n) if w else np.zeros(n, np.int64) for w in widths]
        data = blocks.pack_bits(list(zip(fields, widths)))
        plain = sum(int(v) << (i * sum(widths) + sum(widths[:k])) for k, f in enumerate(fields) for i, v in enumerate(f))
        assert int.from_bytes(data, "little") == plain and len(data) == -(-n * sum(widths) // 8)
        assert all((a == b).all() for a, b in zip(blocks.unpack_bits(data, n, list(widths)), fields))


def test_blocks_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.random((400, 3)), np.full((60, 3), 0.25)])  # the last batches have no extent
    batched = layout.with_batches(cloud(spark, xyz), 30)
    plan = blocks.write_blocks(batched, str(tmp_path / "b")).toPandas().sort_values("batch_id")
    got = blocks.read_blocks(spark, str(tmp_path / "b"), per_task=4).toPandas().sort_values(["batch_id", "place"])
    assert len(got) == len(xyz)
    order = sorted(range(len(xyz)))  # the cloud's first key numbers its points
    assert np.abs(got[["x", "y", "z"]].to_numpy() - xyz[order]).max() < 0.001 + 1e-6
    assert (got["r"].to_numpy() == np.array(order) % 256).all()
    bits = plan[["bits_x", "bits_y", "bits_z"]].sum(axis=1) * plan["n"]
    assert (plan["byte_size"] == [blocks.block_size(int(b)) for b in bits]).all() and (plan["byte_size"] % blocks.ALIGN == 0).all()
    assert os.path.getsize(tmp_path / "b/points.bin") == plan["byte_size"].sum() and os.path.getsize(tmp_path / "b/batches.bin") == 64 * len(plan)


def test_las_sink_far_from_the_origin(spark, tmp_path):
    far = [(5_412_345.678 + k / 1000, 4.5e6 + k, -2e6 - k, k % 256, 1, 2) for k in range(500)]
    points = spark.createDataFrame(far, "x double, y double, z double, r int, g int, b int").repartition(3)
    las.write_las(points, str(tmp_path / "out"), pointsPerFile=100)
    low = [min(r[k] for r in far) for k in range(3)]
    got = sorted((round(r.x + low[0], 3), round(r.y + low[1], 3), round(r.z + low[2], 3), r.r) for r in las.read_las_folder(spark, str(tmp_path / "out")).collect())
    assert got == sorted((round(r[0], 3), *r[1:4]) for r in far)
    with pytest.raises(ValueError, match="32 bits"):
        las.encode({"x": np.array([5_412_345.678]), "y": np.zeros(1), "z": np.zeros(1)} | {c: np.zeros(1) for c in "rgb"})
    with pytest.raises(Exception, match="32 bits"):
        las.write_las(points, str(tmp_path / "out"), scale=1e-6, offset="0,0,0")
    assert las.read_las_folder(spark, str(tmp_path / "out")).count() == 500  # the failure left the old files


def test_short_las_files(spark, tmp_path):
    cols = {a: np.arange(600) / 10 for a in "xyz"} | {c: np.zeros(600) for c in "rgb"}
    data = bytearray(las.encode(cols))
    struct.pack_into("<I", data, 107, 1000)
    (tmp_path / "short.las").write_bytes(bytes(data))
    for read in (lambda: las.read_las_folder(spark, str(tmp_path)), lambda: las.read_las_folder(spark, str(tmp_path), 700), lambda: las.index_las_folder(spark, str(tmp_path))):
        with pytest.raises(Exception, match="truncated file"):
            read().count()
    held = spark.read.format("binaryFile").load(str(tmp_path / "short.las"))
    with pytest.raises(Exception, match="truncated file"):
        las.scan_las_files(held).count()


def test_box_index_reads_less(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(*np.round(rng.random(3), 3).tolist(), 1, 2, 3) for _ in range(4000)]
    points = spark.createDataFrame(rows, "x double, y double, z double, r int, g int, b int")
    las.write_las(points.repartitionByRange(4, "x").sortWithinPartitions("x"), str(tmp_path / "out"))
    index = las.index_las_folder(spark, str(tmp_path / "out"), 100)
    read = []
    for size in (0.05, 0.4, 1.0):
        low, high = (0.2995, -1.0, -1.0), (0.3005 + size, 2.0, 2.0)
        met = las.ranges_in_box(index, low, high)
        read.append(met.agg(F.sum("count")).first()[0])
        assert las.read_las_box(index, low, high).count() == sum(low[0] <= r[0] <= high[0] for r in rows)
    assert read[0] < 500 < read[1] < 2500 and index.agg(F.sum("count")).first()[0] == 4000
    assert las.read_las_box(index, (2, 2, 2), (3, 3, 3)).count() == 0


def test_one_las_file_by_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(*np.round(rng.random(3) + 1000, 3).tolist(), k % 256, 1, 2, k) for k in range(900)]
    points = spark.createDataFrame(rows, "x double, y double, z double, r int, g int, b int, k long").repartition(5)
    las.write_las_file(points, str(tmp_path / "one"), "all.las", "k", point_format=3)
    data = (tmp_path / "one/all.las").read_bytes()
    h = las.parse_header(data)
    assert (h.points, h.point_format, len(data)) == (900, 3, 375 + 900 * 34) and h.low == tuple(min(r[k] for r in rows) for k in range(3))
    got = las.decode_records(data[375:], h, (0, 0, 0))
    assert np.allclose(got["x"], [r[0] for r in rows]) and got["r"].tolist() == [r[3] for r in rows]
    for most, want in ((70, 70), (5000, 900), (0, 0)):
        assert las.crop_las_file(spark, str(tmp_path / "one/all.las"), str(tmp_path / f"c{most}"), "c.las", most, per_task=32) == want
        part = (tmp_path / f"c{most}/c.las").read_bytes()
        assert las.parse_header(part).points == want and part[375:] == data[375 : 375 + 34 * want]
    las.write_las_file(points.limit(0), str(tmp_path / "one"), "all.las", "k")
    assert las.parse_header((tmp_path / "one/all.las").read_bytes()).points == 0


def test_bounds_skip_las_files(spark, tmp_path):
    for k in range(3):
        cols = {a: np.arange(50) / 100 + (10 * k if a == "x" else 0) for a in "xyz"} | {c: np.full(50, k) for c in "rgb"}
        (tmp_path / f"{k}.las").write_bytes(las.encode(cols))
    paths = [str(tmp_path / f"{k}.las") for k in range(3)]
    reader = las._PushingLasReader({"paths": ",".join(paths)})
    list(reader.pushFilters([las.GreaterThan(("x",), 9.0), las.LessThanOrEqual(("x",), 10.25), las.EqualTo(("r",), 1)]))
    assert {p.path for p in reader.partitions()} == {paths[1]}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = las.read_las(spark, *paths).where("x > 9 AND x <= 10.25").collect()
        assert len(got) == 26 and {r.r for r in got} == {1}
        assert las.read_las(spark, *paths).where("x > 99").count() == 0 and las.read_las(spark, *paths).count() == 150
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
