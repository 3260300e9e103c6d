"""An octree as three files: metadata.json, hierarchy.bin and octree.bin, written by tasks and read by view.

octree.bin holds each node's points one after the other, in the order of level and key: those of leaves and,
if given, the samples of inner nodes. A row's place in that order is its rank, so every task knows where its
rows go. hierarchy.bin holds chunks of node records; a proxy tells where the chunk below it lies.

The reader walks down the hierarchy from the root. A node that no wanted node can lie below isn't followed,
so chunks under it aren't read; of octree.bin only ranges of wanted nodes are. The driver reads at most
``planChunks`` chunks; each chunk that is then still open becomes a partition, whose task walks on from there.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from octaspark.functions.geometry import frustum_planes
from octaspark.operators.ordering import ranked
from octaspark.operators.view import Camera
from octaspark.sources.files import Assembly, to_steps
from octaspark.sources.hierarchy import _POINT, PROXY, STEP, decode_chunk, decode_payload, encode_chunks
from octaspark.sources.las import _open
from octaspark.staging import written

SCHEMA = "x double, y double, z double, r int, g int, b int, name string, level int, key long"
POINT_SIZE = _POINT.itemsize


def write_octree_file(described: DataFrame, payload: DataFrame, path: str, scale: float = 0.001, offset: Sequence[float] = (0.0, 0.0, 0.0)) -> None:
    """Writes nodes (level, key, name, is_leaf, child_mask) and ``payload`` (level, key, x, y, z, r, g, b) of a tree over the unit cube.

    ``payload`` has the points of leaves and may have samples of inner nodes. Fails if a coordinate doesn't fit
    32 bits. An older octree at ``path`` stays until the new one is complete; metadata.json goes last.
    """
    spark = described.sparkSession
    out = Assembly(path)
    placed = ranked(payload.select("level", "key", *"xyzrgb"), "level", "key", *"xyzrgb", name="at")  # which it writes
    slices = written(placed.groupBy("level", "key").agg(F.min("at").alias("slice_offset"), F.count("*").alias("n")), "slices")

    def encode(batches):
        for b in batches:
            at = b.column(0).to_numpy()
            rows = np.zeros(len(at), _POINT)
            for k in range(3):
                rows["xyz"][:, k] = to_steps(b.column(1 + k).to_numpy(), scale, offset[k])
                rows["rgb"][:, k] = b.column(4 + k).to_numpy()
            cut = np.flatnonzero(np.diff(at, prepend=at[:1] - 2) != 1)
            data = [rows[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(at)])]
            yield pa.RecordBatch.from_arrays([pa.array(at[cut] * POINT_SIZE, pa.int64()), pa.array(data, pa.binary())], ["at", "data"])

    points = out.write("octree.bin", placed.select("at", *"xyzrgb").mapInArrow(encode, "at long, data binary")) // POINT_SIZE
    nodes = described.select("level", "key", "name", "is_leaf", "child_mask").join(slices, ["level", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    chunks = written(encode_chunks(nodes), "chunks")
    out.write("hierarchy.bin", chunks.select(F.col("chunk_offset").alias("at"), F.col("records").alias("data")))
    first = chunks.where("chunk = 'r'").select(F.length("records")).first()
    out.describe(
        "metadata.json",
        {
            "version": "2.0", "points": points, "boundingBox": {"min": [0.0] * 3, "max": [1.0] * 3}, "scale": [scale] * 3, "offset": list(map(float, offset)), "spacing": 1 / 128,
            "hierarchy": {"firstChunkSize": first[0] if first else 0, "stepSize": STEP},
            "attributes": [{"name": "position", "size": 12}, {"name": "rgb", "size": 6}],
        },
    )
    out.commit("octree.bin", "hierarchy.bin", "metadata.json")
    spark.catalog.clearCache()


@dataclass(frozen=True)
class Wanted:
    """Which nodes are read: a range of levels, a box that theirs must meet, and what a camera sees."""

    levels: tuple[float, float] = (0, np.inf)
    low: tuple[float, float, float] = (-np.inf,) * 3
    high: tuple[float, float, float] = (np.inf,) * 3
    matrix: tuple | None = None
    threshold: float = 0.0

    @functools.cached_property
    def planes(self) -> list[tuple[float, float, float, float]]:
        return frustum_planes(self.matrix)

    def in_sight(self, low: Sequence[float], high: Sequence[float]) -> bool:
        for nx, ny, nz, d in self.planes:
            corner = [high[k] if n >= 0 else low[k] for k, n in enumerate((nx, ny, nz))]
            if not nx * corner[0] + ny * corner[1] + nz * corner[2] + d >= 0:
                return False
        return True

    def meets(self, low: Sequence[float], high: Sequence[float]) -> bool:
        return all(a <= h and b >= lo for a, b, lo, h in zip(low, high, self.low, self.high))

    def takes(self, level: int, low: Sequence[float], size: float) -> bool:
        high = [a + size for a in low]
        if not self.levels[0] <= level <= self.levels[1] or not self.meets(low, high):
            return False
        if self.matrix is None or level == 0:
            return True
        row, centre = self.matrix[3], [(a + b) * 0.5 for a, b in zip(low, high)]
        w = row[0] * centre[0] + row[1] * centre[1] + row[2] * centre[2] + row[3]
        return self.in_sight(low, high) and size / max(w, 0.1) >= self.threshold

    def below(self, level: int, low: Sequence[float], size: float) -> bool:
        """Whether a node below may be taken: it lies within, is at most half as large, and no nearer than the nearest corner."""
        high = [a + size for a in low]
        if level >= self.levels[1] or not self.meets(low, high):
            return False
        if self.matrix is None:
            return True
        row = self.matrix[3]
        nearest = sum(v * (a if v >= 0 else b) for v, a, b in zip(row, low, high)) + row[3]
        return self.in_sight(low, high) and size / 2 / max(nearest, 0.1) >= self.threshold * (1 - 1e-9)


@dataclass(frozen=True)
class Slice:
    """A part of a node's points."""

    name: str
    at: int
    size: int


@dataclass
class Part(InputPartition):
    """What a task reads: slices, or a chunk to walk on from."""

    slices: list[Slice]
    chunk: tuple[str, int, int] | None = None


class OctreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        with _open(f"{self.path}/metadata.json") as f:
            meta = json.loads(f.read())
        self.scale, self.offset = meta["scale"], meta["offset"]
        self.origin, self.size = meta["boundingBox"]["min"], meta["boundingBox"]["max"][0] - meta["boundingBox"]["min"][0]
        self.root = ("r", 0, meta["hierarchy"]["firstChunkSize"])
        self.per_part, self.plan_chunks = int(options.get("pointsPerPartition", 1_000_000)), int(options.get("planChunks", 200))
        self.wanted = Wanted()
        if "camera" in options:
            camera = json.loads(options["camera"])
            self.wanted = Wanted(matrix=tuple(map(tuple, camera["matrix"])), threshold=camera["threshold"])
        if "maxLevel" in options:
            self.wanted = replace(self.wanted, levels=(0, int(options["maxLevel"])))
        if "box" in options:
            v = [float(x) for x in options["box"].split(",")]
            self._narrow(v[:3], v[3:])

    def _narrow(self, low: Sequence[float], high: Sequence[float]) -> None:
        """Steps may lie half a step outside of their node, so the box grows by one."""
        w = self.wanted
        own = [max(a, lo - s) for a, lo, s in zip(w.low, low, self.scale)], [min(b, hi + s) for b, hi, s in zip(w.high, high, self.scale)]
        self.wanted = replace(w, low=tuple(own[0]), high=tuple(own[1]))

    def bytes_of(self, file: str, at: int, size: int) -> bytes:
        with _open(f"{self.path}/{file}") as f:
            f.seek(at)
            data = f.read(size)
        if len(data) < size:
            raise ValueError(f"truncated {file}")
        return data

    def box(self, name: str) -> tuple[list[float], float]:
        """Least corner and size of a node, from the digits of its name."""
        size = self.size / (1 << (len(name) - 1))
        cell = [0, 0, 0]
        for d in map(int, name[1:]):
            cell = [2 * c + (d >> 2 - k & 1) for k, c in enumerate(cell)]
        return [o + c * size for o, c in zip(self.origin, cell)], size

    def expand(self, chunk: tuple[str, int, int]) -> tuple[list[Slice], list[tuple[str, int, int]]]:
        """Slices of a chunk's wanted nodes, and the chunks below that may hold some."""
        slices, more = [], []
        for name, level, kind, _, n, at, size in decode_chunk(chunk[0], self.bytes_of("hierarchy.bin", *chunk[1:])):
            low, edge = self.box(name)
            if kind == PROXY:
                if self.wanted.takes(level, low, edge) or self.wanted.below(level, low, edge):
                    more.append((name, at, size))
            elif n and self.wanted.takes(level, low, edge):
                slices.append(Slice(name, at, n * POINT_SIZE))
        return slices, more

    def partitions(self) -> list[InputPartition]:
        slices, todo, seen = [], deque([self.root] if self.root[2] else []), 0
        while todo and seen < self.plan_chunks:
            own, more = self.expand(todo.popleft())
            slices += own
            todo += more
            seen += 1
        parts, current, held = [], [], 0
        most = self.per_part * POINT_SIZE
        for s in sorted(slices, key=lambda s: s.at):
            at, end = s.at, s.at + s.size
            while at < end:  # a large node is read by several tasks
                take = min(end - at, most - held)
                current.append(Slice(s.name, at, take))
                at, held = at + take, held + take
                if held == most:
                    parts.append(Part(current))
                    current, held = [], 0
        if current:
            parts.append(Part(current))
        return [*parts, *(Part([], c) for c in todo)] or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        yield from self._read_slices(part.slices)
        todo = [part.chunk] if part.chunk else []
        while todo:
            slices, more = self.expand(todo.pop())
            todo += more
            yield from self._read_slices(slices)

    def _read_slices(self, slices: list[Slice], most: int = 65536 * POINT_SIZE) -> Iterator[pa.RecordBatch]:
        for s in slices:
            key = int(s.name[1:] or "0", 8)
            for at in range(s.at, s.at + s.size, most):
                p = decode_payload(self.bytes_of("octree.bin", at, min(most, s.at + s.size - at)), self.scale[0])
                n = len(p["x"])
                where = [pa.array([s.name] * n, pa.string()), pa.array([len(s.name) - 1] * n, pa.int32()), pa.array([key] * n, pa.int64())]
                xyz = [pa.array(p[a] + o, pa.float64()) for a, o in zip("xyz", self.offset)]
                yield pa.RecordBatch.from_arrays([*xyz, *(pa.array(p[c], pa.int32()) for c in "rgb"), *where], [f.split()[0] for f in SCHEMA.split(", ")])


class PushingOctreeReader(OctreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on x, y, z and level prune nodes; Spark still applies all filters to the rows."""
        for f in filters:
            of = getattr(f, "attribute", None)
            lower, upper = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)), isinstance(f, (EqualTo, LessThan, LessThanOrEqual))
            if of and len(of) == 1 and (lower or upper):
                v = float(f.value)
                if of[0] == "level":
                    a, b = self.wanted.levels
                    self.wanted = replace(self.wanted, levels=(max(a, v) if lower else a, min(b, v) if upper else b))
                elif of[0] in ("x", "y", "z"):
                    k = "xyz".index(of[0])
                    low, high = [-np.inf] * 3, [np.inf] * 3
                    low[k], high[k] = v if lower else -np.inf, v if upper else np.inf
                    self._narrow(low, high)
            yield f


class OctreeDataSource(DataSource):
    """``spark.read.format("octree")`` with options path, maxLevel, box (six numbers), camera (JSON), pointsPerPartition, planChunks.

    Filters on x, y, z and level prune, too, with option pushFilters, which needs ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "octree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PushingOctreeReader(self.options) if self.options.get("pushFilters") == "true" else OctreeReader(self.options)


def read_octree_file(spark: SparkSession, path: str, camera: Camera | None = None, box: Sequence[float] | None = None, max_level: int | None = None, **options) -> DataFrame:
    """Points with name, level and key of their node, of nodes that the camera sees, whose box meets ``box`` and which lie no deeper than ``max_level``.

    Points of a node that meets the box may lie outside of it: filter them where that matters.
    """
    spark.dataSource.register(OctreeDataSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    options = {"path": path, "pushFilters": pushes} | options
    if camera is not None:
        options["camera"] = json.dumps({"matrix": camera.matrix, "threshold": camera.threshold})
    if box is not None:
        options["box"] = ",".join(map(str, box))
    if max_level is not None:
        options["maxLevel"] = max_level
    return spark.read.format("octree").options(**options).load()


def node_samples(points: DataFrame, voxels: DataFrame | None, grid_bits: int) -> DataFrame:
    """level, key, x, y, z, r, g, b: the points of leaves and, at the middle of their cells, the voxels of inner nodes."""
    from octaspark.functions.geometry import morton

    rows = points.select(F.col("leaf_level").alias("level"), F.col("leaf_key").alias("key"), *"xyzrgb")
    if voxels is None:
        return rows
    key = morton(*[F.shiftright(f"v{a}", grid_bits) for a in "xyz"])
    middle = [((F.col(f"v{a}") + 0.5) / F.pow(F.lit(2.0), F.col("level") + grid_bits)).alias(a) for a in "xyz"]
    return rows.unionByName(voxels.select("level", key.alias("key"), *middle, "r", "g", "b"))


