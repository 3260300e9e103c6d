"""LAS point files: header, records, a partitioned data source and an encoder."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from octaspark.operators.ordering import ranked
from octaspark.sources.files import Assembly, to_steps
from octaspark.staging import cut_lineage, written

#: Where the colour starts in a record of each point format that has one, and all formats' lengths.
COLOUR_OFFSET = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
RECORD_LENGTH = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
SCHEMA = "x double, y double, z double, r int, g int, b int, file string, point_id long"


class LasError(ValueError):
    pass


@dataclass(frozen=True)
class LasHeader:
    version: tuple[int, int]
    offset_to_points: int
    point_format: int
    record_length: int
    points: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]


def parse_header(data: bytes, max_points: int | None = None) -> LasHeader:
    """The fields that reading needs; fails on other files, compressed records and unknown formats. ``max_points`` crops on purpose."""
    if len(data) < 227 or data[:4] != b"LASF":
        raise LasError("not a LAS file")
    major, minor = data[24], data[25]
    at, = struct.unpack_from("<I", data, 96)
    raw_format, length = struct.unpack_from("<BH", data, 104)
    if raw_format & 0x80:
        raise LasError("compressed (LAZ) records are not supported")
    point_format = raw_format % 128
    if point_format not in RECORD_LENGTH:
        raise LasError(f"unknown point format {point_format}")
    if (major, minor) >= (1, 4):
        if len(data) < 255:
            raise LasError("truncated header")
        count, = struct.unpack_from("<Q", data, 247)
    else:
        count, = struct.unpack_from("<I", data, 107)
    if length < COLOUR_OFFSET.get(point_format, 6) + 6:
        raise LasError("records are too short for their format")
    scale, offset = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    x1, x0, y1, y0, z1, z0 = struct.unpack_from("<6d", data, 179)
    return LasHeader((major, minor), at, point_format, length, count if max_points is None else min(count, max_points), scale, offset, (x0, y0, z0), (x1, y1, z1))


def _record(point_format: int, length: int) -> np.dtype:
    """The fields of a record that are read: coordinates, and the colour if it has one."""
    names = ["xyz", "rgb"][: 1 + (point_format in COLOUR_OFFSET)]
    return np.dtype({"names": names, "formats": ["(3,)<i4", "(3,)<u2"][: len(names)], "offsets": [0, COLOUR_OFFSET.get(point_format)][: len(names)], "itemsize": length})


def decode_records(data: bytes, header: LasHeader, origin: Sequence[float] | None = None) -> dict[str, np.ndarray]:
    """Coordinates relative to ``origin`` (the header's minimum) and 8-bit colours of whole records; black without colour."""
    if len(data) % header.record_length:
        raise LasError("truncated records")
    rows = np.frombuffer(data, _record(header.point_format, header.record_length))
    origin = header.low if origin is None else origin
    out = {a: rows["xyz"][:, k] * header.scale[k] + header.offset[k] - origin[k] for k, a in enumerate("xyz")}
    colour = rows["rgb"].astype(np.int32) if "rgb" in rows.dtype.names else np.zeros((len(rows), 3), np.int32)
    colour = np.where(colour > 255, colour // 256, colour)
    return out | {c: colour[:, k] for k, c in enumerate("rgb")}


def encode_header(n: int, low: Sequence[float], high: Sequence[float], scale: float, point_format: int, version: tuple[int, int], offset: Sequence[float]) -> bytes:
    header = bytearray(375 if version >= (1, 4) else 227)
    header[:4] = b"LASF"
    header[24], header[25] = version
    struct.pack_into("<H", header, 94, len(header))
    struct.pack_into("<I", header, 96, len(header))
    struct.pack_into("<BH", header, 104, point_format, RECORD_LENGTH[point_format])
    struct.pack_into("<Q" if version >= (1, 4) else "<I", header, 247 if version >= (1, 4) else 107, n)
    struct.pack_into("<3d", header, 131, scale, scale, scale)
    struct.pack_into("<3d", header, 155, *offset)
    struct.pack_into("<6d", header, 179, *[v for h, lo in zip(high, low) for v in (h, lo)])
    return bytes(header)


def encode_records(points: dict[str, np.ndarray], scale: float, point_format: int, offset: Sequence[float]) -> np.ndarray:
    rows = np.zeros(len(points["x"]), _record(point_format, RECORD_LENGTH[point_format]))
    for k, (a, c) in enumerate(zip("xyz", "rgb")):
        rows["xyz"][:, k] = to_steps(points[a], scale, offset[k])
        if point_format in COLOUR_OFFSET:
            rows["rgb"][:, k] = points[c]
    return rows


def encode(points: dict[str, np.ndarray], scale: float = 0.001, point_format: int = 2, version: tuple[int, int] = (1, 2), offset: Sequence[float] = (0.0, 0.0, 0.0)) -> bytes:
    """A LAS file of x, y, z and 8-bit r, g, b; fails if a coordinate less its offset doesn't fit 32 bits at the scale."""
    n = len(points["x"])
    low, high = ([float(f(points[a])) if n else 0.0 for a in "xyz"] for f in (np.min, np.max))
    return encode_header(n, low, high, scale, point_format, version, offset) + encode_records(points, scale, point_format, offset).tobytes()


def _files(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _open(path: str):
    files, inner = _files(path)
    return files.open_input_file(inner)


@dataclass
class _Range(InputPartition):
    path: str
    header: LasHeader
    first: int
    count: int
    origin: tuple[float, float, float]


class _LasReader(DataSourceReader):
    """One input partition per range of records; ranges are read with seeks."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.per_range = int(options.get("pointsPerPartition", 1_000_000))
        self.max_points = int(options["maxPoints"]) if "maxPoints" in options else None
        self.low, self.high = [-np.inf] * 3, [np.inf] * 3  # of the coordinates that are wanted

    def meets(self, h: LasHeader, origin: Sequence[float]) -> bool:
        """Whether a file may hold wanted points, by its header's box and a step around it."""
        return all(h.low[k] - origin[k] - h.scale[k] <= self.high[k] and h.high[k] - origin[k] + h.scale[k] >= self.low[k] for k in range(3))

    def partitions(self) -> list[InputPartition]:
        bad = [p for p in self.paths if not p.lower().endswith(".las")]
        if bad or not self.paths:
            raise LasError(f"not .las files: {bad}" if bad else "no path given")

        def header(path: str) -> LasHeader:
            with _open(path) as f:
                return parse_header(f.read(375), self.max_points)

        with ThreadPoolExecutor(16) as pool:  # one small read a file; a folder's headers are read by tasks, see read_las_folder
            headers = list(pool.map(header, self.paths))
        origin = tuple(min(h.low[k] for h in headers) for k in range(3))
        wanted = [(p, h) for p, h in zip(self.paths, headers) if self.meets(h, origin)]
        return [_Range(p, h, at, min(self.per_range, h.points - at), origin) for p, h in wanted for at in range(0, h.points, self.per_range)] or [_Range(self.paths[0], headers[0], 0, 0, origin)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        h, step = part.header, 65536
        with _open(part.path) as f:
            f.seek(h.offset_to_points + part.first * h.record_length)
            for at in range(0, part.count, step):
                n = min(step, part.count - at)
                data = f.read(n * h.record_length)
                if len(data) < n * h.record_length:
                    raise LasError(f"truncated file {part.path}")
                yield to_batch(decode_records(data, h, part.origin), part.path, part.first + at)


class _PushingLasReader(_LasReader):
    """Bounds on x, y, z keep files from being opened whose header's box lies outside; Spark still applies all filters to the rows."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            of = getattr(f, "attribute", None)
            if of in (("x",), ("y",), ("z",)):
                k = "xyz".index(of[0])
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[k] = max(self.low[k], float(f.value))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[k] = min(self.high[k], float(f.value))
            yield f


def to_batch(points: dict[str, np.ndarray], file: str, first: int) -> pa.RecordBatch:
    n = len(points["x"])
    cols = [pa.array(points[a], pa.float64()) for a in "xyz"] + [pa.array(points[c], pa.int32()) for c in "rgb"]
    return pa.RecordBatch.from_arrays([*cols, pa.array([file] * n, pa.string()), pa.array(np.arange(first, first + n))], ["x", "y", "z", "r", "g", "b", "file", "point_id"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _LasWriter(DataSourceArrowWriter):
    """Each task writes its rows, in their order, as files of at most ``pointsPerFile`` points below a folder
    of the job; the driver moves the files of tasks that count into place, so that repeated attempts leave nothing."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.scale, self.point_format = float(options.get("scale", 0.001)), int(options.get("pointFormat", 2))
        self.per_file = int(options.get("pointsPerFile", 10_000_000))
        self.offset = tuple(map(float, options["offset"].split(","))) if "offset" in options else None
        self.job = uuid.uuid4().hex
        self.folder = f"_temporary-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, top = _files(self.path)
        files.create_dir(f"{top}/{self.folder}", recursive=True)
        out, rows, n = [], [], 0

        def close() -> None:
            table = pa.Table.from_batches(rows)
            points = {c: table.column(c).to_numpy() for c in "xyzrgb"}
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(out):04d}-{self.job}.las"
            offset = self.offset or tuple(float(np.floor(points[a].min())) for a in "xyz")
            with files.open_output_stream(f"{top}/{self.folder}/{name}") as f:
                f.write(encode(points, self.scale, self.point_format, (1, 4), offset))
            out.append(name)

        for b in batches:
            for at in range(0, b.num_rows, self.per_file):
                part = b.slice(at, self.per_file)
                if n and n + part.num_rows > self.per_file:
                    close()
                    rows, n = [], 0
                rows.append(part)
                n += part.num_rows
        if n:
            close()
        return _Written(out)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        files, top = _files(self.path)
        old = [f.path for f in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.path.lower().endswith(".las")] if self.overwrite else []
        for name in (f for m in messages if m for f in m.files):
            files.move(f"{top}/{self.folder}/{name}", f"{top}/{name}")
        for path in old:  # only now, so that a failure leaves the old files or both, never none
            files.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        files, top = _files(self.path)
        if files.get_file_info(f"{top}/{self.folder}").type.name == "Directory":
            files.delete_dir(f"{top}/{self.folder}")


class LasDataSource(DataSource):
    """``spark.read.format("las")`` with options paths (comma-separated), pointsPerPartition, maxPoints, pushFilters (bounds on x, y, z skip
    files; needs ``spark.sql.python.filterPushdown.enabled``), and
    ``df.write.format("las").save(path)`` of columns x, y, z, r, g, b with options scale, pointFormat, pointsPerFile and offset
    (three numbers with commas; without it each file takes its own least corner, rounded down)."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PushingLasReader(self.options) if self.options.get("pushFilters") == "true" else _LasReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _LasWriter(self.options, overwrite)


def read_las(spark: SparkSession, *paths: str, **options) -> DataFrame:
    spark.dataSource.register(LasDataSource)
    reader = spark.read.format("las").option("paths", ",".join(paths)).option("pushFilters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def write_las(points: DataFrame, path: str, **options) -> None:
    """Points as LAS files. All get one offset, the cloud's least corner rounded down, unless the options name another."""
    points.sparkSession.dataSource.register(LasDataSource)
    if "offset" not in options:
        low = points.agg(*[F.floor(F.min(a)) for a in "xyz"]).first()  # three numbers
        options["offset"] = ",".join(str(float(v or 0)) for v in low)
    writer = points.select(*"xyzrgb").write.format("las").mode("overwrite")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save(path)


def write_las_file(points: DataFrame, folder: str, name: str, *order: str, scale: float = 0.001, point_format: int = 2) -> None:
    """Points as one LAS file, in the order of columns ``order``: each task writes its records at their places.

    The offset is the cloud's least corner, rounded down. An older file stays until this one is complete.
    """
    box = points.agg(*[f(a) for f in (F.min, F.max) for a in "xyz"]).first()  # six numbers
    low, high = ([float(v or 0) for v in box[k : k + 3]] for k in (0, 3))
    offset = [float(np.floor(v)) for v in low]
    length = RECORD_LENGTH[point_format]
    start = 375

    def run(batches):
        for b in batches:
            at = b.column(0).to_numpy()
            rows = encode_records({c: b.column(c).to_numpy() for c in "xyzrgb"}, scale, point_format, offset)
            cut = np.flatnonzero(np.diff(at, prepend=at[:1] - 2) != 1)
            data = [rows[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(at)])]
            yield pa.RecordBatch.from_arrays([pa.array(start + at[cut] * length), pa.array(data, pa.binary())], ["at", "data"])

    out = Assembly(folder)
    placed = ranked(points.select(*"xyzrgb", *(c for c in order if c not in "xyzrgb")), *order, name="_rank").select("_rank", *"xyzrgb")
    n = out.write(name, placed.mapInArrow(run, "at long, data binary")) // length
    header = encode_header(n, low, high, scale, point_format, (1, 4), offset)
    out.patch(name, 0, header)
    out.commit()


def crop_las_file(spark: SparkSession, source: str, folder: str, name: str, most: int, per_task: int = 1_000_000) -> int:
    """Copies a file's first ``most`` records, with all that stands before them, and returns how many there are.

    Records are copied byte for byte, so fields that aren't read elsewhere stay. Only the count in the header changes.
    """
    with _open(source) as f:
        head = f.read(375)
        h = parse_header(head, most)
        f.seek(0)
        before = bytearray(f.read(h.offset_to_points))
    if h.version >= (1, 4):
        struct.pack_into("<Q", before, 247, h.points)
    else:
        struct.pack_into("<I", before, 107, h.points)

    def copy(batches):
        for b in batches:
            for task in b.column(0).to_pylist():
                first, step = task * per_task, 65536
                with _open(source) as f:
                    f.seek(h.offset_to_points + first * h.record_length)
                    for at in range(first, min(first + per_task, h.points), step):
                        n = min(step, first + per_task - at, h.points - at) * h.record_length
                        data = f.read(n)
                        if len(data) < n:
                            raise LasError(f"truncated file {source}")
                        yield pa.RecordBatch.from_arrays([pa.array([h.offset_to_points + at * h.record_length]), pa.array([data], pa.binary())], ["at", "data"])

    out = Assembly(folder)
    out.write(name, spark.range(-(-h.points // per_task)).repartition(max(1, min(1000, -(-h.points // per_task)))).mapInArrow(copy, "at long, data binary"))
    out.patch(name, 0, bytes(before))
    out.commit()
    return h.points


RANGE = "path string, offset_to_points long, point_format int, record_length long, scale array<double>, offset array<double>, first long, count long, low array<double>"


def _folder_ranges(spark: SparkSession, path: str, per_task: int) -> DataFrame:
    """Ranges of at most ``per_task`` records of all .las files below a folder, from headers that tasks read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[lL][aA][sS]").option("recursiveFileLookup", True).load(path).select("path")

    def ranges(batches):
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                with _open(p) as f:
                    h = parse_header(f.read(375))
                rows += [(p, h.offset_to_points, h.point_format, h.record_length, h.scale, h.offset, at, min(per_task, h.points - at), h.low) for at in range(0, h.points, per_task)]
            cols = list(zip(*rows)) or [[]] * 9
            d = pa.list_(pa.float64())
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), d, d, pa.int64(), pa.int64(), d)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split()[0] for f in RANGE.split(", ")])

    return files.repartition("path").mapInArrow(ranges, RANGE)


def _read_range(r: dict, origin: Sequence[float]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Number of the first point and the points, piece by piece, of a row of ``RANGE``; fails if the file ends before the range does."""
    h = LasHeader((1, 4), r["offset_to_points"], r["point_format"], r["record_length"], r["count"], r["scale"], r["offset"], r["low"], r["low"])
    with _open(r["path"]) as f:
        f.seek(h.offset_to_points + r["first"] * h.record_length)
        for at in range(0, r["count"], 65536):
            n = min(65536, r["count"] - at)
            data = f.read(n * h.record_length)
            if len(data) < n * h.record_length:
                raise LasError(f"truncated file {r['path']}")
            yield r["first"] + at, decode_records(data, h, origin)


def _read_ranges(ranges: DataFrame, origin: Sequence[float]) -> DataFrame:
    def points(batches):
        for b in batches:
            for r in b.to_pylist():
                for first, found in _read_range(r, origin):
                    yield to_batch(found, r["path"], first)

    return ranges.repartition("path", "first").mapInArrow(points, SCHEMA)


def read_las_folder(spark: SparkSession, path: str, per_task: int = 1_000_000) -> DataFrame:
    """Points of all .las files below a folder, relative to the least corner of all; headers are read by tasks, not by the driver.

    Fails on a file that holds fewer points than its header tells.
    """
    found = cut_lineage(_folder_ranges(spark, path, per_task))
    origin = tuple(found.agg(*[F.min(F.col("low")[k]) for k in range(3)]).first())  # three numbers
    return _read_ranges(found, origin)


def index_las_folder(spark: SparkSession, path: str, per_range: int = 100_000) -> DataFrame:
    """A row for each range of ``per_range`` records: where it lies in its file, and the box of its points.

    One pass over the files; the table is small (a row for so many points) and is written to the shared folder.
    Save it beside the files to keep it.
    """
    corners = [f"{e}_{a}" for e in ("least", "most") for a in "xyz"]

    def boxes(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                low, high = np.full(3, np.inf), np.full(3, -np.inf)
                for _, found in _read_range(r, (0.0, 0.0, 0.0)):
                    low = np.minimum(low, [found[a].min() for a in "xyz"])
                    high = np.maximum(high, [found[a].max() for a in "xyz"])
                rows.append([*low.tolist(), *high.tolist()])
            extra = [pa.array([r[k] for r in rows], pa.float64()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, *corners])

    found = _folder_ranges(spark, path, per_range)
    return written(found.repartition("path", "first").mapInArrow(boxes, RANGE + "".join(f", {c} double" for c in corners)), "boxes")


def ranges_in_box(index: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """The rows of an index whose box meets the closed box from ``low`` to ``high``."""
    meets = F.lit(True)
    for a, lo, hi in zip("xyz", low, high):
        meets = meets & (F.col(f"most_{a}") >= F.lit(float(lo))) & (F.col(f"least_{a}") <= F.lit(float(hi)))
    return index.where(meets)


def read_las_box(index: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """The points of a closed box, with their coordinates as stored; only ranges whose box meets it are opened."""
    points = _read_ranges(ranges_in_box(index, low, high).select([f.split()[0] for f in RANGE.split(", ")]), (0.0, 0.0, 0.0))
    inside = F.lit(True)
    for a, lo, hi in zip("xyz", low, high):
        inside = inside & F.col(a).between(float(lo), float(hi))
    return points.where(inside)


def probe_int32(files: DataFrame, at: int, name: str = "path", content: str = "content") -> DataFrame:
    """The little-endian 32-bit number at a byte offset of each file."""
    byte = lambda k: F.conv(F.hex(F.substring(content, at + 1 + k, 1)), 16, 10).cast("long")
    value = sum((byte(k) * F.lit(1 << 8 * k) for k in range(4)), F.lit(0).cast("long"))
    return files.select(F.col(name), F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int").alias("value"))


def to_las_files(points: DataFrame, scale: float = 0.001, per_file: int = 50_000) -> DataFrame:
    """(name, content): the points as LAS files of at most ``per_file`` points, one row per file."""

    def run(batches):
        from pyspark import TaskContext

        k = 0
        for b in batches:
            for at in range(0, b.num_rows, per_file):
                part = b.slice(at, per_file)
                cols = {c: part.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate("xyzrgb")}
                name = f"{TaskContext.get().partitionId():05d}-{k:05d}.las"
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([encode(cols, scale)], pa.binary())], ["name", "content"])

    return points.select(*"xyzrgb").mapInArrow(run, "name string, content binary")


def scan_las_files(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Points of whole LAS files held in rows, as ``spark.read.format("binaryFile")`` gives them."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):  # one file at a time, of which nothing is copied
                file, data = b.column(0)[k].as_py(), memoryview(b.column(1)[k].as_buffer())
                h = parse_header(bytes(data[:375]))
                if len(data) < h.offset_to_points + h.points * h.record_length:
                    raise LasError(f"truncated file {file}")
                for at in range(0, h.points, 65536):
                    lo, hi = (h.offset_to_points + n * h.record_length for n in (at, min(at + 65536, h.points)))
                    yield to_batch(decode_records(data[lo:hi], h, (0.0, 0.0, 0.0)), file, at)

    return files.select(F.col(name), F.col(content)).mapInArrow(run, SCHEMA)


def header_rows(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """file, points, and the box of each LAS file's header."""

    def run(batches):
        for b in batches:
            rows = [(f, h.points, *h.low, *h.high) for f, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for h in [parse_header(d)]]
            cols = list(zip(*rows)) or [[]] * 8
            types = [pa.string(), pa.int64()] + [pa.float64()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file", "points", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z"])

    boxes = ", ".join(f"{e}_{a} double" for e in ("min", "max") for a in "xyz")
    return files.select(F.col(name), F.substring(content, 1, 375).alias("head")).mapInArrow(run, f"file string, points long, {boxes}")
