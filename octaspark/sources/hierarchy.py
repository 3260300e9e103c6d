"""On-disk octree hierarchies: fixed records per node, in chunks that point to each other.

A chunk holds up to ``STEP`` levels below its first node, breadth first. The first level of the
next chunks appears in it as proxies. Chunks are independent, so encoding and
decoding run chunk by chunk in parallel; the names of nodes tell how they hang together.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octaspark.operators.ordering import running_sum
from octaspark.sources.files import to_steps
from octaspark.staging import few, written

#: A record is type, child mask, points, byte offset and byte size.
RECORD = "<BBIqq"
RECORD_SIZE = struct.calcsize(RECORD)
NORMAL, LEAF, PROXY = 0, 1, 2
STEP = 3
NODE_SCHEMA = "name string, level int, node_type int, child_mask int, num_points long, byte_offset long, byte_size long"


def decode_chunk(root: str, data: bytes) -> list[tuple]:
    """Nodes of one chunk in breadth-first order; children are named by the masks of their parents."""
    if len(data) % RECORD_SIZE:
        raise ValueError("truncated hierarchy")
    names, out = [root], []
    for k in range(len(data) // RECORD_SIZE):
        if k >= len(names):
            raise ValueError("more records than child masks announce")
        kind, mask, points, offset, size = struct.unpack_from(RECORD, data, k * RECORD_SIZE)
        name = names[k]
        out.append((name, len(name) - 1, kind, mask, points, offset, size))
        if kind != PROXY:
            names += [f"{name}{d}" for d in range(8) if mask >> d & 1]
    if len(out) != len(names):
        raise ValueError("fewer records than child masks announce")
    return out


def encode_chunks(nodes: DataFrame) -> DataFrame:
    """(chunk, chunk_offset, records) from name, level, is_leaf, child_mask, n and slice_offset.

    A chunk has at most 8**0 + ... + 8**STEP records, so its group is small by construction. A proxy tells where
    the chunk that it stands for lies in a file of all chunks, which follow each other by depth and name.
    """
    own = nodes.select("name", "level", "is_leaf", "child_mask", "n", "slice_offset", F.expr(f"substring(name, 1, 1 + level - level % {STEP})").alias("chunk"), F.lit(False).alias("proxy"))
    heads = own.where(f"level > 0 AND level % {STEP} = 0").withColumns({"chunk": F.expr(f"substring(name, 1, 1 + level - {STEP})"), "proxy": F.lit(True)})
    rows = own.unionByName(heads)
    sizes = rows.groupBy("chunk").agg((F.count("*") * RECORD_SIZE).alias("chunk_size"))
    places = running_sum(sizes, F.col("chunk_size"), F.length("chunk"), "chunk", name="chunk_offset")
    of_proxy = places.select(F.col("chunk").alias("name"), F.lit(True).alias("proxy"), F.col("chunk_offset").alias("at"), F.col("chunk_size").alias("size"))
    rows = rows.join(of_proxy, ["name", "proxy"], "left").withColumns({"at": F.coalesce("at", F.coalesce("slice_offset", F.lit(0)) * 18), "size": F.coalesce("size", F.col("n") * 18)})
    fields = F.struct("level", "name", "proxy", "is_leaf", "child_mask", "n", "at", "size")
    groups = rows.groupBy("chunk").agg(F.sort_array(F.collect_list(fields)).alias("nodes")).join(places.select("chunk", "chunk_offset"), "chunk")

    def run(batches):
        for b in batches:
            data = []
            for rows in b.column(2).to_pylist():
                kinds = [PROXY if r["proxy"] else LEAF if r["is_leaf"] else NORMAL for r in rows]
                data.append(b"".join(struct.pack(RECORD, k, r["child_mask"], r["n"], r["at"], r["size"]) for k, r in zip(kinds, rows)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["chunk", "chunk_offset", "records"])

    return groups.select("chunk", "chunk_offset", "nodes").mapInArrow(run, "chunk string, chunk_offset long, records binary")


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """All nodes; a proxy is replaced by the record of the chunk that it points to."""

    def run(batches):
        for b in batches:
            rows = [r for root, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in decode_chunk(root, data)]
            cols = list(zip(*rows)) or [[]] * 7
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    rows = chunks.select("chunk", "records").mapInArrow(run, NODE_SCHEMA)
    return rows.groupBy("name").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "name"]), F.col("node_type")).alias("s")).select("name", "s.*")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The JSON description of an octree: box, scale, offset, points, spacing and attributes."""
    schema = (
        "boundingBox struct<min:array<double>,max:array<double>>, scale array<double>, offset array<double>, points long, spacing double, "
        "hierarchy struct<firstChunkSize:long>, attributes array<struct<name:string,size:int>>"
    )
    return spark.read.schema(schema).option("multiLine", True).json(path)


_POINT = np.dtype([("xyz", "<i4", 3), ("rgb", "<u2", 3)])


def decode_payload(data: bytes, scale: float, offset: float = 0.0) -> dict[str, np.ndarray]:
    """Points of a node: records of three 32-bit coordinates and three 16-bit colours."""
    rows = np.frombuffer(data, _POINT)
    return {a: rows["xyz"][:, k] * scale + offset for k, a in enumerate("xyz")} | {c: rows["rgb"][:, k].astype(np.int32) for k, c in enumerate("rgb")}


def encode_payload(placed: DataFrame, scale: float) -> DataFrame:
    """(level, key, records): the points of leaves as records. A leaf may come in several rows, so none is held whole."""
    keys = ["leaf_level", "leaf_key"]
    rows = placed.select(*keys, *"xyzrgb").repartitionByRange(*keys, "x", "y", "z").sortWithinPartitions(*keys)

    def run(batches):
        for b in batches:
            level, key = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            out = np.zeros(b.num_rows, _POINT)
            for k in range(3):
                out["xyz"][:, k] = to_steps(b.column(2 + k).to_numpy(zero_copy_only=False), scale, 0.0)
                out["rgb"][:, k] = b.column(5 + k).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(level, prepend=-1) != 0) | (np.diff(key, prepend=-1) != 0))
            data = [out[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(out)])]
            yield pa.RecordBatch.from_arrays([pa.array(level[cut], pa.int32()), pa.array(key[cut], pa.int64()), pa.array(data, pa.binary())], ["level", "key", "records"])

    return rows.mapInArrow(run, "level int, key long, records binary")


def _runs(ends: np.ndarray, most: int):
    """(from, to) of rows that follow each other and end within ``most`` of where they start, or are one row; ``ends`` grow."""
    lo = 0
    while lo < len(ends):
        start = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, start + most, "right")))
        yield lo, hi
        lo = hi


def scan_payload(payload: DataFrame, slices: DataFrame, scale: float, least: int) -> DataFrame:
    """Points with their node, read in bins of nodes that follow each other in the file.

    ``slices`` tells level, key and slice_offset of the leaves, ``least`` the points of a bin.
    """
    bins = slices.select("level", "key", F.floor(F.col("slice_offset") / least).cast("long").alias("bin"))

    def run(batches):
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column(3)).to_numpy())
            for lo, hi in _runs(ends, 65536 * _POINT.itemsize):
                part = b.slice(lo, hi - lo)
                n = pc.binary_length(part.column(3)).to_numpy() // _POINT.itemsize
                p = decode_payload(b"".join(part.column(3).to_pylist()), scale)
                own = [pa.array(np.repeat(part.column(k).to_numpy(), n)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(p[a], pa.float64()) for a in "xyz"), *(pa.array(p[c], pa.int32()) for c in "rgb")], ["level", "key", "bin", *"xyzrgb"])

    dealt = payload.join(few(written(bins, "bins")), ["level", "key"]).select("level", "key", "bin", "records").repartition("bin")
    return dealt.mapInArrow(run, "level int, key long, bin long, x double, y double, z double, r int, g int, b int")
