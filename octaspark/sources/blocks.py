"""Bit-packed batches: points.bin of blocks whose fields are as narrow as the batch's extent allows, colors.bin and batches.bin.

A block holds its points' steps, x, y and z of one after those of another, each in as many bits as its batch needs, lowest bit
first and across byte borders. Blocks are padded to a multiple of ``ALIGN`` bytes; always by at least one byte,
as the format has it. A batch is small by construction, so a task holds one at a time.
"""

from __future__ import annotations

import json
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octaspark.operators.layout import batch_summary, bits_per_batch
from octaspark.operators.ordering import running_sum
from octaspark.sources.files import Assembly
from octaspark.sources.las import _open
from octaspark.staging import written

#: The alignment of blocks, and a batch's record: box, colour, points, first point, block, bits of x, y, z and of all; then the upper halves of block and first point.
ALIGN = 20
RECORD = np.dtype([("box", "<f4", 6), ("colour", "u1", 4), ("n", "<i4"), ("first", "<u4"), ("block", "<u4"), ("bits", "<i4", 3), ("total", "<i4"), ("block_high", "<u4"), ("first_high", "<u4")])


def pack_bits(fields: list[tuple[np.ndarray, int]]) -> bytes:
    """The fields of each row in turn, each in its number of bits, lowest first."""
    bits = [((v[:, None] >> np.arange(n)) & 1).astype(np.uint8) for v, n in fields]
    return np.packbits(np.concatenate(bits, 1).ravel(), bitorder="little").tobytes() if bits and len(fields[0][0]) else b""


def unpack_bits(data: bytes, n: int, widths: list[int]) -> list[np.ndarray]:
    """What ``pack_bits`` packed: ``n`` rows of fields of the given widths."""
    total = sum(widths)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * total, bitorder="little").reshape(n, total).astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(widths)])
    return [(bits[:, a:b] << np.arange(b - a)).sum(1) for a, b in zip(edge, edge[1:])]


def block_size(bits: int) -> int:
    size = -(-bits // 8)
    return size + ALIGN - size % ALIGN


def plan_blocks(batched: DataFrame, precision: float = 0.001) -> DataFrame:
    """batch_id, n, bits_x, bits_y, bits_z, the batch's box, and byte_offset, byte_size and first_point of its block."""
    size = F.ceil(F.col("total_bits") / 8)
    plan = bits_per_batch(batched, precision).withColumn("byte_size", (size + ALIGN - size % ALIGN).cast("long"))
    box = batch_summary(batched).select("batch_id", *[f"{e}_{a}" for e in ("min", "max") for a in "xyz"])
    plan = written(plan.drop("total_bits").join(box, "batch_id"), "plan")
    placed = running_sum(plan, F.col("byte_size"), "batch_id", name="byte_offset")
    return written(running_sum(placed, F.col("n"), "batch_id", name="first_point"), "blocks")


def pack_blocks(batched: DataFrame, plan: DataFrame, precision: float = 0.001) -> DataFrame:
    """batch_id, byte_offset, first_point, block and colours of each batch, in the order of ``pid``."""
    kept = plan.select("batch_id", "bits_x", "bits_y", "bits_z", "min_x", "min_y", "min_z", "byte_offset", "first_point")
    rows = batched.select("batch_id", "pid", *"xyzrgb").join(kept, "batch_id")

    def run(table):
        table = table.sort_by("pid")  # one batch
        c = {name: table.column(name).to_numpy() for name in table.column_names}
        widths = [int(c[f"bits_{a}"][0]) for a in "xyz"]
        steps = [np.floor((c[a] - c[f"min_{a}"][0]) / precision).astype(np.int64) for a in "xyz"]
        data = pack_bits(list(zip(steps, widths)))
        data += b"\0" * (block_size(sum(widths) * len(c["x"])) - len(data))
        colours = np.stack([*(c[k] for k in "rgb"), np.full(len(c["x"]), 255)], 1).astype(np.uint8).tobytes()
        one = [pa.array([int(c[k][0])], pa.int64()) for k in ("batch_id", "byte_offset", "first_point")]
        return pa.Table.from_arrays([*one, pa.array([data], pa.binary()), pa.array([colours], pa.binary())], ["batch_id", "byte_offset", "first_point", "block", "colours"])

    return rows.groupBy("batch_id").applyInArrow(run, "batch_id long, byte_offset long, first_point long, block binary, colours binary")


def write_blocks(batched: DataFrame, path: str, precision: float = 0.001) -> DataFrame:
    """Writes points.bin, colors.bin, batches.bin and metadata.json; returns the plan of blocks."""
    plan = plan_blocks(batched, precision)
    packed = written(pack_blocks(batched, plan, precision), "packed")
    out = Assembly(path)
    out.write("points.bin", packed.select(F.col("byte_offset").alias("at"), F.col("block").alias("data")))
    out.write("colors.bin", packed.select((F.col("first_point") * 4).alias("at"), F.col("colours").alias("data")))

    def records(batches):
        for b in batches:
            c = {name: b.column(name).to_numpy() for name in b.schema.names}
            rows = np.zeros(b.num_rows, RECORD)
            rows["box"] = np.stack([c[f"{e}_{a}"] for e in ("min", "max") for a in "xyz"], 1)
            rows["colour"] = (255, 50, 50, 255)
            rows["n"], rows["bits"] = c["n"], np.stack([c[f"bits_{a}"] for a in "xyz"], 1)
            rows["total"] = rows["bits"].sum(1)
            block = c["byte_offset"] // ALIGN
            rows["block"], rows["block_high"] = block & 0xFFFFFFFF, block >> 32
            rows["first"], rows["first_high"] = c["first_point"] & 0xFFFFFFFF, c["first_point"] >> 32
            yield pa.RecordBatch.from_arrays([pa.array(c["batch_id"] * RECORD.itemsize), pa.array([r.tobytes() for r in rows], pa.binary())], ["at", "data"])

    out.write("batches.bin", plan.mapInArrow(records, "at long, data binary"))
    totals = plan.agg(F.sum("n"), F.count("*")).first()  # two numbers
    out.describe("metadata.json", {"points": totals[0] or 0, "batches": totals[1], "precision": precision})
    out.commit("metadata.json")
    return plan


def read_blocks(spark: SparkSession, path: str, per_task: int = 256) -> DataFrame:
    """batch_id, place, qx, qy, qz (steps from the batch's least corner), x, y, z, r, g, b; tasks read ``per_task`` batches each."""
    with _open(f"{path}/metadata.json") as f:
        meta = json.loads(f.read())
    n, precision = meta["batches"], meta["precision"]

    def run(batches):
        for b in batches:
            for task in b.column(0).to_pylist():
                with _open(f"{path}/batches.bin") as f:
                    f.seek(task * per_task * RECORD.itemsize)
                    rows = np.frombuffer(f.read(per_task * RECORD.itemsize), RECORD)
                with _open(f"{path}/points.bin") as points, _open(f"{path}/colors.bin") as colours:
                    for k, r in enumerate(rows):
                        m, widths = int(r["n"]), [int(w) for w in r["bits"]]
                        points.seek((int(r["block_high"]) << 32 | int(r["block"])) * ALIGN)
                        q = unpack_bits(points.read(block_size(sum(widths) * m)), m, widths)
                        colours.seek((int(r["first_high"]) << 32 | int(r["first"])) * 4)
                        rgb = np.frombuffer(colours.read(4 * m), np.uint8).reshape(m, 4)
                        head = [pa.array(np.full(m, task * per_task + k)), pa.array(np.arange(m))]
                        xyz = [pa.array(float(r["box"][i]) + v * precision) for i, v in enumerate(q)]
                        yield pa.RecordBatch.from_arrays([*head, *map(pa.array, q), *xyz, *(pa.array(rgb[:, i].astype(np.int32)) for i in range(3))], ["batch_id", "place", "qx", "qy", "qz", *"xyzrgb"])

    tasks = spark.range(0, -(-n // per_task)).repartition(max(1, min(10_000, -(-n // per_task))))
    return tasks.mapInArrow(run, "batch_id long, place long, qx long, qy long, qz long, x double, y double, z double, r int, g int, b int")
