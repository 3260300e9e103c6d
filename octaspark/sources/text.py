"""Text inputs: voxel CSV, ASCII PLY and benchmark records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octaspark.operators.ordering import ranked


def read_voxel_csv(spark: SparkSession, path: str) -> DataFrame:
    """Six integers a line; other lines are skipped."""
    return spark.read.schema("x int, y int, z int, r int, g int, b int").option("mode", "DROPMALFORMED").csv(path)


def read_ply_vertices(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of an ASCII PLY file, which is read line by line in splits.

    Lines are numbered by where their split starts and their place in it; the header tells how many
    vertices follow, so a face line is never taken for a vertex.
    """
    lines = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", "\r$", "")).alias("value"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    rows = ranked(lines, "start", "i", name="line")
    vertices = F.max(F.regexp_extract("value", r"^element vertex (\d+)", 1).try_cast("int"))
    head = rows.where("value = 'end_header' OR value LIKE 'element vertex %'").agg(F.min(F.when(F.col("value") == "end_header", F.col("line"))), vertices).first()
    end, n = head[0], head[1]
    if end is None or n is None:
        raise ValueError("not an ASCII PLY file with vertices")
    fields = F.split("value", " +")
    body = rows.where((F.col("line") > end) & (F.col("line") <= end + n))
    return body.select((F.col("line") - end - 1).cast("int").alias("vertex_id"), *[fields[k].cast("double").alias(a) for k, a in enumerate("xyz")])


def read_benchmark_runs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line: strategy, durations, points, nodes and voxels."""
    schema = "datetime string, device string, strategy string, duration_split double, duration_voxelize double, duration_total double, points long, voxels long, nodes long, throughput double"
    return spark.read.schema(schema).json(path)
