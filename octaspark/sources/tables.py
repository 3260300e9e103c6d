"""Point clouds made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of points wherever the result needs one: unique in the point tables.
ORDER = ("k1", "k2", "k3", "k4", "k5", "k6")
POINT = ("x", "y", "z", "r", "g", "b", *ORDER)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_number(c: Column) -> Column:
    return F.unix_date(F.to_date(c)).cast("long")


def bounds(df: DataFrame, *columns: str) -> list[tuple[float, float]]:
    """(min, max) of each column: one row reaches the driver."""
    row = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()
    return [(float(row[2 * k]), float(row[2 * k + 1])) for k in range(len(columns))]


def _unit(c: Column, low: float, high: float) -> Column:
    return (c - F.lit(low)) / F.lit(high - low)


def lineitem_points(spark: SparkSession, sf_dir: str, skewed: bool = False) -> DataFrame:
    """The unit cube cloud of ``lineitem``; ``skewed`` cubes each coordinate."""
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", day_number(F.col("l_shipdate")).alias("day")
    )
    (x0, x1), (y0, y1), (z0, z1) = bounds(rows, "l_extendedprice", "day", "l_quantity")
    xyz = [_unit(F.col("l_extendedprice"), x0, x1), _unit(F.col("day").cast("double"), y0, y1), _unit(F.col("l_quantity"), z0, z1)]
    points = rows.select(
        *[c.alias(n) for n, c in zip("xyz", xyz)],
        F.floor(F.col("l_quantity") * 5).cast("int").alias("r"),
        (F.round(F.col("l_discount") * 100) * 25).cast("int").alias("g"),
        (F.round(F.col("l_tax") * 100) * 25).cast("int").alias("b"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_partkey").alias("k2"),
        F.col("l_suppkey").alias("k3"),
        F.col("l_linenumber").cast("long").alias("k4"),
        F.col("day").alias("k5"),
        F.col("l_extendedprice").alias("k6"),
    )
    if skewed:
        points = points.select(*[(F.col(c) * F.col(c) * F.col(c)).alias(c) for c in "xyz"], "r", "g", "b", *ORDER)
    return points


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x: user, y: time, z: value of ``events``, scaled to the unit cube; with event_id."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("double").alias("u"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("value").alias("v"))
    lim = bounds(rows, "u", "t", "v")
    return rows.select("event_id", *[_unit(F.col(c), *b).alias(n) for n, c, b in zip("xyz", "utv", lim)])


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three elements of each embedding."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("xyz")])


# The same clouds in SQL, as CTEs.
_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)"
PC_SQL = f"""
bb AS (SELECT min(l_extendedprice) x0, max(l_extendedprice) x1, min({_DAY}) y0, max({_DAY}) y1, min(l_quantity) z0, max(l_quantity) z1 FROM lineitem),
pc AS (SELECT (l_extendedprice - x0) / (x1 - x0) AS x, (CAST({_DAY} AS DOUBLE) - y0) / CAST(y1 - y0 AS DOUBLE) AS y, (l_quantity - z0) / (z1 - z0) AS z,
  CAST(floor(l_quantity * 5) AS INT) AS r, CAST(round(l_discount * 100) * 25 AS INT) AS g, CAST(round(l_tax * 100) * 25 AS INT) AS b,
  l_orderkey AS k1, l_partkey AS k2, l_suppkey AS k3, CAST(l_linenumber AS BIGINT) AS k4, {_DAY} AS k5, l_extendedprice AS k6 FROM lineitem, bb)"""
PCS_SQL = PC_SQL + """,
pcs AS (SELECT x*x*x AS x, y*y*y AS y, z*z*z AS z, r, g, b, k1, k2, k3, k4, k5, k6 FROM pc)"""
