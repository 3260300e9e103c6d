"""Connected components by rounds of contraction, all in joins and aggregations."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octaspark.llm.common import remove_folder, shared_folder, written as kept


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (one node of its component, the same for all) of every node that has an edge.

    Each round orders the nodes anew, points every node at the first of itself and its
    neighbours, and replaces the ends of the remaining edges by what they point at. The
    order is the nodes' own, xor a constant of the round, so that no numbering of the
    nodes (a path in order, say) keeps the rounds from shrinking the graph by a share of its
    nodes. Each round's pointers are kept and composed at the end. Only aggregations with
    map-side combining and left joins are used: a node with very many edges is
    pre-aggregated, or split by AQE.

    Rounds are written as tables below ``components-*`` in the shared folder and read again.
    A checkpoint would carry the planner's size estimate along, which joins multiply
    from round to round; a table has its real size. The folder goes when the result is written.
    """
    rng = np.random.default_rng(17)
    spark = edges.sparkSession
    top = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{top}/{name}")
        return spark.read.schema(df.schema).parquet(f"{top}/{name}")

    rest = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    maps: list[DataFrame] = []
    while True:
        rest = written(rest, f"edges-{len(maps)}")
        if rest.isEmpty():
            break
        turn = F.lit(int(rng.integers(-(2**63), 2**63 - 1)))
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.col("b").bitwiseXOR(turn)).alias("p"))
        to = written(first.select("node", F.least(F.col("node").bitwiseXOR(turn), "p").bitwiseXOR(turn).alias("to")), f"map-{len(maps)}")
        maps.append(to)
        moved = _move(_move(rest, to, "a"), to, "b").where("a <> b")
        rest = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if not maps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for m in reversed(maps[:-1]):
        out = _compose(m, out)
    roots = kept(out.select("node", F.col("to").alias("root")), "roots")
    remove_folder(spark, top)
    return roots


def _move(edges: DataFrame, to: DataFrame, end: str) -> DataFrame:
    return edges.join(to.select(F.col("node").alias(end), F.col("to").alias("_to")), end).drop(end).withColumnRenamed("_to", end)


def _compose(first: DataFrame, then: DataFrame) -> DataFrame:
    nxt = then.select(F.col("node").alias("to"), F.col("to").alias("_root"))
    return first.join(nxt, "to", "left").select("node", F.coalesce("_root", "to").alias("to"))
