"""Incremental builds: the state of a growing tree is a table of sums by finest voxel cell.

Leaves are not monotone (a leaf may split later), so neither nodes nor voxels are ever emitted for good: each
micro-batch adds its counts and colour sums, and nodes and coloured voxels are derived from the state when
asked for, equal to those of a build of all points at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octaspark.functions.geometry import morton, morton_inverse
from octaspark.operators import octree, voxelize
from octaspark.operators.octree import TreeSpec
from octaspark.staging import make_folder, names_in, remove, shared_folder

STATE = "cell long, n long, r long, g long, b long"


class IncrementalTree:
    """Folds streams of points into state, one Parquet folder per micro-batch.

    Writing a batch again (after a failure) replaces its folder, so sums stay exact. ``compact`` puts batches together
    under a new name that tells which it holds; the newest such folder that is complete counts, and batches that it holds
    count no more, whether their folders are still there, are gone, or come again.
    """

    def __init__(self, spark: SparkSession, spec: TreeSpec, folder: str):
        self.spark, self.spec, self.folder = spark, spec, folder

    def add(self, points: DataFrame, batch_id: int) -> None:
        """Folds in a batch of points; without columns r, g, b their colour is black."""
        if batch_id <= self._compacted()[1]:
            return  # it came again after it was compacted
        indexed = octree.with_fine_index(points, self.spec)
        colours = [F.sum(F.col(c).cast("long")) if c in points.columns else F.lit(0).cast("long") for c in "rgb"]
        cell = morton(*[F.shiftright(f"i{a}", 1) for a in "xyz"]).alias("cell")
        state = indexed.groupBy(cell).agg(F.count("*").alias("n"), *[s.alias(c) for s, c in zip(colours, "rgb")])
        state.write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch_id}")

    def _compacted(self) -> tuple[str | None, int]:
        """Name of the newest complete compaction, and the last batch that it holds."""
        done = [n for n in names_in(self.spark, f"{self.folder}/done")]
        if not done:
            return None, -1
        newest = max(done, key=lambda n: int(n.split("-")[1]))
        return newest, int(newest.split("-")[1])

    def _current(self) -> tuple[list[str], int]:
        """Folders that make up the state now, and the last batch in them."""
        newest, last = self._compacted()
        batches = [n for n in names_in(self.spark, f"{self.folder}/state") if n.startswith("batch=") and int(n[6:]) > last]
        return batches + ([newest] if newest else []), max([last, *(int(n[6:]) for n in batches)])

    def state(self) -> DataFrame:
        """cell, n and sums r, g, b of all points so far."""
        return self._sums(self._current()[0])

    def _sums(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], STATE)
        rows = self.spark.read.schema(STATE).parquet(*[f"{self.folder}/state/{n}" for n in folders])
        return rows.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "r", "g", "b")])

    def counts(self) -> DataFrame:
        """key and n of the cells of the deepest nodes."""
        return self.state().groupBy(F.shiftright("cell", 3 * (self.spec.grid_bits - 1)).alias("key")).agg(F.sum("n").alias("n"))

    def nodes(self) -> DataFrame:
        return octree.nodes(self.counts(), self.spec)

    def voxels(self, levels: int = 3) -> DataFrame:
        """level, vx, vy, vz and n: occupied voxels of inner nodes down to ``levels``, from the counts alone."""
        most = self.spec.max_depth - self.spec.grid_bits
        if not 0 < levels <= most + 1:
            raise ValueError(f"counts are fine enough for {most + 1} levels")
        level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
        cells = self.counts().select(level, "key", "n")
        cell = F.expr(f"shiftright(key, 3 * ({most} - level))").alias("cell")
        cells = cells.select("level", cell, "n").groupBy("level", "cell").agg(F.sum("n").alias("n"))
        inner = self.nodes().where("NOT is_leaf").select("level", "key")
        cells = cells.withColumn("key", F.shiftright("cell", 3 * self.spec.grid_bits)).join(inner, ["level", "key"], "left_semi")
        at = morton_inverse(F.col("cell"), self.spec.max_depth)
        return cells.select("level", *[c.alias(f"v{a}") for a, c in zip("xyz", at)], "n")

    def coloured_voxels(self) -> DataFrame:
        """level, vx, vy, vz, r, g, b and samples of all inner nodes' voxels, averaged."""
        cells = self.state().withColumn("key", F.shiftright("cell", 3 * (self.spec.grid_bits - 1)))
        return voxelize.average_from_sums(octree.with_leaf(cells, self.spec, self.counts(), self.nodes()), self.spec)

    def compact(self) -> None:
        """Puts all batches so far together; a crash at any point leaves the state as it was or as it will be."""
        newest, last = self._compacted()
        folders, upto = self._current()  # a batch that comes while this runs isn't in it
        if upto == last:
            return
        name = f"upto-{upto}-{uuid.uuid4().hex}"
        self._sums(folders).write.parquet(f"{self.folder}/state/{name}")
        make_folder(self.spark, f"{self.folder}/done/{name}")  # from here on it counts
        covered = [n for n in names_in(self.spark, f"{self.folder}/state") if n.startswith("batch=") and int(n[6:]) <= upto]
        for old in [*covered, *([newest] if newest else [])]:
            remove(self.spark, f"{self.folder}/state/{old}")
        if newest:
            remove(self.spark, f"{self.folder}/done/{newest}")

    def follow(self, stream: DataFrame):
        """Starts a query that folds in what arrives; call ``stop`` or ``awaitTermination`` on it."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start()


def replay(points: DataFrame, spec: TreeSpec, files: int = 4, order: str = "event_id", compact_at: int | None = None) -> IncrementalTree:
    """An incremental tree after streaming ``points`` in about ``files`` batches; with ``compact_at`` the batches until that one are put together.

    What a batch holds is written by many tasks, as many as shuffles have.
    """
    spark = points.sparkSession
    top = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    tasks = max(files, int(spark.conf.get("spark.sql.shuffle.partitions")))
    points.repartitionByRange(tasks, order).write.option("maxRecordsPerFile", 5_000_000).parquet(f"{top}/in")
    tree = IncrementalTree(spark, spec, top)
    found = sum(n.endswith(".parquet") for n in names_in(spark, f"{top}/in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", max(1, -(-found // files))).parquet(f"{top}/in")
    if compact_at is not None:
        once = stream.writeStream.foreachBatch(lambda df, k: (tree.add(df, k), tree.compact() if k == compact_at else None)[0])
        once.option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start().awaitTermination()
    else:
        tree.follow(stream).awaitTermination()
    return tree


def replay_events(points: DataFrame, spec: TreeSpec, files: int = 4) -> DataFrame:
    """Nodes after streaming ``points`` (with event_id) through an incremental tree."""
    return replay(points, spec, files).nodes()
