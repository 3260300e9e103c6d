"""Physical layouts: Morton order, batches, quantised coordinates, mask trees and images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octaspark.functions.geometry import bit_length, clamp, grid_index, morton, morton2_inverse
from octaspark.operators.ordering import ranked
from octaspark.sources.tables import ORDER
from octaspark.staging import few, written


def with_morton(points: DataFrame, bits: int = 21, order: str = "xyz") -> DataFrame:
    return points.withColumn("code", morton(*[grid_index(F.col(a), bits) for a in "xyz"], order=order))


def morton_rank(points: DataFrame, bits: int = 21, order: str = "xyz") -> DataFrame:
    return ranked(with_morton(points, bits, order), "code", *ORDER)


def shuffle_hash(c: Column, seed: int = 0) -> Column:
    """A pseudo-random number below 2**31 - 1 in plain arithmetic."""
    return ((c + seed) % 2147483647 * 48271 + 12345) % 2147483647


#: Blocks whose first positions travel together, as one array.
BUNCH = 1024


def block_shuffle(points: DataFrame, block: int = 128, keep: Sequence[str] | None = None) -> DataFrame:
    """Morton order, then whole blocks in pseudo-random order; keeps the order within a block.

    Only columns ``keep`` travel beside the order, all without it. Rows are shuffled once, for the first order. Blocks alone
    are put into the second; a row's position is its block's first one and its place in it.
    """
    rows = with_morton(points)
    rows = ranked(rows if keep is None else rows.select("code", *dict.fromkeys([*ORDER, *keep])), "code", *ORDER)
    rows = rows.withColumns({"block": F.floor(F.col("rank") / block).cast("long"), "place": F.col("rank") % block})
    first = few(written(first_positions(rows.agg(F.count("*")).first()[0], block, points.sparkSession), "blocks"), 8_000)  # 8 KB each
    if keep is not None:
        rows = rows.select(*keep, "block", "place")
    at = F.get("_first", (F.col("block") % BUNCH).cast("int")) + F.col("place")
    return rows.withColumn("_bunch", F.shiftright("block", BUNCH.bit_length() - 1)).join(first, "_bunch").withColumn("position", at).drop("_bunch", "_first")


def first_positions(n: int, block: int, spark: SparkSession) -> DataFrame:
    """_bunch and _first, the first positions of its blocks, when the blocks of ``n`` rows follow each other by ``shuffle_hash``.

    All blocks are full but the one with the highest number, so those after it begin earlier by what it lacks.
    """
    blocks = ranked(spark.range(-(-n // block)).select(F.col("id").alias("block"), shuffle_hash(F.col("id")).alias("_hash")), "_hash", "block")
    last = -(-n // block) - 1
    lacks = (last + 1) * block - n
    behind = F.col("_hash") > shuffle_hash(F.lit(last).cast("long"))
    position = F.col("rank") * block - F.when(behind, F.lit(lacks)).otherwise(F.lit(0))
    bunches = blocks.groupBy(F.shiftright("block", BUNCH.bit_length() - 1).alias("_bunch")).agg(F.sort_array(F.collect_list(F.struct("block", position.alias("position")))).alias("_all"))
    return bunches.select("_bunch", F.col("_all.position").alias("_first"))


def with_batches(points: DataFrame, size: int) -> DataFrame:
    """Batch number and place of each point in its order."""
    rows = ranked(points, *ORDER, name="pid")
    return rows.withColumn("batch_id", F.floor(F.col("pid") / size).cast("long"))


def batch_summary(batched: DataFrame) -> DataFrame:
    """Bounding box, size and mean colour of each batch."""
    box = [f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)]
    return batched.groupBy("batch_id").agg(*box, F.count("*").alias("n"), *[F.floor(F.sum(c) / F.count("*")).cast("int").alias(f"mean_{c}") for c in "rgb"])


def quantise_planes(batched: DataFrame) -> DataFrame:
    """30 bits per axis in the batch's box, split into planes of 10 bits (low holds the top bits)."""
    box = batch_summary(batched).select("batch_id", *[f"{e}_{a}" for e in ("min", "max") for a in "xyz"])
    rows = batched.join(box, "batch_id")

    def cell(a: str) -> Column:
        size = F.col(f"max_{a}") - F.col(f"min_{a}")
        u = F.when(size > 0, (F.col(a) - F.col(f"min_{a}")) / size).otherwise(F.lit(0.0))
        return clamp(F.floor(u * float(1 << 30)), 0, (1 << 30) - 1).cast("long")

    q = rows.select("pid", "batch_id", *[cell(a).alias(a) for a in "xyz"])
    plane = lambda shift: sum((F.shiftleft(F.shiftright(a, shift).bitwiseAND(F.lit(1023)), 10 * k) for k, a in enumerate("xyz")), F.lit(0).cast("long"))
    return q.select("pid", "batch_id", plane(20).alias("xyz_low"), plane(10).alias("xyz_med"), plane(0).alias("xyz_hig"))


def quantise(points: DataFrame, bits: int) -> DataFrame:
    """Each axis on 2**bits steps of the unit cube."""
    return points.select(*ORDER, *[grid_index(F.col(a), bits).alias(f"q{a}") for a in "xyz"])


def bits_per_batch(batched: DataFrame, precision: float = 0.001) -> DataFrame:
    """Bits per axis that the batch's extent needs at the precision, and the batch's total."""
    box = batch_summary(batched)
    bits = {f"bits_{a}": bit_length(F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / F.lit(precision)).cast("long")) for a in "xyz"}
    out = box.select("batch_id", "n", *[c.alias(k) for k, c in bits.items()])
    return out.withColumn("total_bits", (F.col("bits_x") + F.col("bits_y") + F.col("bits_z")) * F.col("n"))


def bits_total(per_batch: DataFrame) -> DataFrame:
    """Points, bits, bits per point and megabytes of a whole cloud at its batches' widths."""
    out = per_batch.agg(F.sum("n").alias("points"), F.sum("total_bits").alias("bits"))
    return out.withColumns({"bits_per_point": F.round(F.col("bits") / F.col("points"), 6), "megabytes": F.round(F.col("bits") / 8e6, 6)})


def pack_batches(batched: DataFrame, precision: float = 0.001) -> DataFrame:
    """Each point's steps in its batch's box at the batch's bit widths, as one number, and where its bits start in the batch."""
    bits = bits_per_batch(batched, precision).select("batch_id", "bits_x", "bits_y", "bits_z")
    low = batch_summary(batched).select("batch_id", *[f"min_{a}" for a in "xyz"])
    rows = batched.join(bits, "batch_id").join(low, "batch_id")
    rows = rows.withColumns({f"q{a}": F.floor((F.col(a) - F.col(f"min_{a}")) / F.lit(precision)).cast("long") for a in "xyz"})
    code = F.expr("shiftleft(qx, bits_y + bits_z) | shiftleft(qy, bits_z) | qz")
    place = F.col("pid") - F.min("pid").over(Window.partitionBy("batch_id"))
    return rows.select("batch_id", "pid", code.alias("code"), (place * (F.col("bits_x") + F.col("bits_y") + F.col("bits_z"))).alias("bit_offset"))


def packed(points: DataFrame, bits: int) -> DataFrame:
    """The three steps of ``quantise`` in one number, x lowest."""
    q = quantise(points, bits)
    return q.select(*ORDER, F.expr(f"qx | shiftleft(qy, {bits}) | shiftleft(qz, {2 * bits})").alias("code"))


def order_within(rows: DataFrame, group: list[str], code: Column | str) -> DataFrame:
    """Place of each row in its group's Morton order: the rank by group and code less the group's least, so no group is sorted by one task.

    Rows are shuffled once if there are few groups; select beforehand what shall travel.
    """
    if not isinstance(code, str):
        rows, code = rows.withColumn("_code", code), "_code"
    numbered = ranked(rows, *group, code, *ORDER, name="_rank")
    first = few(written(numbered.groupBy(*group).agg(F.min("_rank").alias("_first")), "first"))
    return numbered.join(first, group).withColumn("place", F.col("_rank") - F.col("_first")).drop("_rank", "_first", "_code")


def order_within_known(rows: DataFrame, group: Column, code: str, first: DataFrame) -> DataFrame:
    """As ``order_within``, where ``code`` holds the group in its top bits and ``first`` (leaf, first) tells how many rows lie before each group.

    Points aren't read again for what is known.
    """
    numbered = ranked(rows, code, *ORDER, name="_rank").withColumn("leaf", group)
    return numbered.join(few(written(first, "first")), "leaf").withColumn("place", F.col("_rank") - F.col("first")).drop("_rank", "first", code)


def residue_permutation(c: Column, prime: int = 2147483647) -> Column:
    """A permutation of 0 .. prime - 1 by quadratic residues; the prime leaves 3 when divided by 4."""
    square = (c * c) % prime
    return F.when(2 * c <= prime, square).otherwise(prime - square)


def single_octant(summary: DataFrame) -> DataFrame:
    """The octant of the unit cube that holds a whole batch's box, or -1 if it lies in several."""
    half = lambda c: F.least(F.floor(F.col(c) * 2), F.lit(1))
    fits, octant = F.lit(True), F.lit(0)
    for a, weight in zip("xyz", (4, 2, 1)):
        fits, octant = fits & (half(f"min_{a}") == half(f"max_{a}")), octant + half(f"min_{a}") * weight
    return summary.withColumn("octant", F.when(fits, octant).otherwise(F.lit(-1)).cast("int"))


def delta_bits(batched: DataFrame) -> DataFrame:
    """Bits of the differences to the point before, in thousandths, summed by batch; the first
    point differs from 0."""
    w = Window.partitionBy("batch_id").orderBy("pid")

    def cost(a: str) -> Column:
        d = F.floor(F.abs(1000 * (F.col(a) - F.lag(a, 1, 0.0).over(w)))).cast("long")
        return F.when(d == 0, F.lit(1)).otherwise(bit_length(d) + 1)

    rows = batched.select("batch_id", *[cost(a).alias(f"d{a}") for a in "xyz"])
    return rows.groupBy("batch_id").agg(*[F.sum(f"d{a}").alias(f"delta_bits_{a}") for a in "xyz"], F.count_if(F.col("dx") > 8).alias("jumps"))


def morton_image(colours: DataFrame, *order: str) -> DataFrame:
    """Pixel of each row along a 2-D Morton curve, on the least square image of a power of two."""
    rows = ranked(colours, *order)
    n = rows.agg(F.count("*").alias("_n"))
    side = F.pow(F.lit(2.0), F.ceil(F.log2(F.sqrt(F.greatest("_n", F.lit(1)))))).cast("int")
    px, py = morton2_inverse(F.col("rank"), 16)
    return rows.withColumns({"px": px, "py": py}).crossJoin(F.broadcast(n.select(side.alias("side"))))  # one row


def mask_tree(cells: DataFrame, bits: int) -> DataFrame:
    """(level, key, mask) of all inner nodes above occupied cells: the child octants that exist.

    ``cells`` holds the Morton codes of a 2**bits grid as ``key``.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level")
    rows = cells.select("key", level).select(
        "level", F.expr(f"shiftright(key, 3 * ({bits} - level))").alias("node"), F.expr(f"shiftleft(1, cast(shiftright(key, 3 * ({bits} - level - 1)) & 7 AS int))").alias("bit")
    )
    return rows.groupBy("level", F.col("node").alias("key")).agg(F.bit_or("bit").cast("int").alias("mask"))


def depth_first(masks: DataFrame, bits: int) -> DataFrame:
    """Position of each mask when parents come before their children, depth first."""
    first = F.expr(f"shiftleft(key, 3 * ({bits} - level))")
    return ranked(masks, first, "level", name="ord")


def decode_masks(masks: DataFrame, bits: int) -> DataFrame:
    """Occupied cells of a mask tree: the children of its deepest nodes."""
    deepest = masks.where(F.col("level") == bits - 1)
    digit = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("digit")
    return deepest.select("key", "mask", digit).where("(shiftright(mask, digit) & 1) = 1").select((F.shiftleft("key", 3) + F.col("digit")).alias("key"))


def parent_voxel_masks(voxels: DataFrame) -> DataFrame:
    """For the voxels of each level below the root, which octants of the parent's voxel they fill."""
    bit = F.expr("shiftleft(1, cast(((vx & 1) << 2) | ((vy & 1) << 1) | (vz & 1) AS int))")
    rows = voxels.where("level > 0").select((F.col("level") - 1).alias("level"), *[F.shiftright(f"v{a}", 1).alias(f"v{a}") for a in "xyz"], bit.alias("bit"))
    return rows.groupBy("level", "vx", "vy", "vz").agg(F.bit_or("bit").cast("int").alias("mask"))


def batch_by_prefix(described: DataFrame, step: int = 3) -> DataFrame:
    """Nodes grouped by the beginning of their name, cut at a level divisible by ``step``."""
    prefix = F.expr(f"substring(name, 1, 1 + level - level % {step})")
    return described.groupBy(prefix.alias("batch")).agg(F.count("*").alias("nodes"), F.sum("n").alias("points"), F.min("level").alias("least_level"))


def byte_offset_bins(tree: DataFrame, record: int, least: int) -> DataFrame:
    """Nodes in byte order cut into bins by the running number of points (floor of sum / least)."""
    from octaspark.operators.octree import leaf_slices

    rows = leaf_slices(tree).withColumn("bin", F.floor(F.col("slice_offset") / least).cast("long"))
    return _bin_summary(rows, record)


def closing_bins(tree: DataFrame, record: int, most: int) -> DataFrame:
    """Nodes in byte order put into bins that are closed once they hold more than ``most`` points."""
    from octaspark.operators.octree import leaf_slices
    from octaspark.operators.ordering import bins_with_reset

    return _bin_summary(bins_with_reset(leaf_slices(tree), F.col("n"), most, "slice_offset", "level", "key"), record)


def _bin_summary(rows: DataFrame, record: int) -> DataFrame:
    return rows.groupBy("bin").agg(F.count("*").alias("nodes"), F.sum("n").alias("points"), F.min("level").alias("weight"), (F.min("slice_offset") * record).alias("byte_offset"), (F.sum("n") * record).alias("byte_size"))
