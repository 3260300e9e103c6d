"""Operator 8: near-duplicates by a MinHash LSH forest, confirmed on full shingle sets.

1. Every text becomes its set of 5-word shingles (64-bit hashes) and a MinHash
   signature. Texts with equal sets collapse to one class, found by aggregation.
2. Forest: each of ``TREES`` orders sorts all classes by ``DEPTH`` signature values, from
   its own start. A range partitioning deals out each order evenly, so even a region
   that holds a third of all classes is split. Every class meets up to ``WIDTH`` neighbours
   on either side, which are those with the longest common prefix, down to ``MIN_DEPTH``:
   crowded regions are compared at greater depth than sparse ones. Rows at partition
   borders are paired in a second small pass. Neighbours whose 2-bit sketches rule out
   the threshold don't count; of the others each task passes on what connects them, one
   row for each class and order. What is so connected is a region.
3. Confirmation on full sets. Each region gets a leader; each member's set is compared
   with the leader's and afterwards travels as its difference from it, from which the
   overlap of any two members follows exactly.
4. Regions with members unlike their leader are settled by depth. A region of up to
   ``RUN`` rows is compared whole. A larger one is sketched anew by its members' differences
   from what most of them share, which tells members apart that are all alike as whole
   texts; in each of ``INNER_TREES`` orders, members that agree in a prefix form a run,
   one value longer while a run has more than ``RUN`` rows. Runs that stay too large are
   regions of their own in the next round; what is left after ``ROUNDS`` rounds is compared
   block by block. A run passes on what connects its linked rows, never all pairs.
5. Components of confirmed links, by contraction.

Nothing but emptiness tests reaches the driver.

Defined results: null text, empty text and text without a word have the empty set and
no links. Fewer than five words are one shingle. Equal sets are linked. Rows that
repeat an id share one component id, the least id reachable from any of them. A row
with a null id is never a representative: it shares the component of rows with an equal
set, and without such a row it is linked to nothing, has a null component id and is kept. Extra columns are
ignored, or kept by ``drop_copies``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octaspark.llm.common import WordHasher, arrow_rows, cut_lineage, mix64, written
from octaspark.llm.components import connected

SHINGLE = 5
TREES, STEP, DEPTH = 16, 8, 12
PERMUTATIONS = TREES * STEP
MIN_DEPTH, WIDTH = 3, 24
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Candidates whose sketches estimate less than this are no links (about four deviations).
LEAST_ESTIMATE = 0.70
#: Members of a group that are compared with its leader in one slot.
SLOT = 64
#: Rows, and shingles in their differences, of a run that is compared whole.
RUN, RUN_SHINGLES = 1024, 1 << 21
#: Orders and greatest depth inside a region; orders whose large runs are settled again; rounds.
INNER_TREES, INNER_DEPTH, AGAIN_TREES, ROUNDS = 64, 4, 8, 3
#: Members from which a region's origin is taken. It decides how well members are told apart, not what is a link.
ORIGIN_ROWS = 64
#: Buckets of ids by which texts are filtered before their shuffle: a broadcast of 16 MB at most.
ID_BUCKETS = 1 << 20
#: Rows of an Arrow batch that carries whole sets.
SET_ROWS = 500
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_STEP = [np.uint64(x) for x in _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
_INNER = _rng.integers(1, 2**63, INNER_TREES * INNER_DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_hasher = WordHasher(SEPARATORS)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    if not text:
        return np.zeros(0, np.uint64)
    w = _hasher.words(text.encode("utf-8", "surrogatepass").lower())[0]  # bytes.lower() turns A-Z only
    if not len(w):
        return w
    if len(w) < SHINGLE:
        h = np.array([len(w)], np.uint64)
        for x in w:
            h = mix64(h * _STEP[0] + x)
        return h
    n = len(w) - SHINGLE + 1
    total = w[:n] * _STEP[0]
    for j in range(1, SHINGLE):
        total += w[j : j + n] * _STEP[j]
    return np.unique(mix64(total))


def least_hashes(s: np.ndarray, multiply: np.ndarray, add: np.ndarray | np.uint64) -> np.ndarray:
    least = np.full(len(multiply), np.uint64(2**64 - 1))
    for at in range(0, len(s), 512):
        np.minimum(least, (s[at : at + 512, None] * multiply + add).min(0), out=least)
    return mix64(least)


def signature(s: np.ndarray) -> tuple[bytes, bytes]:
    """Signature values of 16 bits (big endian, so that bytes sort as values do), and 2-bit sketches."""
    h = least_hashes(s, _MULTIPLY, _ADD)
    two = ((h >> np.uint64(40)) & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
    return (h >> np.uint64(48)).astype(">u2").tobytes(), (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    total, odd = int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(s))
    a, b = mix64(np.array([total ^ len(s), (odd + 3 * total) % 2**64], np.uint64)).view(np.int64)
    return int(a), int(b)


def sketches(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, n_shingles, key, key2, signature and bits of each row; nulls for the empty set."""
    names = ["id", "n_shingles", "key", "key2", "signature", "bits"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part, rows = b.slice(at, 1024), []
                for t in part.column(1).to_pylist():
                    s = shingles(t)
                    rows.append((len(s), *set_key(s), *signature(s)) if len(s) else (0, None, None, None, None))
                cols = zip(*rows)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, types))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, n_shingles long, key long, key2 long, signature binary, bits binary")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by rows of 2-bit sketches."""
    x = a ^ b
    differ = np.bitwise_count((x | x >> 1) & np.uint8(0x55)).sum(1, dtype=np.int64)
    return (1 - differ / PERMUTATIONS - 0.25) / 0.75


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's component, by edges i - j among n rows."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (nxt := root[root]).tobytes() != root.tobytes():
            root = nxt
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def _columns(table, names=("tree", "ord", "bits", "node")) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree and prefix of ``MIN_DEPTH`` values as one number, sketches and nodes."""
    tree, order, bits, node = (table.column(c) for c in names)
    raw = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(table.num_rows, -1)
    prefix = tree.to_numpy(zero_copy_only=False).astype(np.int64)
    first = raw(order)
    for k in range(2 * MIN_DEPTH):
        prefix = (prefix << 8) | first[:, k]
    return prefix, raw(bits), node.to_numpy(zero_copy_only=False)


def _neighbours(prefix, bits, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i < j that share a prefix, j at most WIDTH on and from ``new`` on, and what their sketches estimate."""
    out = [[], [], []]
    i = np.arange(len(prefix))
    for d in range(1, WIDTH + 1):
        i = i[: np.searchsorted(i, len(prefix) - d)]
        i = i[prefix[i] == prefix[i + d]]  # rows are sorted: who shares no prefix here shares none further on
        if not len(i):
            break
        a = i[np.searchsorted(i, new - d) :]
        e = estimate(bits[a], bits[a + d])
        ok = e >= LEAST_ESTIMATE
        for c, x in zip(out, (a[ok], a[ok] + d, e[ok])):
            c.append(x)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


_NAMES = ["node", "root", "weight", "tree", "ord", "bits", "part", "rows", "place"]
_SWEPT = "node long, root long, weight double, tree int, ord binary, bits binary, part int, rows long, place long"


def _sweep(batches):
    """What connects neighbours within a sorted partition; its first and last rows go out as border rows."""
    part = TaskContext.get().partitionId()
    last, first, total = None, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        both = now if last is None else pa.concat_tables([last, now]).combine_chunks()
        prefix, bits, node = _columns(both)
        i, j, e = _neighbours(prefix, bits, both.num_rows - now.num_rows)
        n, total = len(node), total + now.num_rows
        root = local_roots(n, i, j)
        weight = (np.bincount(i, e, n) + np.bincount(j, e, n)).astype(np.float64)
        at = np.flatnonzero(weight)
        none = [pa.nulls(len(at), t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]]), pa.array(weight[at]), *none], _NAMES)
        if first is None or first.num_rows < WIDTH:
            first = both.slice(0, WIDTH)
        last = both.slice(max(0, n - WIDTH))
    if last is None:
        return
    for table, start in ((first, 0), (last, total - last.num_rows)):
        n = table.num_rows
        cols = {c: table.column(c).combine_chunks() for c in ("node", "tree", "ord", "bits")}
        cols |= {"root": pa.nulls(n, pa.int64()), "weight": pa.nulls(n, pa.float64()), "part": pa.array([part] * n, pa.int32())}
        cols |= {"rows": pa.array([total] * n, pa.int64()), "place": pa.array(range(start, start + n), pa.int64())}
        yield from pa.table([cols[c] for c in _NAMES], _NAMES).to_batches()


def _across(batches):
    """Neighbours in different partitions, from joined border rows."""
    for b in batches:
        t = pa.Table.from_batches([b])
        if t.num_rows:
            p, x, a = _columns(t)
            q, y, z = _columns(t, ("tree2", "ord2", "bits2", "node2"))
            e = estimate(x, y)
            ok = (p == q) & (e >= LEAST_ESTIMATE)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(z[ok]), pa.array(e[ok])], ["node", "root", "weight"])


def candidates(classes: DataFrame) -> DataFrame:
    """Rows node, root, weight: what connects classes that are neighbours in some order, and how close a node's neighbours are."""
    both = F.concat("signature", F.substring("signature", 1, 2 * DEPTH))
    orders = F.array(*[F.substring(both, 1 + 2 * STEP * t, 2 * DEPTH) for t in range(TREES)])
    rows = classes.select("node", "bits", F.posexplode(orders).alias("tree", "ord")).select("tree", "ord", "bits", "node")
    swept = cut_lineage(rows.repartitionByRange("tree", "ord", "node").sortWithinPartitions("tree", "ord", "node").mapInArrow(_sweep, _SWEPT))
    border = swept.where("root IS NULL").select("tree", "ord", "bits", "node", "part", "rows", "place").distinct()
    # One row for each partition: where its rows start among all.
    sizes = border.groupBy("part").agg(F.max("rows").alias("rows"))
    starts = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("start"))
    border = border.join(starts, "part").withColumn("at", F.col("start") + F.col("place"))
    near = F.explode(F.array(F.floor(F.col("at") / WIDTH), F.floor(F.col("at") / WIDTH) + 1)).alias("block")
    ahead = border.select(*[F.col(c).alias(f"{c}2") for c in ("tree", "ord", "bits", "node", "part", "at")], F.floor(F.col("at") / WIDTH).alias("block"))
    met = border.select("tree", "ord", "bits", "node", "part", "at", near).join(ahead, "block").where(f"part <> part2 AND at2 > at AND at2 - at <= {WIDTH}")
    across = met.select("tree", "ord", "bits", "node", "tree2", "ord2", "bits2", "node2").mapInArrow(_across, "node long, root long, weight double")
    return swept.where("root IS NOT NULL").select("node", "root", "weight").unionByName(across)


def _own_sets(batches):
    """The shingle sets of the texts whose set has the wanted keys."""
    names = ("node", "leader", "slots", "key", "key2", "text")
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part, rows = b.slice(at, 512), []
            for node, leader, slots, key, key2, t in zip(*(part.column(c).to_pylist() for c in names)):
                s = shingles(t)
                if len(s) and set_key(s) == (key, key2):
                    rows.append((node, leader, slots, s.tobytes()))
            cols = list(zip(*rows)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], ["node", "leader", "slots", "shingles"])


def linked(n, m, apart):
    """Whether sets of n and m shingles with ``apart`` in just one of them are linked."""
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (n + m)


_MEMBER = ["group", "node", "n", "ok", "apart"]
_MEMBERS = "group long, node long, n long, ok boolean, apart binary"
_MEMBER_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())


def _against_leader(batches):
    """A member's size, whether it is linked with its leader, and in what they differ."""
    for b in batches:
        rows = []
        for node, leader, mine, theirs in zip(*(b.column(c).to_pylist() for c in ("node", "leader", "shingles", "leader_shingles"))):
            s, t = np.frombuffer(mine, np.uint64), np.frombuffer(theirs, np.uint64)
            apart = np.setxor1d(s, t, True)
            rows.append((leader, node, len(s), linked(len(s), len(t), len(apart)), apart.tobytes()))
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _MEMBER_TYPES)], _MEMBER)


def run_links(n: np.ndarray, ok: np.ndarray, apart: list[np.ndarray], block: int = 256) -> np.ndarray:
    """The first row of each row's component in a run, from all rows' exact overlaps.

    ``apart`` holds each set's difference from one origin, whatever that is. Rows that
    are both ``ok`` are linked with the same row elsewhere. Overlaps come from the rows of each shared
    shingle, and for shingles that many rows share from a product of matrices.
    """
    m = len(n)
    size = np.array([len(x) for x in apart])
    if m == 2:
        both = not ok.all() and linked(n[0], n[1], len(np.setxor1d(*apart, True)))
        return np.array([0, 0 if both else 1])
    row = np.repeat(np.arange(m), size)
    _, e, count = np.unique(np.concatenate(apart), return_inverse=True, return_counts=True)
    order = np.argsort(e, kind="stable")
    row, count = row[order], count
    first = np.cumsum(count) - count
    often = count > max(16, m // 8)
    wide = np.zeros((m, int(often.sum())), np.float32)
    of = np.repeat(np.arange(len(count)), count)
    wide[row[often[of]], (np.cumsum(often) - 1)[of[often[of]]]] = 1
    few = (count > 1) & ~often
    take = np.flatnonzero(few[of])
    take = take[np.argsort(row[take], kind="stable")]  # occurrences of rarer shared shingles, by row
    ends = np.searchsorted(row[take], np.arange(m + 1))
    found_i, found_j = [], []
    for lo in range(0, m, block):
        hi = min(m, lo + block)
        common = np.zeros((hi - lo) * m, np.int64)
        mine = take[ends[lo] : ends[hi]]
        for part in np.array_split(mine, 1 + int(count[of[mine]].sum()) // (1 << 22)):
            c = count[of[part]]
            there = np.repeat(first[of[part]] - np.cumsum(c) + c, c) + np.arange(c.sum())
            common += np.bincount(np.repeat(row[part] - lo, c) * m + row[there], minlength=len(common))
        common = common.reshape(hi - lo, m)
        if wide.shape[1]:
            common = common + np.rint(wide[lo:hi] @ wide.T).astype(np.int64)
        far = size[lo:hi, None] + size - 2 * common
        i, j = np.nonzero(linked(n[lo:hi, None], n, far) & ~(ok[lo:hi, None] & ok))
        later = j > i + lo
        found_i.append(i[later] + lo)
        found_j.append(j[later])
    return local_roots(m, np.concatenate(found_i), np.concatenate(found_j))


def _each_run(batches):
    """Links that connect the linked rows of each run; rows are sorted by run and a run's are bounded."""

    def close(run):
        node, n, ok, apart = zip(*run)
        if len(run) < 2:
            return []
        root = run_links(np.array(n), np.array(ok), [np.frombuffer(x, np.uint64) for x in apart])
        return [(node[i], node[r]) for i, r in enumerate(root.tolist()) if r != i]

    now, rows = None, []
    for b in batches:
        out = []
        for run, *rest in zip(*(b.column(c).to_pylist() for c in ("run", "node", "n", "ok", "apart"))):
            if run != now and rows:
                out += close(rows)
                rows = []
            now = run
            rows.append(rest)
        cols = list(zip(*out)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])
    if rows:
        cols = list(zip(*close(rows))) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def _compare(runs: DataFrame) -> DataFrame:
    """a, b from rows run, node, n, ok, apart."""
    return runs.select("run", "node", "n", "ok", "apart").repartition("run").sortWithinPartitions("run").mapInArrow(_each_run, "a long, b long")


def _origins(batches):
    """What more than half of the given members have apart."""
    for b in batches:
        rows = []
        for group, sets in zip(b.column("group").to_pylist(), b.column("sets").to_pylist()):
            e, count = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in sets]), return_counts=True)
            rows.append((group, e[2 * count > len(sets)].tobytes()))
        cols = list(zip(*rows)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], ["group", "origin"])


_KEYS = [f"k{d}" for d in range(INNER_DEPTH)]


def _resketch(batches):
    """Differences from the group's origin, and keys of all prefixes in all inner orders."""
    salt = np.arange(INNER_TREES, dtype=np.uint64)
    for b in batches:
        rows = []
        for group, node, n, ok, apart, origin in zip(*(b.column(c).to_pylist() for c in (*_MEMBER, "origin"))):
            x = np.setxor1d(np.frombuffer(apart, np.uint64), np.frombuffer(origin, np.uint64), True)
            values = least_hashes(x, _INNER, np.uint64(0)).reshape(INNER_TREES, INNER_DEPTH)
            key, keys = mix64(np.uint64(group % 2**64) + mix64(salt)), []
            for d in range(INNER_DEPTH):
                key = mix64(key ^ values[:, d])
                keys.append(key.view(np.int64).tolist())
            rows.append((group, node, n, ok, x.tobytes(), *keys))
        cols = list(zip(*rows)) or [[]] * (5 + INNER_DEPTH)
        types = (*_MEMBER_TYPES, *[pa.list_(pa.int64())] * INNER_DEPTH)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], [*_MEMBER, *_KEYS])


#: Rows that fit one run; few rows are compared whatever their length.
_FITS = f"(rows <= 16 OR rows <= {RUN} AND shingles <= {RUN_SHINGLES})"


def _sizes(rows: DataFrame, key: str, size) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.sum(size).alias("shingles"), F.count_if(~F.col("ok")).alias("alone"))


def settled(members: DataFrame) -> DataFrame:
    """a, b: what connects linked members of each group, where some member isn't linked with its leader."""
    size = F.floor(F.length("apart") / 8)
    found: list[DataFrame] = []
    for turn in range(ROUNDS + 1):
        # Of two rows the first time, one is the other's leader.
        sizes = written(_sizes(members, "group", size).where(f"alone > 0 AND rows > {2 if turn == 0 else 1}"), "sizes")
        small = members.join(sizes.where(_FITS).select("group"), "group").withColumnRenamed("group", "run")
        found.append(cut_lineage(_compare(small)))
        large = sizes.where(f"NOT {_FITS}").select("group", "rows")
        if large.isEmpty():
            break
        slot = F.ceil(F.col("rows") / SLOT).alias("slots")
        rows = members.join(large.select("group", "rows", slot), "group")
        if turn == ROUNDS:
            # Block by block: every two blocks of a group are a run.
            blocks = F.ceil(2 * F.col("rows") / RUN)
            rows = rows.withColumn("x", F.pmod(F.xxhash64("node"), blocks)).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            run = F.xxhash64("group", F.least("x", "y"), F.greatest("x", "y")).alias("run")
            found.append(cut_lineage(_compare(rows.select(run, "node", "n", "ok", "apart"))))
            break
        some = rows.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("rows") / ORIGIN_ROWS)) == 0)
        origins = some.groupBy("group").agg(F.collect_list("apart").alias("sets")).mapInArrow(_origins, "group long, origin binary")
        origins = large.select("group", slot).join(origins, "group", "left").withColumn("origin", F.coalesce("origin", F.lit(b"")))
        origins = origins.select("group", "origin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
        dealt = rows.withColumn("slot", F.pmod(F.hash("node"), F.col("slots"))).join(origins, ["group", "slot"])
        lists = ", ".join(f"{k} array<long>" for k in _KEYS)
        moved = cut_lineage(dealt.select(*_MEMBER, "origin").mapInArrow(_resketch, f"{_MEMBERS}, {lists}"))
        at = moved.select("group", "node", "ok", size.alias("size"), F.posexplode(F.arrays_zip(*_KEYS)).alias("tree", "keys"))
        at = cut_lineage(at.select("group", "node", "ok", "size", "tree", "keys.*", F.col("keys.k0").alias("run")))
        for k in _KEYS[1:]:
            big = written(_sizes(at, "run", "size").where(f"NOT {_FITS}").select("run", F.lit(True).alias("big")), "big")
            at = at.join(big, "run", "left").withColumn("run", F.when(F.col("big"), F.col(k)).otherwise(F.col("run"))).drop("big")
        ends = written(_sizes(at, "run", "size").where("alone > 0 AND rows > 1").select("run", F.expr(_FITS).alias("fits")), "ends")
        at = cut_lineage(at.select("group", "node", "tree", "run").join(ends, "run"))
        wanted = at.where(F.col("fits") | (F.col("tree") < AGAIN_TREES)).select("group", "node", "run", "fits")
        runs = wanted.join(moved.select(*_MEMBER), ["group", "node"])
        found.append(cut_lineage(_compare(runs.where("fits"))))
        members = cut_lineage(runs.where("NOT fits").select(F.col("run").alias("group"), "node", "n", "ok", "apart"))
    return reduce(DataFrame.unionByName, found)


def confirmed(docs: DataFrame, classes: DataFrame, close: DataFrame, id_col: str, text: str) -> DataFrame:
    """node and root of all classes with a confirmed link."""
    close = cut_lineage(close)
    weight = close.groupBy("node").agg(F.sum("weight").alias("weight"))
    groups = connected(close, "node", "root").join(weight, "node", "left")
    leaders = groups.groupBy("root").agg(F.max_by("node", F.struct(F.coalesce("weight", F.lit(0.0)), -F.col("node"))).alias("leader"), F.count("*").alias("size"))
    # A large group is dealt over several slots; its leader's set goes to each of them.
    members = groups.join(leaders.select("root", "leader", F.ceil(F.col("size") / SLOT).alias("slots")), "root").select("node", "leader", "slots")
    wanted = cut_lineage(members.join(classes.select("node", "key", "key2", F.col("rep").alias("_id")), "node"))
    # Most texts are in no region: those whose id falls in no wanted bucket stay where they are. There are ID_BUCKETS rows at most to broadcast.
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS)).cast("long")
    buckets = F.broadcast(wanted.select(bucket("_id").alias("_bucket")).distinct())
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text"), bucket(id_col).alias("_bucket")).join(buckets, "_bucket", "left_semi")
    texts = texts.join(wanted, "_id").select("node", "leader", "slots", "key", "key2", "text")
    sets = cut_lineage(texts.mapInArrow(_own_sets, "node long, leader long, slots long, shingles binary"))
    of_leaders = sets.where("node = leader").groupBy("leader").agg(F.first("shingles").alias("leader_shingles"), F.first("slots").alias("slots"))
    of_leaders = of_leaders.select("leader", "leader_shingles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    dealt = sets.withColumn("slot", F.pmod(F.hash("node"), F.col("slots")))
    both = dealt.select("node", "leader", "slot", "shingles").join(of_leaders, ["leader", "slot"])
    with arrow_rows(docs.sparkSession, SET_ROWS):  # once for each node, though rows may repeat
        compared = both.mapInArrow(_against_leader, _MEMBERS).groupBy("node").agg(*[F.first(c).alias(c) for c in _MEMBER if c != "node"])
        compared = cut_lineage(compared.select(*_MEMBER))
        stars = compared.where("ok AND node <> group").select(F.col("node").alias("a"), F.col("group").alias("b"))
        return connected(stars.unionByName(settled(compared)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept for every row."""
    rows = cut_lineage(sketches(docs, id_col, text))
    classes = cut_lineage(
        rows.where("n_shingles > 0").groupBy("key", "key2").agg(F.min("id").alias("rep"), F.first("signature").alias("signature"), F.first("bits").alias("bits"))
    )
    # A class is named by its first key; of several that share it only one is.
    shared = classes.groupBy("key").agg(F.min("key2").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    node = F.when(F.col("first") == F.col("key2"), F.col("key")).when(F.col("first").isNotNull(), F.xxhash64("key", "key2")).otherwise(F.col("key"))
    classes = classes.join(shared, "key", "left").withColumn("node", node)
    roots = confirmed(docs, classes, candidates(classes), id_col, text)
    reps = cut_lineage(classes.select("node", "key", "key2", "rep").join(roots, "node", "left").select("key", "key2", "rep", F.coalesce("root", "node").alias("root")))
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = reps.join(least, "root").select("key", "key2", "component_id")
    out = rows.select("id", "n_shingles", "key", "key2").join(by_class, ["key", "key2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    out = out.select("id", "n_shingles", component.alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: the least id, once."""
    found = cut_lineage(near_duplicates(docs, id_col, text))
    once = found.groupBy(id_col).agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    gone = once.where("NOT kept").select(id_col)
    left = docs.join(gone, id_col, "left_anti").select(docs.columns)
    again = cut_lineage(once.where(f"n > 1 AND `{id_col}` IS NOT NULL").select(id_col))
    if again.isEmpty():
        return left
    single = left.join(again, id_col, "left_anti").select(docs.columns)
    return single.unionByName(left.join(again, id_col, "left_semi").select(docs.columns).dropDuplicates([id_col]))
