"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Only a local session may do without; it then gets a folder of this machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return named or sc.getCheckpointDir()


_scratch = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that ``written`` makes inside are deleted at the end: use it around what writes its own result."""
    before, _scratch.paths = getattr(_scratch, "paths", None), []
    _scratch.outer = [*getattr(_scratch, "outer", []), before]
    try:
        yield
    finally:
        paths, _scratch.paths = _scratch.paths, before
        _scratch.outer.pop()
        for path in paths:
            remove_folder(spark, path)


def written(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """``df`` as a table below the shared folder: like ``cut_lineage``, but the planner knows its size.

    With ``outlives`` it stays when the innermost ``scratch`` ends, and goes with the one around that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    outer = getattr(_scratch, "outer", [])
    paths = (outer[-1] if outer else None) if outlives else getattr(_scratch, "paths", None)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder, so that the rows survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is computed inside, where rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of a byte string in a few numpy passes.

    A word's hash is a polynomial over random byte values, taken from one prefix sum
    (the base is odd, so powers can be divided out modulo 2**64), then mixed. Texts
    longer than ``block`` bytes go through in blocks cut at separators, so the working
    arrays stay small.
    """

    def __init__(self, separators: bytes, block: int = 1 << 19, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.sep = np.zeros(256, bool)
        self.sep[list(separators)] = True
        self.block = block
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.power = self.unpower = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            n = max(n + 1, min(2 * len(self.power), self.block))
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self.base))])
            self.unpower = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self.inverse))])

    def _block(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._powers(len(a))
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = ~self.sep[a]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.value[a] * self.power[: len(a)], out=total[1:])
        return mix64((total[end] - total[start]) * self.unpower[start]), start, end

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end (byte offsets) of each word."""
        a = np.frombuffer(data, np.uint8)
        if len(a) <= self.block:
            return self._block(a)
        parts, at = [], 0
        while at < len(a):
            to = min(at + self.block, len(a))
            if to < len(a):
                cut = np.flatnonzero(self.sep[a[at:to]])
                while not len(cut) and to < len(a):  # one word longer than a block
                    more = min(to + self.block, len(a))
                    cut = np.flatnonzero(self.sep[a[to:more]]) + (to - at)
                    to = more
                to = at + int(cut[-1]) + 1 if len(cut) else len(a)
            h, s, e = self._block(a[at:to])
            parts.append((h, s + at, e + at))
            at = to
        return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def chunks(lengths, most: int):
    """Slices of consecutive rows whose lengths sum to about ``most``."""
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield slice(at, len(lengths))
