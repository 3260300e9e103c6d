"""Operator 11: importance resampling of documents towards a target's distribution.

Texts become words (A-Z lower-cased) and features: all runs of up to ``runs`` words.
Features are hashed into ``buckets`` buckets by crc32. The corpus and the target are counted by
bucket, which gives one array of log-ratio gains; a document's weight is the floored mean of
its features' gains. With a Gumbel number drawn from the hash of its id added, the highest scores
are a sample without replacement in proportion to exp(weight / 1000).

Scores are written once to the shared folder. How many rows are drawn is exact: the cutoff
score is found by bisection, each step a job that counts rows above a few thresholds; among rows that
tie with the cutoff a second bisection over ids finds the last one. Only counts reach the driver.
Drawn rows are range-partitioned by score and id and numbered by their place and their partition's start.

Defined results: null and empty texts have no features and weight 0. Rows with a null id are
counted as corpus text, but have a null score and are never drawn. Rows that repeat an id are rows like
others; where identical ones straddle the cutoff, as many as fit are drawn. Ids must be integers.
Empty tables give no rows, an empty target a constant pull. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from octaspark.llm.common import written

BUCKETS, RUNS = 10_000, 1
LEAST_WORDS, PER_CENT, SEED = 20, 10, 2024
#: Thresholds that one counting job compares with.
WAYS = 16
#: Texts are cut into words in blocks of about so many bytes.
BLOCK = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, block by block."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + BLOCK)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def bucket_blocks(text: str | None, buckets: int = BUCKETS, runs: int = RUNS) -> Iterator[tuple[int, np.ndarray]]:
    """Number of new words, and the buckets of the runs that end in them, block by block."""
    tail: list[bytes] = []
    for words in word_blocks(text):
        found = [np.fromiter(map(zlib.crc32, words), np.int64, len(words))]
        line = tail + words
        for k in range(2, runs + 1):
            first = max(0, len(tail) - k + 1)
            ends = [b" ".join(line[i : i + k]) for i in range(first, len(line) - k + 1)]
            found.append(np.fromiter(map(zlib.crc32, ends), np.int64, len(ends)))
        tail = line[len(line) - runs + 1 :] if runs > 1 else []
        yield len(words), np.concatenate(found) % buckets


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """How often each bucket occurs in all texts: summed by task, then over tasks; ``buckets`` rows reach the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                for _, at in bucket_blocks(t, buckets, runs):
                    total += np.bincount(at, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    counted = rows.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[counted["bucket"]] = counted["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus share of each bucket, floored; one is added to each count."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target)], np.int64)


def gumbel(seed: int, key: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text", runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight and score of every row."""
    buckets = len(gain)

    def run(batches):
        for b in batches:
            words, n, weight, score = [], [], [], []
            for key, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                count = features = total = 0
                for k, at in bucket_blocks(t, buckets, runs):
                    count, features, total = count + k, features + len(at), total + int(gain[at].sum())
                words.append(count)
                n.append(features)
                weight.append(total // features if features else 0)
                score.append(None if key is None else weight[-1] + gumbel(seed, key))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (words, n, weight, score))], [id_col, "n_words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(id_col).cast("string").alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long, score long")


def greatest_reaching(rows: DataFrame, value: Column, k: int, ways: int = WAYS) -> int:
    """The greatest v for which at least ``k`` rows have ``value`` >= v, by bisection: each job counts rows at ``ways`` thresholds."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        pivots = sorted({low - (low - high) * j // ways if j < ways else high for j in range(1, ways + 1)} - {low})
        counts = rows.agg(*[F.count_if(value >= F.lit(p)).alias(f"n{i}") for i, p in enumerate(pivots)]).first()
        enough = [p for p, n in zip(pivots, counts) if n >= k]
        short = [p for p, n in zip(pivots, counts) if n < k]
        low, high = max(enough, default=low), min(short, default=high + 1) - 1
    return low


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with their ``rank`` from 1 in ``order``: one range shuffle, written with each row's place, and one total per partition."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = written(dealt, "drawn")
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each partition
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", runs: int = RUNS, buckets: int = BUCKETS,
    per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """id, n_features, weight, score and rank (null if not drawn) of every row of ``docs``."""
    gain = gains(bucket_counts(docs, text, buckets, runs), bucket_counts(target, target_text, buckets, runs))
    scored = written(weigh(docs, gain, id_col, text, runs, seed), "scored")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    k = scored.where(able).count() * per_cent // 100
    out = [F.col(id_col), "n_features", "weight", "score"]
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    eligible = scored.where(able)
    cut = greatest_reaching(eligible, F.col("score"), k)
    above = eligible.where(F.col("score") > cut).count()
    last = -greatest_reaching(eligible.where(F.col("score") == cut), -F.col(id_col), k - above)
    drawn = F.coalesce(able & ((F.col("score") > cut) | (F.col("score") == cut) & (F.col(id_col) <= last)), F.lit(False))
    ranked = numbered(scored.where(drawn), F.desc("score"), F.col(id_col), F.col("n_features"))
    rest = scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, F.when(F.col("rank") <= k, F.col("rank")).cast("long").alias("rank")).unionByName(rest)
