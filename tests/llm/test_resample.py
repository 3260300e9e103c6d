import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from octaspark.llm import resample
from tests.llm.conftest import ODD

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, runs=1):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, runs=1, per_cent=10, least=20):
    """Sorted rows of (id, n_features, weight, score, rank)."""
    s, t = (Counter(b for x in texts for b in features(x, runs)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out, able = [], []
    for i, x in docs:
        w, f = features(x, runs)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in f]
        weight, score = math.floor(sum(gain) / len(f)) if f else 0, None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(w) >= least:
                able.append((-score, i, len(f), len(out)))
        out.append([i, len(f), weight, score, None])
    for rank, (*_, k) in enumerate(sorted(able)[: len(able) * per_cent // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("runs", [1, 2])
def test_against_brute_force(spark, sf, make_docs, texts, runs):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = resample.resample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), runs=runs)
    assert rows_of(got) == brute(list(texts.items()), items, runs)


def test_odd_rows_ties_and_repeated_rows(spark, make_docs):
    """Nulls, empty and long texts, rows that repeat an id across the cutoff, clashing extra columns."""
    many = " ".join(f"word{k}" for k in range(30))
    rows = [*ODD, *[(50, many)] * 7, *[(60 + k, many) for k in range(8)], (None, many)]
    target = [(1, many), (2, None), (3, "")]
    benchmark = spark.createDataFrame(target, "item_id long, text string")
    for per_cent in (0, 10, 35, 50, 100):
        got = resample.resample(make_docs(rows, extra=["rank", "_part", "score", "weight"]), benchmark, per_cent=per_cent)
        assert rows_of(got) == brute(rows, [t for _, t in target], per_cent=per_cent)


def test_empty_tables(spark, make_docs):
    none = make_docs([(1, "x")]).limit(0)
    some = make_docs([(k, f"word{k} " * 25) for k in range(20)])
    assert resample.resample(none, some).count() == 0
    assert rows_of(resample.resample(some, none)) == brute([(k, f"word{k} " * 25) for k in range(20)], [])


def test_blocks_do_not_change_words(monkeypatch):
    text = "Eins zwei, DREI! vier5 fünf " * 50
    whole = [w for b in resample.word_blocks(text) for w in b]
    pairs = sorted(x for _, at in resample.bucket_blocks(text, runs=3) for x in at.tolist())
    monkeypatch.setattr(resample, "BLOCK", 7)
    assert [w for b in resample.word_blocks(text) for w in b] == whole
    assert sorted(x for _, at in resample.bucket_blocks(text, runs=3) for x in at.tolist()) == pairs == sorted(features(text, 3)[1])


def test_bisection_counts_exactly(spark):
    from pyspark.sql import functions as F

    values = [-7, -7, -3, 0, 0, 0, 5, 2**40, 2**40]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, len(values) + 1):
        for ways in (2, 16):
            assert resample.greatest_reaching(df, F.col("v"), k, ways) == sorted(values, reverse=True)[k - 1]
