"""Operator 8 against a brute-force version over all pairs."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from octaspark.llm import minhash
from octaspark.llm.components import connected
from octaspark.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """id -> (set size, least id reachable) for distinct non-null ids."""
    sets = {i: brute_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if not small or 100 * small < 85 * large:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= 85 * (small + large - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def planted(seed=4, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, i = [], 0
    for _ in range(n):
        base = [word() for _ in range(rng.choice((3, 6, 40, 120, 300)))]
        for _ in range(rng.choice((1, 1, 2, 5, 12))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy)))
            i += 7
    rng.shuffle(rows)
    return rows


def crowded_and_chained():
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(100_000 + k, " ".join(base[: 197 - k % 3] + [f"t{k}"])) for k in range(120)]  # one crowded region
    chain = [f"c{k}" for k in range(160)]
    return rows + [(200_000 + k, " ".join(chain[k * 6 : k * 6 + 90])) for k in range(12)]  # neighbours are alike, ends aren't


def test_near_duplicates_against_brute_force(make_docs, texts):
    rows = planted() + crowded_and_chained() + [(10**6 + i, t) for i, t in texts.items()]
    odd = [(2 * 10**6 + i if i is not None else None, t) for i, t in ODD]
    found = minhash.near_duplicates(make_docs(rows + odd, extra=["key", "kept"])).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert got.pop(None) == (1, None)
    assert got == brute(rows + [r for r in odd if r[0] is not None])
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)


def test_query_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(ORACLE["op8_minhash_forest"]).df().sort_values("doc_id").reset_index(drop=True)
    got = QUERIES["op8_minhash_forest"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
    assert set(got.columns) == set(want.columns) and not got.kept.all()


def test_no_rows(make_docs):
    assert minhash.drop_copies(make_docs(ODD).limit(0)).count() == 0


def test_drop_copies_keeps_one_row(make_docs):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (3, "A b c d e f g"), (8, "other words stand here now ok"), (9, None), (9, None), (None, "x y z")]
    left = minhash.drop_copies(make_docs(rows, extra=["key"]))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(3, "A b c d e f g"), (8, rows[3][1]), (9, None), (None, "x y z")], key=str)
    assert left.columns[-1] == "key"


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_border_rows_meet(spark, partitions):
    """Neighbours are found wherever the range partitioning cuts, also across partitions of a single row."""
    rng = np.random.default_rng(1)
    s = [np.sort(rng.integers(1, 2**63, 60, dtype=np.uint64)) for _ in range(30)]
    rows = []
    for k, x in enumerate(s):
        for j in range(2):
            y = np.concatenate([x[:58], rng.integers(1, 2**63, 2, dtype=np.uint64)]) if j else x
            sig, bits = minhash.signature(y)
            rows.append((2 * k + j, bytearray(sig), bytearray(bits)))
    classes = spark.createDataFrame(rows, "node long, signature binary, bits binary")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {tuple(sorted((r.node, r.root))) for r in minhash.candidates(classes).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(2 * k, 2 * k + 1) for k in range(30)} <= got


def region(seed, n, like, planted, words=300):
    """``n`` texts that are about ``like`` alike pairwise, some with a partner that is more alike."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    # One changed word changes 5 shingles; two texts with e edits each share 1 - 10 e / words of them.
    edits = round((1 - 2 * like / (1 + like)) * words / 10)
    rows = []
    for i in range(n):
        t = list(base)
        for at in rng.sample(range(2, words - 2), edits):
            t[at] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(t)))
        if i % planted == 0:
            u = list(t)
            for at in rng.sample(range(2, words - 2), rng.randint(1, max(1, round(words / 75)))):
                u[at] = f"e{rng.randrange(10**9)}"
            rows.append((n + i, " ".join(u)))
    return rows


def exact_components(rows):
    """Component of every row, from all pairs' overlaps by a product of matrices over all shared shingles."""
    words = {}
    sets = [np.unique([words.setdefault(x, len(words)) for x in brute_set(t)]) for _, t in rows]
    count = np.bincount(np.concatenate(sets), minlength=len(words))
    place = np.cumsum(count > 1) - 1
    m = np.zeros((len(rows), int((count > 1).sum())), np.float32)
    for k, s in enumerate(sets):
        m[k, place[s[count[s] > 1]]] = 1
    size = np.array([len(s) for s in sets])
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for lo in range(0, len(rows), 500):
        common = m[lo : lo + 500] @ m.T
        i, j = np.nonzero(100 * common >= 85 * (size[lo : lo + 500, None] + size - common) - 1e-3)
        for a, b in zip(i + lo, j):
            if a < b:
                links += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}, links


@pytest.mark.parametrize("n, like", [(900, 0.80), (4200, 0.82)])
def test_crowded_regions(make_docs, n, like):
    """Pairs in a region of texts that are all nearly, but not quite, alike enough."""
    rows = region(n, n, like, 10)
    want, links = exact_components(rows)
    assert links >= n // 20
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(rows)).select("doc_id", "component_id").collect()}
    joined = [i for i in want if want[i] != i]
    assert sum(got[i] == want[i] for i in joined) >= 0.99 * len(joined)
    assert all(got[i] == i or want[i] != i for i in want)


def test_regions_within_a_region(spark, monkeypatch):
    """Runs that stay too large are settled again, the last ones block by block; all links are found."""
    monkeypatch.setattr(minhash, "RUN", 12)
    monkeypatch.setattr(minhash, "_FITS", "(rows <= 6 OR rows <= 12)")
    rng = np.random.default_rng(3)
    fresh = lambda k: rng.integers(1, 2**63, k, dtype=np.uint64)
    base, rows, sets = np.unique(fresh(200)), [], []
    for part in range(3):  # texts of a part share 60 more shingles
        own = np.concatenate([base, fresh(60)])
        for _ in range(40):
            kept = own[rng.random(len(own)) > 0.08]
            sets.append(np.unique(np.concatenate([kept, fresh(12)])))
            if rng.random() < 0.3:
                sets.append(np.unique(np.concatenate([sets[-1][:-3], fresh(3)])))
    leader = np.unique(base)
    for k, s in enumerate(sets):
        rows.append((0, k, len(s), bool(minhash.linked(len(s), len(leader), len(np.setxor1d(s, leader)))), bytearray(np.setxor1d(s, leader).tobytes())))
    found = minhash.settled(spark.createDataFrame(rows, "group long, node long, n long, ok boolean, apart binary")).collect()
    n = np.array([len(s) for s in sets])
    want = minhash.local_roots(len(sets), *np.array([(i, j) for i in range(len(sets)) for j in range(i) if minhash.linked(n[i], n[j], len(np.setxor1d(sets[i], sets[j])))]).T)
    edges = np.array([(r.a, r.b) for r in found]).reshape(-1, 2)
    got = minhash.local_roots(len(sets), edges[:, 0], edges[:, 1])
    assert (got == want).all() and len(set(want)) < len(sets)


def test_run_links_are_exact():
    rng = np.random.default_rng(8)
    pool = np.unique(rng.integers(1, 2**63, 400, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(1, 60), replace=False)) for _ in range(60)]
    sets += [np.sort(np.concatenate([s[1:], rng.integers(1, 2**63, 1, dtype=np.uint64)])) for s in sets[:20]]
    origin = pool[:100]
    n, ok = np.array([len(s) for s in sets]), np.arange(80) % 7 == 0
    pairs = [(i, j) for i in range(80) for j in range(i) if not (ok[i] and ok[j]) and minhash.linked(n[i], n[j], len(np.setxor1d(sets[i], sets[j])))]
    want = minhash.local_roots(80, *np.array(pairs).T)
    for block in (7, 256):
        assert (minhash.run_links(n, ok, [np.setxor1d(s, origin) for s in sets], block) == want).all()


def test_estimate_and_signature():
    rng = np.random.default_rng(2)
    a = rng.integers(1, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1800], rng.integers(1, 2**63, 200, dtype=np.uint64)])
    x, y = (np.frombuffer(minhash.signature(s)[1], np.uint8)[None] for s in (a, b))
    assert abs(minhash.estimate(x, y)[0] - 1800 / 2200) < 0.15
    p, q = (np.frombuffer(minhash.signature(s)[0], ">u2") for s in (a, b))
    assert abs((p == q).mean() - 1800 / 2200) < 0.15


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 600)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(x) for x in root if x not in alone}
    assert set(got) == set(want) and all(want[r] == want[x] for x, r in got.items())
    assert len(set(got.values())) == len(set(want.values()))
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
