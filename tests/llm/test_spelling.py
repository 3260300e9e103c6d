import random
import re
import zlib
from collections import Counter

from octaspark.llm import spelling
from tests.llm.conftest import ODD

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    """Sorted rows of (word, form, root, n, n_near, form_n)."""
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = sorted(w for w, k in n.items() if len(w) >= 5 and k >= 3)
    form, count = {}, {}
    for w in words:
        around = [u for u in words if abs(len(u) - len(w)) < 2 and near(w, u)]
        best = min(around, key=lambda u: (-n[u], u), default=None)
        count[w], form[w] = len(around), best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in words), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_against_brute_force(spark, sf, texts):
    assert rows_of(spelling.variants(spark.read.parquet(f"{sf}/documents.parquet"))) == brute(texts.items())


def test_edits_of_every_kind_and_chains(spark, make_docs):
    """All edits at all places of words with runs of equal letters, through the trie and beyond its depth."""
    rng = random.Random(5)
    words = set()
    for base in ("abcde", "aabbcc", "éàñöü", "lllllll", "x" * 11, "mississippi", "abcabcabcabcabcabcabcabc"):
        words.add(base)
        for _ in range(40):
            k, c = rng.randrange(len(base)), rng.choice("abclxéü")
            words |= {base[:k] + c + base[k + 1 :], base[:k] + base[k + 1 :], base[:k] + c + base[k:]}
    rows = [(None, " ".join([w] * rng.choice((3, 4, 7, 15, 40, 90)))) for w in sorted(words)]
    want = brute(rows)
    assert rows_of(spelling.variants(make_docs(rows))) == want
    for levels in (5, 8):  # most words are settled beyond the trie
        assert rows_of(spelling.variants(make_docs(rows), levels=levels)) == want
    assert any(form and root != form for _, form, root, *_ in want)


def test_odd_rows(spark, make_docs):
    rows = [*ODD, (20, "x" * 60_000 + "y"), (21, "x" * 60_000 + "y"), (22, "x" * 60_000 + "y"), (9, "x" * 60_000), (9, "x" * 60_000), (None, None), *[(k, "naïve Naïve naive naive") for k in range(30)]]
    assert rows_of(spelling.variants(make_docs(rows, extra=["word", "n", "root", "pos"]))) == brute(rows)
    assert spelling.variants(make_docs(rows).limit(0)).count() == 0


def test_hot_prefix(spark, make_docs):
    """A third of all words and of all occurrences under one prefix."""
    rng = random.Random(9)
    words = ["prefix" + "".join(rng.choices("abcd", k=4)) for _ in range(150)] + ["".join(rng.choices("abcdefgh", k=7)) for _ in range(300)]
    rows = [(k, " ".join(rng.choices(words, k=60)) + " prefixaaaa" * 30) for k in range(60)]
    assert rows_of(spelling.variants(make_docs(rows))) == brute(rows)
