import random

import numpy as np

from octaspark.llm import substring
from octaspark.llm.queries import QUERIES
from octaspark.llm.substring import REACH, SPAN_WORDS, Sentences
from tests.llm.conftest import ODD


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)).capitalize() + "."


def brute_spans(s):
    """Forward and backward runs by their definition, and where each sentence starts."""
    bound = [*s.first, len(s.hash)]
    m, out = len(s.first), set()
    for i in range(m):
        for j in range(i + 1, m):
            if bound[j + 1] - bound[i] >= SPAN_WORDS:
                out.add((i, j))
                break
        for j in range(i - 1, -1, -1):
            if bound[i + 1] - bound[j] >= SPAN_WORDS:
                out.add((j, i))
                break
    return out, bound


def runs_of(spans):
    """Maximal runs of covered sentences, each with the longest span at its start and at its end."""
    covered = {k for a, b in spans for k in range(a, b + 1)}
    for k in sorted(covered):
        if k - 1 not in covered:
            end = k
            while end + 1 in covered:
                end += 1
            yield max(x for x in spans if x[0] == k), max(x for x in spans if x[1] == end)


def alike(x, y):
    n = 0
    while n < min(len(x), len(y), REACH) and x[n] == y[n]:
        n += 1
    return n


def brute(rows):
    """Texts without the words of spans met before, in the order of ids, and of what continues them as where they were met first."""
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if not t:
            out[i] = t
            continue
        s = Sentences(t)
        w = s.hash.tolist()
        spans, bound = brute_spans(s) if len(s.first) else (set(), [])
        words = {(a, b): tuple(w[bound[a] : bound[b + 1]]) for a, b in spans}
        here = {}
        for x in sorted(spans):
            here.setdefault(words[x], (w, bound[x[0]], bound[x[1] + 1]))
        gone = np.zeros(len(w), bool)
        met = {x: first[words[x]] for x in spans if words[x] in first} if i is not None else {}
        again = {x: here[words[x]] for x in spans if here[words[x]][1] != bound[x[0]]}
        for known in (met, again):
            for x, y in runs_of(set(known)):
                (u, a, _), (v, _, b) = known[x], known[y]
                start, end = bound[x[0]], bound[y[1] + 1]
                gone[start - alike(w[:start][::-1], u[:a][::-1]) : end + alike(w[end:], v[b:])] = True
        if i is not None:
            for k, v in here.items():
                first.setdefault(k, v)
        out[i] = s.without(gone) if gone.any() else t
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    passages = [" ".join(sentence(rng, rng.randint(2, 20)) for _ in range(rng.randint(3, 9))) for _ in range(6)]
    passages += [sentence(rng, 70), " ".join(sentence(rng, 3) for _ in range(25))]
    rows = []
    for i in range(60):
        parts = [" ".join(sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 6))) for _ in range(2)]
        parts.insert(1, rng.choice(passages) if rng.random() < 0.5 else "")
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows.append((60, rows[5][1]))
    rows.append((61, passages[0] + " " + passages[0]))
    return rows, passages


def test_spans_follow_their_definition():
    for _, t in corpus()[0]:
        s = Sentences(t)
        first, last, _, _ = s.spans()
        assert set(zip(first.tolist(), last.tolist())) == brute_spans(s)[0]


def test_against_brute_force(make_docs, texts):
    rows = corpus()[0] + [(1000 + i, t) for i, t in texts.items()] + [(5000 + (i or 0) if i else None, t) for i, t in ODD]
    docs = make_docs(rows, extra=["h1", "_x"])
    got = substring.remove_repeats(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == brute(rows)


def test_short_repeated_sentences_go(make_docs):
    rng = random.Random(6)
    three = " ".join(sentence(rng, 7) for _ in range(3))
    tiny = "Yes indeed. So be it. Fine."
    rows = [(1, f"{sentence(rng, 9)} {three}"), (2, f"{three} {sentence(rng, 9)}"), (3, f"{tiny} {sentence(rng, 20)}"), (4, f"{sentence(rng, 20)} {tiny}")]
    got = {r.doc_id: r.text.strip() for r in substring.remove_repeats(make_docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1][len(three) + 1 :], 3: rows[2][1], 4: rows[3][1]}  # few words repeat by chance


def test_hot_spans_can_be_split(spark, make_docs, tmp_path):
    """Texts cross one exchange, which all joins read; the join by span has a plain shuffle on both sides, as AQE needs to split it."""
    rng = random.Random(4)
    hot = " ".join(sentence(rng, 8) for _ in range(4))
    tail = sentence(rng, 4).lower()  # of the sentence before, which differs in its beginning
    make_docs([(k, f"{sentence(rng, 5)[:-1]} {tail} {hot} {sentence(rng, 9)}") for k in range(50)]).write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = substring.remove_repeats(spark.read.parquet(f"{tmp_path}/docs"))
        rows = got.collect()
        assert sum(r.text.count(hot) for r in rows) == sum(r.text.count(tail) for r in rows) == 1
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan[: plan.index("== Initial Plan ==")]
    assert final.count("docs") == 1 and final.count("ReusedExchange") >= 2
    by_span = final[final.index("SortMergeJoin [h#") :]
    assert "Aggregate" not in by_span


def test_long_passages_go_everywhere_but_once(make_docs):
    rng = random.Random(8)
    passage = " ".join(sentence(rng, rng.randint(4, 12)) for _ in range(9))
    rows = [(i, f"{sentence(rng, 15)} {passage} {sentence(rng, 11)}") for i in range(5)]
    got = {r.doc_id: r for r in substring.remove_repeats(make_docs(rows), counts=True).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    for i in range(1, 5):
        assert not any(w in got[i].text.split() for w in passage.split())
        assert len(got[i].text.split()) == 26 and got[i].words_removed == len(passage.split())


def test_repeated_rows_and_none(make_docs):
    rng = random.Random(2)
    t = " ".join(sentence(rng, 10) for _ in range(6))
    rows = [(1, t), (1, t), (None, t), (None, t)]
    got = sorted((str(r.doc_id), r.text.strip()) for r in substring.remove_repeats(make_docs(rows)).collect())
    assert got == [("1", t), ("1", t), ("None", t), ("None", t)]
    assert substring.remove_repeats(make_docs(rows).limit(0)).count() == 0


def test_passages_that_start_within_sentences_go_whole(spark, make_docs, tmp_path):
    rng = random.Random(11)
    words, rows, want = lambda n: [w for _ in range(n) for w in sentence(rng, 9).split()], [], {}
    for k in range(120):
        n, at = rng.randint(51, 60), rng.randrange(9)
        passage = words(8)[at : at + n]
        for i in (k, k + 200):
            before, after = words(6)[: rng.randint(20, 50)], words(6)[rng.randrange(1, 9) :]
            rows.append((i, " ".join(before + passage + after)))
            want[i] = " ".join(before + after) if i >= 200 else rows[-1][1]
    t = sentence(rng, 60)
    rows += [(500, t), (500, t), (None, f"{t} {t}"), (501, None), (502, "")] + [(600 + (i or 0), x) for i, x in ODD]
    want |= {500: t, None: f"{t} ", 501: None, 502: ""}
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op2_substring_dedup"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    left = {r.doc_id: r.text for r in got}
    assert {i: left[i] for i in want} == want
    assert all(r.words_removed == len(dict(rows)[r.doc_id].split()) - len(r.text.split()) for r in got if r.text and r.doc_id and 200 <= r.doc_id < 500)
