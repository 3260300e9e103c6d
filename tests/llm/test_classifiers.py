"""Operators 5, 7 and 9: held-out accuracy, and what must not matter."""

import math
import random
import zlib

import numpy as np
import pytest

from octaspark.llm import langid, queries, quality, toxicity
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def auc(pos, neg):
    neg = np.sort(neg)
    return (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2 / len(pos) / len(neg)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").toPandas()


def held(scores, labels, modulus=3):
    assert (scores.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in scores.doc_id]).all()
    got = labels.merge(scores, on="doc_id")
    return got[got.held_out]


def test_toxicity_held_out(spark, labels):
    got = held(queries.op5_toxicity(spark, SF).toPandas(), labels)
    assert auc(got.score[got.toxic == 1], got.score[got.toxic == 0]) > 0.9
    assert got.toxic[got.predicted == 1].mean() > 0.9 and got.predicted[got.toxic == 1].mean() > 0.75


def test_quality_held_out(spark, labels):
    got = held(queries.op9_quality(spark, SF).toPandas(), labels)
    assert auc(got.score[got.quality == 1], got.score[got.quality == 0]) > 0.9
    assert (got.predicted == got.quality).mean() > 0.93


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    got = queries.op7_language_id(spark, SF).toPandas().merge(docs, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.98
    assert got.score.between(0, 1).all()


def test_grammar_reads_clauses():
    lexicon = toxicity.Lexicon({"idiot": 1.0, "scum*": 1.0})
    m = lambda t: dict(lexicon.matches(t)[0])
    assert m("what an idiot") == {"insult": 1}
    assert m("you are such an idiot") == m("idiot, that is what you are") == {"targeted": 1}
    assert m("that is not an idiot. idiot") == m("it isn't the idiot; such an idiot") == {"negated": 1, "insult": 1}
    assert m("the paper wrote that some are scummy idiot fellows") == {"reported": 1}
    assert m("an idiot and another idiot") == {"insult": 1}  # a clause counts once
    assert m("we will hurt you") == m("I will kill you all") == m("I'll end you") == m("I hope you die") == m("go kill yourself") == m("ich werde dich töten") == {"threat": 1}
    assert m("they will beat them 3-0") == m("I will kill time with you") == m("the punch you made tastes good") == m("the plants die, I hope you water them") == {}
    assert m("we do kill weeds in gardens") == m("you kill time") == {}
    assert m("I will not hurt you") == {"negated": 1} and m("she said I will hurt you") == {"reported": 1}
    assert m("he said so; scumbag") == {"insult": 1}
    assert m("nothing here") == {} and m(None) == {} and m("") == {}


def follow(out, steps, rewritten, to, intent=None):
    """Marks ``rewritten`` where the steps came before it, each within its number of symbols of the one before."""
    met, left = 0, 0
    for i, x in enumerate(out):
        if met == len(steps) and x == rewritten:
            out[i], met, left = to, 0, 0
            continue
        new = 2 if intent and x == toxicity.INTENT else max((j + 1 for j, (kind, _) in enumerate(steps) if x == kind and j <= met), default=0)
        if new:
            met, left = new, steps[new - 1][1]
        else:
            left -= 1
            met = met if left > 0 else 0


def clause_by_rule(kinds):
    """What the machines say, from the definition: every match looks at the symbols around it."""
    t = toxicity
    near = lambda i, kind, step, reach: any(0 <= i + step * d < len(kinds) and kinds[i + step * d] == kind for d in range(1, reach + 1))
    out = list(kinds)
    for i, k in enumerate(kinds):
        if k in (t.INSULT, t.HARM, t.DEATH):
            if near(i, t.REPORT, -1, t.REPORT_REACH):
                out[i] = "reported"
            elif near(i, t.NEGATION, -1, t.NEGATION_REACH):
                out[i] = "negated"
            elif k == t.INSULT and (near(i, t.TARGET, -1, t.TARGET_REACH) or near(i, t.TARGET, 1, t.TARGET_REACH) or near(i, t.REFLEXIVE, 1, t.TARGET_REACH)):
                out[i] = "targeted"
    follow(out, [(t.SELF, t.MODAL_REACH), (t.MODAL, t.VERB_REACH)], t.HARM, "meant", True)
    follow(out, [(t.WISH, t.WISH_REACH), (t.TARGET, t.WISH_REACH)], t.DEATH, "wished")
    follow(out, [(t.SELF, t.MODAL_REACH), (t.MODAL, t.VERB_REACH), (t.TARGET, 1)], "meant", "wished", True)
    for i, k in enumerate(out):
        if k == "meant" and near(i, t.TARGET, 1, 1) or k in ("meant", t.HARM) and near(i, t.REFLEXIVE, 1, 1) or k == "wished":
            out[i] = "threat"
    return out


def test_grammar_against_its_definition():
    rng = np.random.default_rng(5)
    symbols = [s for s in toxicity.SYMBOLS if s != toxicity.END]
    met = set()
    for _ in range(6000):
        kinds = rng.choice(symbols, rng.integers(1, 20), p=[0.28, *[0.72 / 11] * 11]).tolist()
        got = toxicity.read(kinds)
        assert got == clause_by_rule(kinds)
        met.update(got)
    assert {"targeted", "negated", "reported", "meant", "threat"} <= met


def test_patterns_never_outweigh_the_direct_one(spark):
    """A target never lowers a score; negated and reported clauses never raise one, also as learned from the tables."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(toxicity.training_rows(docs, labels, "toxic"))
    lexicon, s = toxicity.Lexicon(model.insults), {}
    for t in ("a plain text", "what an idiot", "you are an idiot", "you are not an idiot", "he said you are an idiot", "I will kill you", "we kill weeds"):
        s[t] = model.score(lexicon.matches(t)[1])
    assert (model.weights >= 0).all()
    assert s["you are an idiot"] >= s["what an idiot"] > 0.7 and s["I will kill you"] > s["a plain text"]
    assert s["you are not an idiot"] == s["he said you are an idiot"] == s["we kill weeds"] == s["a plain text"] < 0.5


def test_odd_rows(spark, make_docs):
    docs = make_docs(ODD, extra=["score", "label", "lang_pred"])
    labels = spark.createDataFrame([(1, None, 1), (11, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for part in (docs, docs.limit(0)):
        n = part.count()
        model = toxicity.train(toxicity.training_rows(part, labels, "toxic"))
        rows = toxicity.score(part, model).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
        rows = quality.score(part, quality.train(part, labels)).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        rows = langid.identify(part, langid.train_on_folds(part)).collect()
        assert len(rows) == n
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and got[5].lang_pred == "en"
    kept = langid.keep_identified(docs, langid.train(docs))
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 4


def test_codewords_differ():
    for k in range(2, 41):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code}) == k
        assert all(len(set(c)) == 2 for c in code.T)
        assert len({tuple(c * c[0]) for c in code.T}) == code.shape[1]  # no bit asks what another asks


@pytest.mark.parametrize("k", [1, 2, 7, 8, 12])
def test_languages_of_any_number(make_docs, k):
    """Each language has its own letters; codewords are decoded as by comparing with every one of them."""
    rng = np.random.default_rng(k)
    word = lambda g: "".join(chr(97 + (2 * g + c) % 26) for c in rng.integers(0, 4, 6))
    docs = make_docs([(i, " ".join(word(i % k) for _ in range(40)), f"l{i % k}") for i in range(20 * k)])
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert all(r.lang_pred == f"l{r.doc_id % k}" for r in got)
    if k > 1:
        for r in docs.limit(20).collect():
            n = langid.ngram_counts(r.text)
            margins = [langid.SHARPNESS * float(n @ model.weights[:, b]) / n.sum() for b in range(model.code.shape[1])]
            loss = [sum(t * np.log1p(np.exp(-c * m)) for t, c, m in zip(model.trust, word, margins)) for word in model.code]
            assert model.predict(r.text)[0] == model.languages[int(np.argmin(loss))]


def test_texts_without_letters():
    model = langid.LanguageModel(["en"], langid.codewords(1), np.zeros((langid.BUCKETS, 0)), np.ones(0))
    assert [model.predict(t)[0] for t in ("\u00bd \u00b2 \u2167", "12 _", "\u00aa", "\u0905", "a")] == ["und", "und", "en", "en", "en"]


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(0)
    bags, y = [], []
    for k in range(300):
        x = rng.normal(0, 0.3, (rng.integers(2, 12), quality.FEATURES)).astype(np.float32)
        if k % 2:
            x[rng.integers(len(x)), 3] += 3
        bags.append(x)
        y.append(k % 2)
    model = quality.fit(bags, np.array(y, float))
    scores = np.array([model.attention(b)[1] for b in bags])
    assert ((scores > 0.5) == np.array(y)).mean() > 0.95
    assert np.mean([model.attention(b)[0].argmax() == b[:, 3].argmax() for b in bags[1::2]]) > 0.9


def test_quality_scores_against_plain_loops(spark, labels):
    """Passages by hand, attention by loops, for every document; the query gives the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for r in docs.limit(150).collect():
        x = [[(v - m) / s for v, m, s in zip(row, model.mean, model.scale)] for row in quality.encode(r.text).astype(float).tolist()]
        e = []
        for row in x:
            gate = 0.0
            for k in range(quality.HIDDEN):
                v, u = sum(a * b for a, b in zip(row, model.v[:, k])), sum(a * b for a, b in zip(row, model.u[:, k]))
                gate += math.tanh(v) / (1 + math.exp(-u)) * model.w[k]
            e.append(math.exp(gate))
        z = [sum(w * row[f] for w, row in zip(e, x)) / sum(e) for f in range(quality.FEATURES)]
        want = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(z, model.c)) + model.bias))))
        assert abs(got[r.doc_id].score - want) < 1e-6 and got[r.doc_id].n_passages == len(e)
        assert e[got[r.doc_id].top_passage] == pytest.approx(max(e))


def test_features_of_a_passage_by_hand():
    x = quality.encode("Big big cat! 42 dogs|ran\nfast")[0]
    raw = "Big big cat! 42 dogs|ran\nfast"
    shares = [sum(c.isupper() for c in raw), sum(c.islower() for c in raw), 2, 0, 0, 1, 1, 0, 1, 0]
    assert np.allclose(x[:10], np.array(shares) / len(raw))
    sizes = np.array([3, 3, 4, 2, 8, 4])
    assert np.allclose(x[10:], [5 / 6, 1 / 6, sizes.mean() / 10, sizes.std() / 10, 1 / 6, 1 / 6, 5 / 6])


def test_passages_cover_the_text():
    words = [f"w{k}" for k in range(500)]
    assert len(quality.encode(" ".join(words))) == 8
    assert len(quality.encode(" ".join(words[:64 + 20]))) == 1 and len(quality.encode(None)) == 1


def test_many_values_in_the_language_column(spark, make_docs, monkeypatch):
    """A dirty column: every value is learned, however few languages a task holds; the model equals one fitted in one piece."""
    rng = random.Random(4)
    values = [f"l{k}" for k in range(300)]
    rows = [(k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[(k % 300) % 20 :][:6], k=6)) for _ in range(12)), values[k % 300]) for k in range(900)]
    docs = make_docs(rows).repartition(3)
    want = langid.train(docs)
    assert want.languages == sorted(values)
    monkeypatch.setattr(langid, "HELD", 5)
    got = langid.train(docs)
    np.testing.assert_allclose(got.weights, want.weights, rtol=1e-4, atol=1e-6)
    counts = np.zeros((300, langid.BUCKETS))
    for _, t, g in rows:
        counts[got.languages.index(g)] += langid.ngram_counts(t)
    p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * langid.BUCKETS)
    for b in range(0, got.code.shape[1], 9):
        yes, no = p[got.code[:, b] == 1].mean(0), p[got.code[:, b] == -1].mean(0)
        np.testing.assert_allclose(got.weights[:, b], np.log(yes / no), rtol=1e-3, atol=1e-5)


def test_training_takes_a_bounded_number_of_passages():
    x = np.arange(1000.0)[:, None]
    some = quality.spread(x, 256)
    assert len(some) == 256 and some[0] == 0 and some[-1] == 999 and (np.diff(some[:, 0]) <= 4).all()
    assert len(quality.spread(x[:200], 256)) == 200
