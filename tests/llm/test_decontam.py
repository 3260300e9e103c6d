import random

from octaspark.llm import decontam
from octaspark.llm.decontam import template
from tests.llm.conftest import ODD

QUESTION = "Maria Lopez, a farmer called Anna and her friend carry 12 boxes of 3.5 kg to the market every morning. How many kg does Anna carry in 7 days if nobody helps?"


def test_templates():
    same = "Then we met Kim near 40 km from the large old mill", "Then we met Joanna Smith near 1,250 miles from the large old mill"
    (a, x), (b, y) = map(template, same)
    assert a.tolist() == b.tolist() and x.tolist() != y.tolist()
    assert len(template("...")[0]) == 0
    assert (template("The cat sat")[0] == template("the CAT? sat!".replace("CAT", "cat"))[0]).all()


def pairs(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, benchmark).collect()}


def test_verbatim_and_reparameterised(spark, make_docs):
    changed = QUESTION.replace("Anna", "Beth").replace("12", "31").replace("3.5", "4.25").replace("7", "9")
    torn = QUESTION.replace("farmer called Anna", "farmer called Beth")  # two values for what the item keeps alike
    rows = [
        (1, "Something before. " + QUESTION + " And after."),
        (2, changed),
        (3, "A farmer carries boxes to the market. How many?"),
        (4, " ".join(QUESTION.split()[:9])),
        (5, torn),
        *[(100 + (i or 0) if i else None, t) for i, t in ODD],
    ]
    items = [(7, QUESTION), (8, None), (9, "too short"), (7, "One two three four fine words stand here")]
    got = pairs(spark, make_docs(rows, extra=["h", "item"]), items)
    assert {k[0] for k in got} == {1, 2, 5}
    assert got[1, 7].coverage == 1 and got[1, 7].slots_changed == 0
    assert got[2, 7].coverage > 0.9 and got[2, 7].slots_changed >= 4
    assert got[5, 7].n_matched < got[1, 7].n_matched


def test_letters_of_any_length_and_script():
    """A letter whose lower case has another length changes nothing else; capitals of all scripts are names."""
    plain, odd = "Über Äpfel reden wir mit Émile gern im Sommer", "Über Äpfel reden wir mit Émile gern im \u0130zmir"
    assert template(plain)[0][:8].tolist() == template(odd)[0][:8].tolist() and template(plain)[1][:8].tolist() == template(odd)[1][:8].tolist()
    a, b = template("Мы видели как Анна шла домой"), template("Мы видели как Ольга шла домой")
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() != b[1].tolist()
    assert template("und Ökonomen")[0].tolist() == template("und Anna")[0].tolist()


def test_items_without_windows_match_verbatim(spark, make_docs):
    items = [(1, "Paris Lyon Nice"), (2, "3 4 5 6 7 8"), (3, "yes"), (4, "red blue"), (5, "?")]
    rows = [(1, "they saw paris lyon nice today"), (2, "so 3, 4, 5, 6, 7 and 8 then 3 4 5 6 7 8 it is"), (3, "yes"), (4, "yes it is red blue"), (5, "Red, blue!"), (6, "paris lyon"), (7, "3 4 5 6 7 9")]
    assert set(pairs(spark, make_docs(rows), items)) == {(1, 1), (2, 2), (3, 3), (5, 4)}


def test_an_earlier_chance_hit_binds_nothing(spark, make_docs):
    other = QUESTION.replace("Anna", "Beth").replace("12", "31").replace("3.5", "4.25").replace("7", "9").split()
    early = " ".join(other[:16])
    got = pairs(spark, make_docs([(1, f"{early} and more. {'filler words here ' * 20}. {QUESTION}")]), [(7, QUESTION)])
    assert got[1, 7].coverage == 1 and got[1, 7].slots_changed == 0


def test_very_long_text(spark, make_docs):
    got = pairs(spark, make_docs([(1, "some filler of words " * 50_000 + QUESTION), (2, "12 kg " * 50_000)]), [(7, QUESTION)])
    assert set(got) == {(1, 7)}


def plain_slots(matches):
    """The rule of ``slots_agree`` over all matches one by one."""

    def bound(some):
        there, back, met, changed = {}, {}, set(), set()
        for m in sorted(some, key=lambda m: (m["item_at"], m["at"])):
            pairs = [(x, y) for x, y in zip(m["item_values"], m["values"]) if x or y]
            if all(there.get(x, y) == y and back.get(y, x) == x for x, y in pairs):
                there.update(pairs)
                back.update((y, x) for x, y in pairs)
                met.add(m["item_at"])
                changed.update(x for x, y in pairs if x != y)
        return len(met), len(changed)

    groups, last = [], None
    for m in sorted(matches, key=lambda m: m["at"] - m["item_at"]):
        d = m["at"] - m["item_at"]
        if last is None or d - last > decontam.SHIFT:
            groups.append([])
        groups[-1].append(m)
        last = d
    found = [bound(g) for g in groups] + ([bound(matches)] if len(groups) > 1 else [])
    return max(found, key=lambda x: (x[0], -x[1]))


def one_by_one(shared):
    return [{**p, **w} for places, own in shared for p in places for w in own]


def test_slots_of_repeated_windows_equal_the_plain_rule():
    rng = random.Random(3)
    for _ in range(300):
        shared, seen = [], set()
        for _ in range(rng.randint(1, 5)):
            places = [{"at": a, "values": [rng.choice((0, 0, 7, 8)), rng.choice((0, 9))]} for a in sorted(rng.sample(range(60), rng.randint(1, 9)))]
            own = [{"item_at": a, "item_values": [rng.choice((0, 5)), rng.choice((0, 6))]} for a in rng.sample([x for x in range(30) if x not in seen], rng.randint(1, 4))]
            seen |= {w["item_at"] for w in own}
            shared.append((places, own))
        assert decontam.slots_agree(shared) == plain_slots(one_by_one(shared))


def test_repeated_windows_stay_small(spark, make_docs):
    """A window that a document repeats 100,000 times and an item 1,000 times: nothing holds the product of the two."""
    import tracemalloc

    places, own = [{"at": a, "values": [0] * 8} for a in range(100_000)], [{"item_at": a, "item_values": [0] * 8} for a in range(993)]
    tracemalloc.start()
    assert decontam.slots_agree([(places, own)]) == (993, 0)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    got = pairs(spark, make_docs([(1, "again " * 100_000), (2, "again and again")]), [(7, "again " * 1000), (8, "no " * 50)])
    assert {k: (r.n_matched, r.n_windows) for k, r in got.items()} == {(1, 7): (993, 993)}


def brute_pairs(rows, items):
    """Items whose windows of template words occur often enough, looked for one by one."""
    out = set()
    for i, t in rows:
        words, value = (x.tolist() for x in template(t))
        for j, u in items:
            w, v = (x.tolist() for x in template(u))
            n = min(decontam.WINDOW, len(w))
            at = [k for k in range(len(w) - n + 1) if sum(x == 0 for x in v[k : k + n]) >= min(decontam.LEAST_LITERALS, n - 1)]
            there = [{"item_at": k, "at": p, "item_values": v[k : k + n], "values": value[p : p + n]} for k in at for p in range(len(words) - n + 1) if words[p : p + n] == w[k : k + n]]
            if there and plain_slots(there)[0] >= min(decontam.COVER * len(at), decontam.MANY):
                out.add((i, j))
    return out


def test_against_brute_force(spark, make_docs, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text[:4000]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()]
    docs += [(10_000 + k, " ".join(t.split()[3:])) for k, (_, t) in enumerate(items)]
    assert set(pairs(spark, make_docs(docs), items)) == brute_pairs(docs, items)


def test_slots_must_agree():
    def m(at, item, doc):
        return [{"at": at, "values": doc}], [{"item_at": at, "item_values": item}]

    assert decontam.slots_agree([m(0, [5, 0], [8, 0]), m(1, [0, 5], [0, 8])]) == (2, 1)
    assert decontam.slots_agree([m(0, [5, 0], [8, 0]), m(1, [0, 5], [0, 9])]) == (1, 1)
    assert decontam.slots_agree([m(0, [5, 0], [8, 0]), m(1, [6, 0], [8, 0])]) == (1, 1)


def test_shuffled_join_finds_the_same(spark, make_docs, sf, monkeypatch):
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()}
    there = {(d.doc_id, b.item_id) for d in docs.collect() for b in benchmark.collect() if b.text in d.text}
    assert there <= want and len(want) <= len(there) + 2
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()} == want


def test_dropping(spark, make_docs):
    docs = make_docs([(1, QUESTION), (2, "clean words"), (None, QUESTION), (3, None)], extra=["item_id"])
    benchmark = spark.createDataFrame([(7, QUESTION)], "item_id long, text string")
    left = decontam.drop_contaminated(docs, benchmark)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "None"] and left.columns == docs.columns
    assert decontam.drop_contaminated(docs, benchmark.limit(0)).count() == 4
    assert decontam.contaminated(docs.limit(0), benchmark).count() == 0
