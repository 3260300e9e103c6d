"""Operator 5: toxicity by a weighted finite-state grammar over clauses.

Words map to classes: insult, harm (a verb), target, self, modal, intent (both in one word), wish, death, reflexive, negation,
reporting verb, clause end and other. Small transducers rewrite the class string of a clause: one marks what follows a
reporting verb, one what follows a negation closely, one insults with a target before them, one harm that a self means to
do (self, then modal, then harm), one a death wished to a target. They are composed once into a single machine. A
second one reads what that gives from the end: it marks insults with a target after them, meant harm whose very next
word is its target, and harm told to be done to oneself. Harm alone, or to anything else, comes to nothing. Together
they run over each clause that holds an insult, harm or death. A clause's weight for a pattern is that of its path,
the sum over the arcs that matched; what is scored are clauses, not words.

A text's score is a logistic function of its clauses that insult, those of them that
have a target, and those that threaten one. None of these weights is below zero, and each
is drawn towards a prior one, so a target never lowers a score; negated and reported
clauses are told but have no weight, so they never raise one.

What counts as an insult is learned: words, and word beginnings, that documents
labelled toxic hold far more often than others. That, and the weights, come from at most
``SAMPLE`` labelled rows of each class, chosen by a hash of the id and written once; their words are
counted in Spark. Seed words are added for the other classes. Insults without a target count, as the labels hold many.

Defined results: null and empty texts score like any text without a match. Equal texts
have equal scores. With no training rows of both classes the seed lexicon and fixed
weights are used. Rows with a null id are not used for training. Of labels that repeat an
id, the greatest counts. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octaspark.llm.common import fold, written

#: Labelled rows of each class that training uses at most.
SAMPLE = 5000
#: An insult is in at least so many toxic rows and this share of them (rarer words look toxic by
#: chance), and its log odds are at least this.
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS = 5, 0.01, 3.0
MOST_ENTRIES = 2000
#: The share of toxic texts that scores assume, whatever the sample's.
PRIOR = 0.25
STEMS = range(3, 9)
OTHER, INSULT, HARM, TARGET, NEGATION, REPORT, END, SELF, MODAL, INTENT, WISH, DEATH, REFLEXIVE = range(13)

# Seed words by class.
SEEDS = {
    HARM: "kill murder hurt destroy beat shoot stab burn strangle choke punch smash slap lynch poison attack end bury töten umbringen schlagen erschießen verletzen vernichten "
    "tuer frapper égorger étrangler brûler détruire matar golpear degollar quemar destruir matarte matarlo matarla matarlos tuerai",
    TARGET: "you u ya your he she they them him her his their people everyone women men family du dich dir euch ihr ihn sie er leute tu te toi vous ils elle elles lui leur gens tú usted ustedes "
    "ellos ella ellas gente",
    REFLEXIVE: "yourself yourselves dich-selbst toi-même ti-mismo",
    NEGATION: "not no never without cannot nicht kein keine keiner nie niemals ohne ne pas jamais sans nunca sin ni",
    REPORT: "said says say wrote writes claimed claims called calls quoted told sagte schrieb behauptete nannte disait dit écrit traité dijo dice escribió llamó",
    SELF: "i we ich wir je nous yo nosotros",
    MODAL: "will shall would going want wanna werde werden würde wollen will vais allons veux voulons voy vamos quiero queremos",
    INTENT: "i'll we'll i’ll we’ll gonna imma voy-a",
    WISH: "hope wish pray hoffe hoffentlich wünsche espère souhaite espero ojalá deseo",
    DEATH: "die dies dead perish rot suffer stirbst sterbt stirb verreckst crève crèves meurs mueras muera mueran muere",
}
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n]")
PATTERNS = ("insult", "targeted", "negated", "reported", "threat")
#: How far after a reporting verb and a negation, and from its target, a match may be, in words.
REPORT_REACH, NEGATION_REACH, TARGET_REACH, OBJECT_REACH = 12, 3, 6, 1
#: How many words may stand between a self and its modal, a modal and its verb, and the parts of a wish.
MODAL_REACH, VERB_REACH, WISH_REACH = 2, 3, 3


@dataclass
class Transducer:
    """A deterministic one: (state, input) to (state, output); what isn't listed keeps both."""

    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, symbols) -> Transducer:
    """The machine that feeds ``first``'s output to ``second``; start state (0, 0)."""
    arcs, todo, met = {}, [(0, 0)], {(0, 0)}
    outputs = set(symbols)
    while todo:
        a, b = todo.pop()
        for x in outputs:
            a2, y = first.step(a, x)
            b2, z = second.step(b, y)
            arcs[(a, b), x] = ((a2, b2), z)
            if (a2, b2) not in met:
                met.add((a2, b2))
                todo.append((a2, b2))
    names = {s: k for k, s in enumerate(sorted(met, key=lambda s: s != (0, 0)))}
    return Transducer({(names[s], x): (names[t], z) for (s, x), (t, z) in arcs.items()})


SYMBOLS = tuple(range(13))
MARKS = ("targeted", "negated", "reported", "meant", "wished")


def _window(trigger, reach: dict) -> Transducer:
    """After ``trigger``, a symbol of ``reach`` within its number of symbols is rewritten; a clause end stops that."""
    arcs, length = {}, max(n for n, _ in reach.values())
    for s in range(length + 1):
        for x in (*SYMBOLS, *MARKS):
            n, to = reach.get(x, (0, x))
            arcs[s, x] = (max(0, s - 1), to if s > length - n else x)
        arcs[s, trigger] = (length, trigger)
        arcs[s, END] = (0, END)
    return Transducer(arcs)


def _chain(steps: list[tuple[tuple, int]], rewritten, to, skip: dict | None = None) -> Transducer:
    """Marks ``rewritten`` as ``to`` after the symbols of ``steps``, each within a number of symbols of the one before.

    A state is how many steps were met and how many symbols may still pass. ``skip`` has symbols that stand for several steps.
    """
    arcs = {}
    states = [(0, 0), *((k + 1, left) for k, (_, n) in enumerate(steps) for left in range(1, n + 1))]
    for k, left in states:
        for x in (*SYMBOLS, *MARKS):
            met = (skip or {}).get(x) or next((j + 1 for j in range(min(k, len(steps) - 1), -1, -1) if x in steps[j][0]), None)
            if x == END:
                arcs[(k, left), x] = ((0, 0), x)
            elif k == len(steps) and x == rewritten:
                arcs[(k, left), x] = ((0, 0), to)
            elif met is not None:
                arcs[(k, left), x] = ((met, steps[met - 1][1]), x)
            else:
                arcs[(k, left), x] = ((k, left - 1) if left > 1 else (0, 0), x)
    names = {s: i for i, s in enumerate(states)}
    return Transducer({(names[s], x): (names[t], y) for (s, x), (t, y) in arcs.items()})


def grammar() -> tuple[Transducer, Transducer]:
    """The machine that reads a clause, and the one that reads what it gives from the end."""
    hostile = (INSULT, HARM, DEATH)
    reported = _window(REPORT, {x: (REPORT_REACH, "reported") for x in hostile})
    negated = _window(NEGATION, {x: (NEGATION_REACH, "negated") for x in hostile})
    before = _window(TARGET, {INSULT: (TARGET_REACH, "targeted")})
    meant = _chain([((SELF,), MODAL_REACH), ((MODAL,), VERB_REACH)], HARM, "meant", {INTENT: 2})
    wished = _chain([((WISH,), WISH_REACH), ((TARGET,), WISH_REACH)], DEATH, "wished")
    last = _chain([((SELF,), MODAL_REACH), ((MODAL,), VERB_REACH), ((TARGET,), OBJECT_REACH)], "meant", "wished", {INTENT: 2})  # the target comes before the verb
    after = _window(TARGET, {INSULT: (TARGET_REACH, "targeted"), "meant": (OBJECT_REACH, "threat")})
    told = _window(REFLEXIVE, {HARM: (1, "threat"), "meant": (1, "threat"), INSULT: (TARGET_REACH, "targeted")})
    forward = reported
    for machine in (negated, before, meant, wished, last):
        forward = compose(forward, machine, SYMBOLS)
    return forward, compose(after, told, (*SYMBOLS, *MARKS))


_FORWARD, _BACKWARD = grammar()
HOSTILE = {INSULT, HARM, DEATH}


def read(clause: list[int]) -> list:
    """What the grammar gives for each symbol of a clause."""
    for machine in (_FORWARD, _BACKWARD):
        state, out = 0, []
        for x in clause:
            state, y = machine.step(state, x)
            out.append(y)
        clause = out[::-1]
    return ["threat" if y == "wished" else y for y in clause]


def stems(word: str) -> list[str]:
    """The word as a whole, and its beginnings (marked by a star)."""
    return [word, *(word[:n] + "*" for n in STEMS if n < len(word))]


class Lexicon:
    """Class and weight of words; words met are remembered."""

    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.seeds = {w: k for k, ws in SEEDS.items() for w in ws.split()}
        self.seeds |= dict.fromkeys(".!?;:\n", END)
        self.seen: dict[str, int] = {}

    def weight(self, word: str) -> float:
        """The greatest log odds of the word's entries, above the least an entry has; seed words weigh 1."""
        return max((self.insults[s] - LEAST_ODDS + 0.5 for s in stems(word) if s in self.insults), default=1.0)

    def classes(self, words: list[str]) -> list[int]:
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        for w in [w for w in set(words) if w not in seen]:
            seen[w] = INSULT if any(s in self.insults for s in stems(w)) else NEGATION if w.endswith(("n't", "n’t")) else self.seeds.get(w, OTHER)
        return list(map(seen.__getitem__, words))

    def matches(self, text: str | None) -> tuple[Counter, Counter]:
        """How many clauses matched each pattern, and the sums of their weights."""
        number, weight = Counter(), Counter()
        words = _WORD.findall(text.lower()) if text else []
        kinds = self.classes(words)
        if HOSTILE.isdisjoint(kinds):
            return number, weight
        ends = [-1, *(i for i, k in enumerate(kinds) if k == END), len(kinds)]
        for a, b in zip(ends, ends[1:]):
            clause = kinds[a + 1 : b]
            if not HOSTILE.isdisjoint(clause):
                path: dict[str, float] = {}
                for i, got in enumerate(read(clause), a + 1):
                    got = "insult" if got == INSULT else got
                    if got in PATTERNS:
                        path[got] = path.get(got, 0.0) + self.weight(words[i])
                number.update(path.keys())
                weight.update(path)
        return number, weight


FEATURES = ("insulting", "targeted", "threat")
#: What the weights of the features are drawn towards.
PRIOR_WEIGHTS = np.array([2.0, 1.0, 4.0])


def features(weight: Counter) -> list[float]:
    return [np.log1p(x) for x in (weight["insult"] + weight["targeted"], weight["targeted"], weight["threat"])]


@dataclass
class ToxicityModel:
    insults: dict[str, float]
    weights: np.ndarray
    bias: float

    def score(self, weight: Counter) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(features(weight), self.weights) + self.bias, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, prior: float, towards: np.ndarray, penalty: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights (none below zero) and bias by Newton steps; rows of class 1 count as a share of ``prior``."""
    share = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    aim, free = np.append(towards, 0.0), np.ones(x.shape[1] + 1, bool)
    w = aim.copy()
    z = np.hstack([x, np.ones((len(x), 1))])
    keep = penalty * np.eye(len(w)) / len(x) ** 0.5
    while True:
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (share * (p - y)) + keep @ (w - aim)
            bend = (z * (share * p * (1 - p))[:, None]).T @ z + keep
            step = np.clip(np.linalg.solve(bend[np.ix_(free, free)], slope[free]), -2, 2)
            w[free] -= step
            if np.abs(step).max() < 1e-6:
                break
        below = np.append(w[:-1] < 0, False)
        if not below.any():
            return w[:-1], float(w[-1])
        free &= ~below
        w[below] = 0.0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """text and label of at most ``sample`` labelled rows of each class outside the held-out fold."""
    known = labels.where((fold(id_col, 3) != 1) & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).alias("label"))
    order = F.crc32(F.concat(F.lit("sample"), F.col(id_col).cast("string")).cast("binary"))
    some = [known.where(F.col("label") == v).orderBy(order, id_col).limit(sample) for v in (0, 1)]
    chosen = some[0].unionByName(some[1]).select(id_col, "label")  # at most 2 * sample rows
    return docs.select(id_col, F.col(text).alias("text")).join(F.broadcast(chosen), id_col).select("text", "label")


def _count_stems(batches):
    counts: dict[str, list[int]] = {}
    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for s in {s for w in set(_WORD.findall((t or "").lower())) if 2 < len(w) <= 24 for s in stems(w)}:
                counts.setdefault(s, [0, 0])[y] += 1
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[k][y] for k in keys], pa.int64()) for y in (0, 1))], ["stem", "n0", "n1"])


def specific(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Drops word beginnings that are hardly more frequent than a longer entry they begin."""
    most: dict[str, int] = {}
    for entry, (n, _) in found.items():
        for s in stems(entry.rstrip("*"))[1:]:
            most[s] = max(most.get(s, 0), n)
    return {e: odds for e, (n, odds) in found.items() if not e.endswith("*") or most.get(e, 0) < 0.8 * n}


def train(rows: DataFrame) -> ToxicityModel:
    """Fit on rows of text and label (0 or 1)."""
    rows = written(rows.select("text", F.col("label").cast("int").alias("label")), "labelled")
    totals = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return ToxicityModel(dict.fromkeys("idiot moron stupid scum loser worthless pathetic disgusting".split(), LEAST_ODDS + 1), PRIOR_WEIGHTS, -3.0)
    counts = rows.mapInArrow(_count_stems, "stem string, n0 long, n1 long").groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    found = counts.where(f"n1 >= {max(LEAST_ROWS, LEAST_SHARE * n1)}").withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    top = found.orderBy(F.desc("n1"), "stem").limit(MOST_ENTRIES).collect()
    insults = specific({r.stem: (r.n1, r.odds) for r in top})
    lexicon = Lexicon(insults)

    def measure(batches):
        for b in batches:
            x = np.array([features(lexicon.matches(t)[1]) for t in b.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c) for c in x.T)], ["label", *FEATURES])

    got = rows.mapInArrow(measure, "label int, " + ", ".join(f"{p} double" for p in FEATURES)).toPandas()  # at most 2 * SAMPLE rows
    weights, bias = logistic(got[list(FEATURES)].to_numpy(float), got["label"].to_numpy(float), PRIOR, PRIOR_WEIGHTS)
    return ToxicityModel(insults, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score, predicted and the number of matches of each pattern."""
    names = [id_col, "score", "predicted", *PATTERNS]

    def run(batches):
        lexicon = Lexicon(model.insults)
        for b in batches:
            found = [lexicon.matches(t) for t in b.column(1).to_pylist()]
            s = [model.score(w) for _, w in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), *(pa.array([n[p] for n, _ in found], pa.int64()) for p in PATTERNS)], names
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, " + ", ".join(f"{p} long" for p in PATTERNS))
