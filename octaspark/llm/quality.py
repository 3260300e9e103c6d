"""Operator 9: quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded as
shares of character and word kinds (capitals, digits, marks, separators, repeated words
and lines, lengths). A gated attention network weighs the passages: weight
softmax(w . (tanh(V h) * sigmoid(U h))), and the weighted mean representation is scored
by a logistic unit. Only documents have labels; weights of passages follow from them.

Training uses at most ``SAMPLE`` labelled rows of each class, chosen by a hash of the
id, and of each at most ``MOST_PASSAGES`` passages, evenly spread over the text; Spark encodes them and the
driver fits a few hundred parameters on their passage encodings, whose size is thus
bounded (100 MB). Scoring encodes every passage of every text.

Defined results: null and empty texts are one passage without words. Equal texts have
equal scores. With no training rows of both classes every score is 0.5. Rows
with a null id are not used for training. Of labels that repeat an id, the greatest
counts. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from octaspark.llm.common import WordHasher
from octaspark.llm.toxicity import training_rows

#: Labelled rows of each class that training uses at most.
SAMPLE = 3000
#: Passages of a training text that are used at most, evenly spread over it; scoring reads all.
MOST_PASSAGES = 256
PASSAGE_WORDS = 64
HIDDEN = 8
_hasher = WordHasher(b"\x20\x09\x0a\x0b\x0c\x0d", seed=41)


def _kind(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], np.float32)


_KINDS = [
    _kind(lambda b: 65 <= b <= 90),
    _kind(lambda b: 97 <= b <= 122),
    _kind(lambda b: 48 <= b <= 57),
    _kind(lambda b: b >= 128),
    _kind(lambda b: chr(b) in ".,"),
    _kind(lambda b: chr(b) in "!?"),
    _kind(lambda b: chr(b) in "|/\\<>{}[]=_~^"),
    _kind(lambda b: chr(b) in "#$%&*@+"),
    _kind(lambda b: b == 10),
    _kind(lambda b: b < 32 and b != 10),
]
FEATURES = len(_KINDS) + 7


def encode(text: str | None) -> np.ndarray:
    """Passages x FEATURES of the whole text; at least one passage."""
    data = (text or "").encode("utf-8", "surrogatepass")
    h, start, end = _hasher.words(data)
    n = len(h)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    low = _hasher.words(data.lower())[0]
    first = np.arange(0, n, PASSAGE_WORDS)
    if len(first) > 1 and n - first[-1] < PASSAGE_WORDS // 2:
        first = first[:-1]  # a short rest joins the passage before
    a = np.frombuffer(data, np.uint8)
    edge = np.concatenate([start[first], [len(a)]])
    size = np.diff(edge).astype(np.float32)
    words = np.diff(np.concatenate([first, [n]])).astype(np.float32)
    cols = [np.add.reduceat(k[a], edge[:-1]) / size for k in _KINDS]
    passage = np.repeat(np.arange(len(first)), words.astype(np.int64))
    own = np.unique(low ^ (passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    cols.append(np.bincount(passage[own], minlength=len(first)) / words)  # distinct words
    again = np.concatenate([[0], (low[1:] == low[:-1]).astype(np.float32)])
    cols.append(np.add.reduceat(again, first) / words)  # a word after itself
    length = (end - start).astype(np.float32)
    mean = np.add.reduceat(length, first) / words
    cols += [mean / 10, np.sqrt(np.maximum(0, np.add.reduceat(length**2, first) / words - mean**2)) / 10]
    capital = (a[start] >= 65) & (a[start] <= 90)
    cols.append(np.add.reduceat(capital.astype(np.float32), first) / words)
    cols.append(np.add.reduceat(((_KINDS[7] + _KINDS[5])[a[end - 1]]).astype(np.float32), first) / words)  # words that end in a mark
    cols.append(np.full(len(first), np.unique(low).size / n))  # distinct words of the document
    return np.stack(cols, 1).astype(np.float32)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray  # FEATURES x HIDDEN
    u: np.ndarray  # FEATURES x HIDDEN
    w: np.ndarray  # HIDDEN
    c: np.ndarray  # FEATURES
    bias: float

    def attention(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights of the passages and the document's score."""
        h = (x - self.mean) / self.scale
        e = (np.tanh(h @ self.v) / (1 + np.exp(-h @ self.u))) @ self.w
        a = np.exp(e - e.max())
        a /= a.sum()
        return a, float(1 / (1 + np.exp(-np.clip(a @ h @ self.c + self.bias, -30, 30))))


def fit(bags: list[np.ndarray], y: np.ndarray, steps: int = 400, rate: float = 0.02, seed: int = 3) -> QualityModel:
    """Adam on all bags at once, with gradients by hand; both classes count alike."""
    x = np.concatenate(bags).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    h = (x - mean) / scale
    sizes = np.array([len(b) for b in bags])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    bag = np.repeat(np.arange(len(bags)), sizes)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    rng = np.random.default_rng(seed)
    p = {"v": rng.normal(0, 0.1, (FEATURES, HIDDEN)), "u": rng.normal(0, 0.1, (FEATURES, HIDDEN)), "w": rng.normal(0, 0.1, HIDDEN), "c": np.zeros(FEATURES), "b": np.zeros(1)}
    m1, m2 = ({k: np.zeros_like(z) for k, z in p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        th, sg = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-h @ p["u"]))
        e = (th * sg) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a /= np.add.reduceat(a, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        d = share * (s - y)
        gc = z.T @ d
        da = (h @ p["c"]) * d[bag]
        de = a * (da - np.add.reduceat(a * da, at)[bag])
        gw = (th * sg).T @ de
        g = de[:, None] * p["w"]
        grad = {"v": h.T @ (g * sg * (1 - th**2)), "u": h.T @ (g * th * sg * (1 - sg)), "w": gw, "c": gc, "b": np.array([d.sum()])}
        for k in p:
            grad[k] += 1e-3 * p[k] if k != "b" else 0
            m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
            m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return QualityModel(mean, scale, p["v"], p["u"], p["w"], p["c"], float(p["b"][0]))


def spread(x: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` rows, evenly spread from the first to the last."""
    return x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).round().astype(int)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text") -> QualityModel:
    rows = training_rows(docs, labels, label, id_col, text, SAMPLE)

    def run(batches):
        for b in batches:
            x = [spread(encode(t), MOST_PASSAGES).ravel().tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), b.column(1)], ["x", "label"])

    got = rows.selectExpr("text", "cast(label AS int) AS label").mapInArrow(run, "x array<float>, label int").toArrow()
    y = got.column("label").to_numpy()
    if not (y == 0).any() or not (y == 1).any():
        z = np.zeros(FEATURES)
        return QualityModel(z, z + 1, np.zeros((FEATURES, HIDDEN)), np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), z, 0.0)
    bags = [np.array(x, np.float32).reshape(-1, FEATURES) for x in got.column("x").to_pylist()]
    return fit(bags, y.astype(float))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, score, predicted, n_passages and the passage that weighs most."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                a, s = model.attention(encode(t))
                rows.append((s, int(s >= threshold), len(a), int(a.argmax())))
            cols = list(zip(*rows)) or [[]] * 4
            types = (pa.float64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, types))], [id_col, "score", "predicted", "n_passages", "top_passage"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, n_passages long, top_passage long")
