"""Operator 12: secrets by fixed patterns and a character convolutional network.

Fixed patterns find assignments, access keys and long hexadecimal runs; these findings always stay.
Further candidates are all runs of ``LEAST_TOKEN`` or more characters that keys are made of which overlap no
such finding. A network in numpy reads every candidate, whole, with the characters around it: a
convolution over characters (those of the candidate and those around it are told apart), the greatest
response of each filter before, in and after the candidate, the mean response in it, and a logistic unit.

It is trained on findings with labels (``labelled_findings``, made by rule: keys of several alphabets and shapes
after names of credentials; words, names, paths, numbers, dates and identifiers elsewhere).
A second set of findings calibrates: a logistic curve turns the network's output into a probability, and for candidates with
both letters and digits, and for the others, the threshold is the greatest that still finds ``RECALL`` of that set's
secrets. A candidate at or above it is a finding of kind ``model``.

Defined results: null and empty texts have no findings. Equal texts have equal findings. Rows that repeat an id
and rows with a null id are rows like others. A long candidate is read in blocks. Positions are code points, ends
exclusive. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octaspark.llm.common import chunks

# The base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
LEAST_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_TOKEN = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % LEAST_TOKEN)

BEFORE, AFTER = 32, 16
TAPS, FILTERS = 5, 16
#: Labelled findings for training and for calibration.
FINDINGS, CALIBRATION = 1800, 900
RECALL = 0.95
BATCH_CHARS, BLOCK = 1 << 21, 1 << 16
#: Codes: 0 pads, 1 other ASCII, 2 beyond ASCII, then the printable characters; those of a candidate follow with an offset.
_CODES = np.array([0] + [i - 29 if 32 <= i < 127 else 1 for i in range(1, 128)] + [2], np.int16)
ALPHABET = int(_CODES.max()) + 1


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of what the fixed patterns match."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    return out + [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """The base findings, and as ``model`` all tokens that overlap none, in order of start, then kind."""
    base = base_findings(text)
    taken = sorted((a, b) for _, a, b in base)
    out, k, reach = base, 0, 0
    for m in TOKEN.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= m.start():
            out.append(("model", *m.span()))
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def labelled_findings(seed: int, n: int) -> list[tuple[str, int, int, int]]:
    """text, start, end and label (1: a secret) of ``n`` candidates, made by rule."""
    rng = random.Random(seed)
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiouéö" if rng.random() < 0.1 else "aeiou") + rng.choice(["", "", "n", "r", "st", "l"]) for _ in range(rng.randint(1, 3)))
    prose = lambda k: " ".join(word() for _ in range(k))
    chars = lambda of, a, b: "".join(rng.choices(of, k=rng.randint(a, b)))

    def key() -> str:
        body = chars(rng.choice([low + up + digit] * 4 + [low + up + digit + "+/", low + up + digit + "-_", up + digit, low + digit, low + up]), 16, 56)
        return rng.choice([""] * 5 + [f"{chars(low, 2, 4)}{rng.choice('_-')}", f"{chars(low, 2, 3)}_live_", f"{chars(up, 3, 5)}."]) + body + rng.choice([""] * 5 + ["=", "=="])

    def plain() -> str:
        kind = rng.randrange(9)
        if kind < 2:
            parts = [rng.choice([word(), rng.choice("sch tion ing eau lich str aux ent ung ph th wh".split())]) for _ in range(16)]
            letters = "".join(parts).encode("ascii", "ignore").decode()[: rng.randint(16, 30)] + rng.choice(["", "", "."])
            return rng.choice([str.lower, str.lower, str.upper, str.capitalize])(letters.ljust(16, "e"))
        if kind == 2:
            return "".join(word().encode("ascii", "ignore").decode().capitalize() for _ in range(rng.randint(4, 7))).ljust(16, "s")
        if kind == 3:
            return rng.choice("_-./").join(word().encode("ascii", "ignore").decode() + chars(digit, 0, 1) for _ in range(rng.randint(5, 9))).ljust(16, "a")
        if kind == 4:
            return chars(digit, 16, 20)
        if kind == 5:
            return f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}.{rng.randint(10, 59)}.{chars(digit, 3, 6)}"
        if kind == 6:
            return rng.choice("=-_.~") * rng.randint(16, 80)
        if kind == 7:
            return "-".join(chars(digit + "abcdef", k, k) for k in (8, 4, 4, 4, 12))
        return "/".join(["", *(word().encode("ascii", "ignore").decode() for _ in range(rng.randint(3, 6)))]) + rng.choice([".html", ".json", ".py", "/v2.0/index.php", "-1.2.3.tar.gz"])

    names = "key auth credential bearer access private pwd pass signature authorization client license cookie login account_key".split()
    others = "commit title path file name url version page date number reference image class module id etag user".split()
    out = []
    for _ in range(n):
        label = int(rng.random() < 0.5)
        value = key() if label or rng.random() < 0.15 else plain()
        name = rng.choice(names if label else others)
        name = rng.choice([name, name.upper(), name.capitalize(), f"{chars(low, 2, 6)}_{name}", f"x-{name}"])
        sep, close = rng.choice([("=", ""), (": ", ""), (' = "', '"'), ("='", "'"), ('": "', '",'), (" ", ""), (" is ", "."), ("> ", " <"), ("(", ")")])
        if not label and rng.random() < 0.6:
            name, sep, close = "", "", rng.choice(["", ",", ".", ")"])
        elif label and rng.random() < 0.2:  # a key without a name before it is one if it looks like a provider's
            name, sep, value = "", "", f"{chars(low, 2, 4)}_" + chars(low + up + digit, 20, 40)
        left = prose(rng.randint(0, 8)) + rng.choice([" ", "\n", ". ", "### "]) + name + sep
        text = left + value + close + rng.choice([" ", "\n", "", "$$$ "]) + prose(rng.randint(0, 6))
        out.append((text, len(left), len(left) + len(value), label))
    return out


def encode(found: Iterable[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of candidates with what is around them, one after the other, and where the three parts of each start."""
    parts, sizes = [], []
    for text, a, b in found:
        three = ("\0\0" + text[max(0, a - BEFORE) : a].replace("\0", " "), text[a:b], text[b : b + AFTER].replace("\0", " ") + "\0\0")
        parts += three
        sizes += map(len, three)
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array(sizes, np.int64)
    inside = np.repeat(np.arange(len(sizes)) % 3 == 1, sizes)
    return _CODES[np.minimum(points, 128)] + np.int16(ALPHABET) * inside, np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class SecretModel:
    kernel: np.ndarray  # TAPS x (2 * ALPHABET) x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 4 * FILTERS
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, float] = (0.5, 0.5)  # of candidates that mix letters and digits, and of others

    def respond(self, codes: np.ndarray, a: int, b: int) -> np.ndarray:
        """The filters' responses at positions a to b."""
        half = TAPS // 2
        near = np.zeros(b - a + 2 * half, np.int16)
        lo, hi = max(0, a - half), min(len(codes), b + half)
        near[lo - a + half : hi - a + half] = codes[lo:hi]
        out = np.tile(self.bias, (b - a, 1))
        for j in range(TAPS):
            out += self.kernel[j][near[j : j + b - a]]
        return np.maximum(out, 0)

    def pooled(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The greatest response before, in and after each candidate, and the mean in it; block by block."""
        n = len(edges) - 1
        most, total = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float64)
        for a in range(0, len(codes), BLOCK):
            b = min(a + BLOCK, len(codes))
            got = self.respond(codes, a, b)
            ids = np.arange(np.searchsorted(edges, a, "right") - 1, np.searchsorted(edges, b, "left"))
            at = np.maximum(edges[ids] - a, 0)
            most[ids] = np.maximum(most[ids], np.maximum.reduceat(got, at))
            total[ids] += np.add.reduceat(got, at, dtype=np.float64)
        mean = total[1::3] / np.maximum(1, np.diff(edges)[1::3])[:, None]
        return np.hstack([most[0::3], most[1::3], most[2::3], mean.astype(np.float32)])

    def logits(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        return self.pooled(*encode(found)) @ self.weights + self.offset if found else np.zeros(0)

    def scores(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(found) + self.shift, -30, 30)))

    def threshold(self, value: str) -> float:
        return self.thresholds[not mixed(value)]


def mixed(value: str) -> bool:
    """Whether a candidate has both letters and digits."""
    return bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value))


def fit(labelled: list[tuple[str, int, int, int]], epochs: int = 14, batch: int = 100, rate: float = 0.01, seed: int = 5) -> SecretModel:
    """Adam on small batches, with gradients by hand: only the greatest responses and the means pass any on."""
    rng = np.random.default_rng(seed)
    m = SecretModel(rng.normal(0, 0.1, (TAPS, 2 * ALPHABET, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 4 * FILTERS), 0.0)
    p = {"kernel": m.kernel, "bias": m.bias, "weights": m.weights, "offset": np.zeros(1)}
    m1, m2 = ({k: np.zeros_like(z) for k, z in p.items()} for _ in range(2))
    step, half = 0, TAPS // 2
    for _ in range(epochs):
        order = rng.permutation(len(labelled))
        for lo in range(0, len(order), batch):
            rows = [labelled[i] for i in order[lo : lo + batch]]
            codes, edges = encode(r[:3] for r in rows)
            y = np.array([r[3] for r in rows], float)
            got = m.respond(codes, 0, len(codes))
            size = np.diff(edges)
            most = np.maximum.reduceat(got, edges[:-1])
            mean = np.add.reduceat(got, edges[:-1])[1::3] / size[1::3, None]
            x = np.hstack([most[0::3], most[1::3], most[2::3], mean])
            d = (1 / (1 + np.exp(-np.clip(x @ p["weights"] + p["offset"][0], -30, 30))) - y) / len(rows)
            part = (d[:, None] * p["weights"]).reshape(len(rows), 4, FILTERS)
            down = np.repeat(part[:, :3].reshape(-1, FILTERS), size, 0) * (got == np.repeat(most, size, 0))
            inside = np.repeat(np.arange(len(size)) % 3 == 1, size)
            down[inside] += np.repeat(part[:, 3] / size[1::3, None], size[1::3], 0)
            down *= got > 0
            around = np.concatenate([np.zeros(half, np.int16), codes, np.zeros(half, np.int16)])
            kernel = np.empty_like(p["kernel"])
            for j in range(TAPS):
                at = around[j : j + len(codes)]
                for f in range(FILTERS):
                    kernel[j, :, f] = np.bincount(at, down[:, f], 2 * ALPHABET)
            grad = {"kernel": kernel, "bias": down.sum(0), "weights": x.T @ d, "offset": np.array([d.sum()])}
            step += 1
            for k in p:
                g = grad[k] + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g**2
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return SecretModel(m.kernel.astype(np.float32), m.bias.astype(np.float32), m.weights.astype(np.float32), float(p["offset"][0]))


def calibrate(model: SecretModel, labelled: list[tuple[str, int, int, int]], recall: float = RECALL) -> SecretModel:
    """Sets the curve from output to probability, and the thresholds that keep ``recall`` of the secrets."""
    z, y = model.logits([r[:3] for r in labelled]), np.array([r[3] for r in labelled], float)
    w, x = np.array([1.0, 0.0]), np.stack([z, np.ones(len(z))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - y) + 1e-3 * (w - [1, 0]))
    model.slope, model.shift = map(float, w)
    s = model.scores([r[:3] for r in labelled])
    of = np.array([mixed(r[0][r[1] : r[2]]) for r in labelled])
    cut = lambda own: float(np.sort(own)[int((1 - recall) * len(own))])
    model.thresholds = tuple(cut(s[(y == 1) & (of == kind)] if ((y == 1) & (of == kind)).any() else s[y == 1]) for kind in (True, False))
    return model


@functools.lru_cache(maxsize=1)
def train() -> SecretModel:
    return calibrate(fit(labelled_findings(1, FINDINGS)), labelled_findings(2, CALIBRATION))


def _groups(found: list[tuple[str, int, int]]) -> Iterator[slice]:
    yield from chunks([b - a + BEFORE + AFTER for _, a, b in found], 1 << 20)


def findings(texts: list[str | None], model: SecretModel) -> list[list[tuple]]:
    """Of each text: kind, start, end, base and score of its findings, in order of start, then kind."""
    places = [(k, *c) for k, t in enumerate(texts) if t for c in candidates(t)]
    found = [(texts[k], a, b) for k, _, a, b in places]
    score = np.concatenate([model.scores(found[g]) for g in _groups(found)]) if found else []
    out: list[list[tuple]] = [[] for _ in texts]
    for (k, kind, a, b), s in zip(places, score):
        if kind != "model" or s >= model.threshold(texts[k][a:b]):
            out[k].append((kind, a, b, kind != "model", float(s)))
    return out


def scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and findings (kind, start, end, base, score) of every row."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        names = [f.name for f in kind]
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in chunks([len(t or "") for t in texts], BATCH_CHARS):
                rows = [[dict(zip(names, f)) for f in own] for own in findings(texts[at], model)]
                yield pa.RecordBatch.from_arrays([b.column(0)[at.start : at.stop], pa.array(rows, pa.list_(kind))], [id_col, "findings"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {id_kind}, findings array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, counts by kind, the hash of the base findings' places, and all places."""
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    place = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    base = F.array_join(F.transform(F.filter("findings", lambda f: f["base"]), place), ",")
    counts = [of(k).alias(n) for k, n in zip(KINDS, ("n_assign", "n_access", "n_hex", "n_model"))]
    return found.select(id_col, *counts[:3], F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("findings", place), ",").alias("spans"), counts[3])
