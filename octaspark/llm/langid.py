"""Operator 7: language identification by error-correcting output codes.

Every language gets a binary codeword. For each code bit a binary n-gram classifier
(naive Bayes over hashed byte trigrams of the lower-cased letters) predicts that bit;
a document gets the language whose codeword has the least weighted loss, and is
flagged as ambiguous when the runner-up is nearly as close.

Training needs only n-gram counts per language, which Spark sums over all training rows. A task holds the counts of at
most ``HELD`` languages at a time. From them Spark sums, for each bit and bucket, the shares of the
languages on either side; these sums (bits x ``BUCKETS``, the bits growing with the logarithm of the languages) and the
languages' names and totals are all that reaches the driver. Every value of the language column is learned.

Defined results: null text, empty text and text without a letter give ``und`` with
score 0 and are not ambiguous. Equal texts get equal results. With no training
rows every document is ``und``. Rows with a null id are never used for training and
are not held out. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octaspark.llm.common import cut_lineage, fold

BUCKETS = 8192
#: Languages whose counts a task holds at a time.
HELD = 64
UNDETERMINED = "und"
#: Scale from a mean log-odds per n-gram to a classifier margin.
SHARPNESS = 2.0
#: A document is ambiguous when its two best losses differ by less than this share.
AMBIGUOUS = 0.05
_LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def ngram_counts(text: str, block: int = 1 << 20) -> np.ndarray:
    """Counts of hashed byte trigrams over the whole text; runs of blanks don't count."""
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b" ", np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(a) - 2), block):
        x = a[at : at + block + 2].astype(np.uint32)
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        code = code[code != 0x202020]
        out += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(19), minlength=BUCKETS)
    return out


def codewords(k: int) -> np.ndarray:
    """A k x bits matrix of -1 and 1: all splits for few languages, balanced ones in random order beyond."""
    if k <= 1:
        return np.ones((k, 0), np.int8)
    if k <= 6:
        bits = [[1 if (m >> i) & 1 else -1 for i in range(k - 1)] + [-1] for m in range(1, 2 ** (k - 1))]
        return np.array(bits, np.int8).T
    rng, n = np.random.default_rng(11), 15 * math.ceil(math.log2(k))
    if k <= 10:
        # Of a split and its complement one, which has the first language on the smaller side or, if equal, in it.
        sides = [c for c in itertools.combinations(range(k), k // 2) if k % 2 or c[0] == 0]
        sides = [sides[i] for i in rng.permutation(len(sides))[:n]]
    else:
        met: dict[tuple, None] = {}
        while len(met) < n:  # over 400 splits for at most 60 bits, and far more for more languages
            c = tuple(sorted(rng.permutation(k)[: k // 2].tolist()))
            if k % 2 or 0 in c:
                met[c] = None
        sides = list(met)
    code = np.full((k, len(sides)), -1, np.int8)
    for bit, side in enumerate(sides):
        code[list(side), bit] = 1
    return code


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # bits

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin of the two best losses, ambiguous."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, 1.0, False
        n = ngram_counts(text)
        margins = np.clip(SHARPNESS * (n @ self.weights) / max(1, n.sum()), -30, 30)
        loss = (np.log1p(np.exp(-self.code * margins)) * self.trust).sum(1)
        order = np.argsort(loss, kind="stable")
        best, second = loss[order[0]], loss[order[1]]
        p = np.exp((best - loss) * len(self.trust))
        margin = float((second - best) / second) if second > 0 else 0.0
        return self.languages[order[0]], float(1 / p.sum()), margin, margin < AMBIGUOUS


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on every row of ``docs`` with a text and a language."""

    def count(batches):
        total: dict[str, np.ndarray] = {}

        def out():
            for g, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])
            total.clear()

        for b in batches:
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if g not in total and len(total) >= HELD:
                    yield from out()
                total[g] = total.get(g, 0) + ngram_counts(t)
        yield from out()

    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = cut_lineage(known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # a name and a number each
    languages = sorted(totals)
    code = codewords(len(languages))
    bits = code.shape[1]
    if not bits:
        return LanguageModel(languages, code, np.zeros((BUCKETS, 0), np.float32), np.ones(0))
    number = {g: k for k, g in enumerate(languages)}
    size = np.array([totals[g] for g in languages]) + 0.5 * BUCKETS  # counts are smoothed by a half for each bucket

    def sides(batches):
        share = np.zeros((BUCKETS, 1 + bits))  # of all languages, then of those on the one side of each bit
        for b in batches:
            own = np.array([number[g] for g in b.column(0).to_pylist()], np.int64)
            for lo in range(0, len(own), 4096):
                k, at = own[lo : lo + 4096], b.column(1).to_numpy()[lo : lo + 4096]
                part = b.column(2).to_numpy()[lo : lo + 4096] / size[k]
                np.add.at(share, at, part[:, None] * np.hstack([np.ones((len(k), 1)), code[k] == 1]))
        at = np.flatnonzero(share[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(share[at].tolist(), pa.list_(pa.float64()))], ["bucket", "share"])

    one = F.posexplode("share").alias("bit", "share")
    sums = counts.mapInArrow(sides, "bucket int, share array<double>").select("bucket", one).groupBy("bucket", "bit").agg(F.sum("share").alias("share")).toPandas()
    share = np.zeros((BUCKETS, 1 + bits))
    share[sums["bucket"], sums["bit"]] = sums["share"]
    there = code == 1
    base = 0.5 / size
    yes = (share[:, 1:] + (base[:, None] * there).sum(0)) / there.sum(0)
    no = (share[:, :1] - share[:, 1:] + (base[:, None] * ~there).sum(0)) / (~there).sum(0)
    weights = np.log(yes / no)
    trust = ((yes - no) * weights).sum(0)  # how far apart the two sides are
    return LanguageModel(languages, code, weights.astype(np.float32), trust / trust.mean())


def train_on_folds(docs: DataFrame, id_col: str = "doc_id", modulus: int = 4, held: int = 2) -> LanguageModel:
    return train(docs.where(fold(id_col, modulus) != held))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score, margin and ambiguous for every row."""

    def run(batches):
        for b in batches:
            got = [model.predict(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*got)) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())],
                [id_col, "lang_pred", "score", "margin", "ambiguous"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, margin double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows whose language could be told: ``und`` rows go. All columns stay."""

    def run(batches):
        for b in batches:
            ok = [model.predict(t)[0] != UNDETERMINED for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
