"""Operator 2: substring deduplication by sliding spans of sentences.

A text is cut into sentences at full stops, question and exclamation marks and line
ends. A sentence of more than ``LONG_SENTENCE`` words is cut further after words chosen
by their hash, so that the same passage is cut alike wherever it begins, and at that
many words at the latest. From every sentence a span of consecutive sentences runs
forward, and one backward: as many as it takes, two at least, to have ``SPAN_WORDS`` words. So
every repeated run of several sentences and that many words is made of such spans. (Shorter
runs, such as three one-word sentences, repeat by chance.) Spans are
hashed (96 bits) and joined over all documents. A sentence goes if it is covered by a
span that isn't the first of its kind: first is the least id, and within a document
the first position.

A repeated passage may start or end within a sentence. Where covered sentences start
and end, the ``REACH`` words before and after are compared with those around the first
occurrence of the same span, and go as far as they agree.

Spans are written once, then the repeated ones. Both sides of the joins are plain
shuffles, so that a span that a third of all documents hold is combined before the
shuffle where it is counted, and split by AQE where it is joined.

Defined results: null stays null; empty texts and texts of fewer than two sentences
are unchanged. Rows that repeat an id count as one document, also
with different texts: neither loses what the other holds too. A row with a null id
loses only what it repeats itself and costs no other row anything. White space
before a removed sentence stays, white space after it goes. Extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octaspark.llm.common import WordHasher, mix64, written

SPAN_WORDS = 16
LONG_SENTENCE = 16
#: In a long sentence one word in so many ends a piece.
CUT_EVERY = 6
#: Words beyond a covered run that are compared: no sentence has more.
REACH = LONG_SENTENCE
_hasher = WordHasher(b"\x20\x09\x0a\x0b\x0c\x0d", seed=23)
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_BASE = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class _Powers:
    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) <= n:
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(2 * n, self.base))])
            self.down = np.concatenate([one, np.cumprod(np.full(2 * n, self.inverse))])
        return self.up[: n + 1], self.down[: n + 1]


_powers = [_Powers(b) for b in _BASE]


class Sentences:
    """Sentences of a text by word and byte offsets, and its spans."""

    def __init__(self, text: str):
        self.data = text.encode("utf-8", "surrogatepass")
        self.hash, self.start, self.end = _hasher.words(self.data.lower())
        n = len(self.hash)
        if not n:
            self.first = self.bound = np.zeros(0, np.int64)
            return
        a = np.frombuffer(self.data, np.uint8)
        lines = np.concatenate([[0], np.cumsum(a == 10)])
        ends = _END[a[self.end - 1]]
        ends[:-1] |= lines[self.start[1:]] > lines[self.end[:-1]]
        ends[-1] = True
        last = np.flatnonzero(ends)
        size = np.diff(np.concatenate([[-1], last]))
        if (size > LONG_SENTENCE).any():
            long = np.repeat(size > LONG_SENTENCE, size)
            ends |= long & (self.hash % np.uint64(CUT_EVERY) == 0)
            last = np.flatnonzero(ends)
            size = np.diff(np.concatenate([[-1], last]))
            for k in np.flatnonzero(size > LONG_SENTENCE):
                ends[last[k] - size[k] + LONG_SENTENCE : last[k] : LONG_SENTENCE] = True
            last = np.flatnonzero(ends)
        self.first = np.concatenate([[0], last[:-1] + 1])  # word at which each sentence starts
        self.bound = np.concatenate([self.first, [n]])

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last sentence and both hashes of every span."""
        m, n = len(self.first), len(self.hash)
        none = np.zeros(0, np.int64)
        if m < 2:
            return none, none, none, none
        bound = self.bound
        i = np.arange(m)
        # forward: the least j > i with enough words
        j = np.maximum(np.searchsorted(bound, bound[:-1] + SPAN_WORDS) - 1, i + 1)
        ok = j < m
        forward = i[ok] * (m + 1) + j[ok]
        # backward: the greatest i with the same
        b = np.minimum(np.searchsorted(bound, bound[1:] - SPAN_WORDS, side="right") - 1, i - 1)
        ok = b >= 0
        both = np.unique(np.concatenate([forward, b[ok] * (m + 1) + i[ok]]))
        first, last = both // (m + 1), both % (m + 1)
        s, e = bound[first], bound[last + 1]
        out = []
        for p in _powers:
            up, down = p.upto(n)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * up[:n])])
            out.append(mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)).view(np.int64))
        return first, last, out[0], out[1]

    def before(self, word: int) -> np.ndarray:
        """16 bits of each of the words before one, the nearest first."""
        return self.hash[max(0, word - REACH) : word][::-1].astype(np.uint16).view(np.int16)

    def after(self, word: int) -> np.ndarray:
        return self.hash[word : word + REACH].astype(np.uint16).view(np.int16)

    def without(self, gone: np.ndarray) -> str:
        """The text without the words marked in ``gone``."""
        edge = np.concatenate([self.start, [len(self.data)]])
        keep = [self.data[: edge[0]]]
        change = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
        for a, b in zip(change[::2], change[1::2]):  # runs of kept words
            keep.append(self.data[edge[a] : edge[b]])
        return b"".join(keep).decode("utf-8", "surrogatepass")


def _spans(batches):
    """Each document's distinct spans: h1, h2, id."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            h1, h2, rows = [], [], []
            for k, t in enumerate(part.column(1).to_pylist()):
                if t:
                    _, _, x, y = Sentences(t).spans()
                    x, own = np.unique(x, return_index=True)
                    h1.append(x)
                    h2.append(y[own].astype(np.int32))
                    rows.append(np.full(len(x), k))
            if h1:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(h1)), pa.array(np.concatenate(h2)), part.column(0).take(pa.array(np.concatenate(rows)))], ["h1", "h2", "id"]
                )


def covered_runs(hit: np.ndarray, first: np.ndarray, last: np.ndarray, m: int) -> list[tuple[int, int, int, int]]:
    """Runs of sentences that lie in a span of ``hit``: first and last sentence, a span that starts there and one that ends there."""
    gone = np.zeros(m + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(gone, first[at], 1)
    np.add.at(gone, last[at] + 1, -1)
    change = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(gone)[:-1] > 0, [0]])))
    starts, ends = dict(zip(first[at].tolist(), at.tolist())), dict(zip(last[at].tolist(), at.tolist()))
    return [(a, b - 1, starts[a], ends[b - 1]) for a, b in zip(change[::2].tolist(), change[1::2].tolist())]


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    return int(other[0]) if len(other) else n


def covered_words(s: Sentences, repeated: np.ndarray, reach: dict[tuple[int, int], int]) -> np.ndarray:
    """Which words lie in a span met before, here or (``repeated``) elsewhere, or continue one on as far as ``reach`` tells."""
    gone = np.zeros(len(s.hash), bool)
    first, last, h, _ = s.spans()
    if len(h):
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h), bool)
        same[1:] = h[order[1:]] == h[order[:-1]]
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))]  # the first place of each hash
        earlier = np.empty(len(h), np.int64)
        earlier[order] = head
        for a, b, k, z in covered_runs(np.isin(h, repeated), first, last, len(s.first)):
            x, y = s.bound[a], s.bound[b + 1]
            gone[max(0, x - reach.get((int(h[k]), 0), 0)) : y + reach.get((int(h[z]), 1), 0)] = True
        for a, b, k, z in covered_runs(earlier != np.arange(len(h)), first, last, len(s.first)):
            x, y = s.bound[a], s.bound[b + 1]
            x0, y0 = s.bound[first[earlier[k]]], s.bound[last[earlier[z]] + 1]
            gone[x - _alike(s.before(x), s.before(x0)) : y + _alike(s.after(y), s.after(y0))] = True
    return gone


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with shortened texts; ``counts`` appends n_sentences, n_removed (also in part) and words_removed."""
    kind = docs.schema[id_col].dataType.simpleString()
    columns, extra = docs.columns, ["n_sentences", "n_removed", "words_removed"] if counts else []
    at = columns.index(text)
    known = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    spans = written(known.mapInArrow(_spans, f"h1 long, h2 int, id {kind}"), "spans")
    seen = spans.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    seen = written(seen.where("least < most").select("h1", "h2", "least"), "repeated")
    hits = spans.join(seen, ["h1", "h2"])
    by_doc = hits.groupBy(F.col("id").alias("_id")).agg(
        F.collect_set(F.when(F.col("id") != F.col("least"), F.col("h1"))).alias("repeated"), F.collect_set(F.when(F.col("id") == F.col("least"), F.col("h1"))).alias("firsts")
    )
    by_doc = written(by_doc.withColumn("_deal", F.lit(0).cast("long")), "hits")
    # Whole rows, so that all three joins below read one exchange of texts; rows without an id are dealt out.
    rows = docs.select(
        F.col(id_col).alias("_id"), F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(text), F.lit(1024))).otherwise(F.lit(0).cast("long")).alias("_deal"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    )
    joined = rows.join(by_doc, ["_id", "_deal"], "left")

    def contexts(of_text, hits, names):
        """Rows that ``of_text`` gives for each text with hits."""
        types = {"h": pa.int64(), "side": pa.int32(), "before": pa.list_(pa.int16()), "after": pa.list_(pa.int16()), "words": pa.list_(pa.int16())}

        def run(batches):
            for b in batches:
                found, of = [], []
                for k, h in enumerate(b.column(b.schema.get_field_index(hits)).to_pylist()):
                    t = b.column(b.schema.get_field_index("_row")).field(at)[k].as_py() if h else None
                    if t:
                        new = of_text(Sentences(t), np.array(h, np.int64))
                        found += new
                        of += [k] * len(new)
                cols = list(zip(*found)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("_id")).take(pa.array(of, pa.int64())), *(pa.array(c, types[x]) for c, x in zip(cols, names))], ["_id", *names])

        sql = {pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int16()): "array<short>"}
        return joined.select("_id", F.when(F.col(hits).isNotNull(), F.col("_row")).alias("_row"), hits).mapInArrow(run, f"_id {kind}, " + ", ".join(f"{x} {sql[types[x]]}" for x in names))

    def around_first(s: Sentences, firsts: np.ndarray) -> list[tuple]:
        first, last, h, _ = s.spans()
        h, own = np.unique(h, return_index=True)
        own = own[np.isin(h, firsts)]
        return [(x, s.before(a).tolist(), s.after(b).tolist()) for x, a, b in zip(h[np.isin(h, firsts)].tolist(), s.bound[first[own]].tolist(), s.bound[last[own] + 1].tolist())]

    def around_runs(s: Sentences, repeated: np.ndarray) -> list[tuple]:
        first, last, h, _ = s.spans()
        out = []
        for a, b, k, z in covered_runs(np.isin(h, repeated), first, last, len(s.first)):
            out += [(int(h[k]), 0, s.before(s.bound[a]).tolist()), (int(h[z]), 1, s.after(s.bound[b + 1]).tolist())]
        return out

    there = contexts(around_first, "firsts", ["h", "before", "after"]).drop("_id")
    here = contexts(around_runs, "repeated", ["h", "side", "words"])
    other = F.expr("array_position(zip_with(words, IF(side = 0, before, after), (x, y) -> NOT (x <=> y)), true)")
    # A column that isn't a literal, or the optimiser would join, and shuffle the texts, by the id alone.
    agree = here.join(there, "h").select("_id", (F.col("side") * 0).cast("long").alias("_deal"), "h", "side", F.when(other > 0, other - 1).otherwise(F.size("words")).cast("int").alias("n")).where("n > 0")
    reach = agree.groupBy("_id", "_deal").agg(F.collect_set(F.struct("h", "side", "n")).alias("reach"))

    def rebuild(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part, texts, more = b.slice(lo, 512), [], []
                row = part.column(0)
                for t, h, far in zip(row.field(at).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if not t:
                        texts.append(t)
                        more.append((0, 0, 0))
                        continue
                    s = Sentences(t)
                    most: dict[tuple[int, int], int] = {}
                    for x in far or []:
                        most[x["h"], x["side"]] = max(x["n"], most.get((x["h"], x["side"]), 0))
                    gone = covered_words(s, np.array(h or [], np.int64), most)
                    texts.append(s.without(gone) if gone.any() else t)
                    parts = np.logical_or.reduceat(gone, s.first) if len(gone) else gone
                    more.append((len(parts), int(parts.sum()), int(gone.sum())))
                arrays = [pa.array(texts, pa.string()) if k == at else row.field(k) for k in range(len(columns))]
                if counts:
                    arrays += [pa.array(c, pa.int64()) for c in zip(*more)]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, *extra])

    schema = docs.schema
    for c in extra:
        schema = schema.add(c, "long")
    return joined.join(reach, ["_id", "_deal"], "left").select("_row", "repeated", "reach").mapInArrow(rebuild, schema)
