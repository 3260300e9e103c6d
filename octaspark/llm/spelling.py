"""Operator 13: spelling variants by a relational trie frontier.

Words are counted over all texts. The frequent ones, forwards and backwards, form a trie, kept as a table of
its nodes by depth: a node is a prefix, with its children's letters, counts and next letters. States (word, position,
node, edits) are joined with the nodes of one depth at a time. A state without an edit stands where its word stands;
in the second half of the word it may replace a letter by a greater one, or drop it, and has an edit from then on
(edits in the first half are made in the second half of the word read backwards). A state with an edit follows its
word's letters. A child is taken only if it has the letter that the word needs next. A state that has used up its
word at a node that is itself a word tells a pair of neighbours. Each pair is found once (the lesser word
replaces, the longer one drops; of a run of equal letters the last is dropped) and then read both ways.

Joins shuffle by node, and AQE splits a node with very many states. After every ``STRIDE`` depths the states are
written to the shared folder; the tables are deleted when the neighbours are written.

The frontier goes ``LEVELS`` deep. Words longer than that are settled by an exact way for the rest: hashes
of the word without each of its letters, joined with hashes of other words and of words without the
same place, then compared letter by letter. Work is linear in their length.

Each word's form is its most frequent neighbour if that is at least ``ratio`` times as frequent. Counts grow
along forms, so chains are short (log2 of the greatest count); roots come by pointer doubling.

Defined results: null and empty texts have no words. A row with a null id counts its words as
they are. Rows that repeat an id are rows like others. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octaspark.llm.common import mix64, scratch, written

MODULUS = 97
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
#: How deep the trie is; longer words are settled by hashes.
LEVELS = 40
#: So many depths are joined in one job, then the states are written.
STRIDE = 4
#: Letters of the distinct words that a task counts before it passes them on.
HELD_LETTERS = 1_000_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(key: str | None, text: str | None, modulus: int = MODULUS, least: int = LEAST_LETTERS) -> Counter:
    """Occurrences of the words of a text; a run whose hash with the row's key is a multiple of ``modulus`` loses a letter."""
    out: Counter = Counter()
    low = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    start = zlib.crc32(f"{key}:".encode())
    for run, n in Counter(_RUN.findall(low)).items():
        if len(run) < least:
            continue
        if key is not None:
            h = zlib.crc32(run.encode(), start)
            if h % modulus == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
        out[run] += n
    return out


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", modulus: int = MODULUS, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words with enough letters and occurrences."""

    def count(batches):
        held: Counter = Counter()
        letters = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for part in (b.slice(lo, 256) for lo in range(0, b.num_rows, 256)):
                for key, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for w, n in words_of(key, t, modulus, least_letters).items():
                        if w not in held:
                            letters += len(w)
                        held[w] += n
                    if letters > HELD_LETTERS:
                        yield out()
                        held, letters = Counter(), 0
        yield out()

    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def both_ways(words: DataFrame) -> DataFrame:
    """w, n and first: each word behind ``>`` and, backwards, behind ``<``, and the first place where it may be edited.

    An edit in the second half of a word is found forwards, one in the first half backwards: so a state has used
    half of its word before it branches, where nodes have few children.
    """
    half = F.floor(F.length("word") / 2).cast("int")
    forwards = F.struct(F.concat(F.lit(">"), "word").alias("w"), (1 + half).alias("first"))
    backwards = F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("w"), (1 + F.length("word") - half).alias("first"))
    return words.select("n", F.explode(F.array(forwards, backwards)).alias("s")).select("s.w", "n", "s.first")


def trie(words: DataFrame) -> DataFrame:
    """depth, node (a prefix of some w), own (the count of the node as a word, else 0), letters (that follow) and kids (letter, count, next letters).

    A prefix's row is pre-aggregated by task; it holds at most as many letters as an alphabet has.
    """
    prefixes = words.select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("depth"))
    own = F.when(F.col("depth") == F.length("w"), F.col("n")).otherwise(0).alias("own")
    at = prefixes.select("depth", F.substring("w", F.lit(1), F.col("depth")).alias("node"), own, F.substring("w", F.col("depth") + 1, F.lit(1)).alias("next"))
    nodes = written(at.groupBy("depth", "node").agg(F.max("own").alias("own"), F.array_join(F.collect_set("next"), "").alias("letters")), "prefixes")
    kid = F.struct(F.right("node", F.lit(1)).alias("letter"), F.col("own").alias("n"), F.col("letters").alias("next"))
    edges = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.substring("node", F.lit(1), F.col("depth") - 1).alias("node")).agg(F.collect_list(kid).alias("kids"))
    return nodes.join(edges, ["depth", "node"], "left")


def edited(words: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """States (w, n, pos, node, m) that edit their word's letter at ``depth``; ``m`` is the count of the word that they end at, else null."""
    at = lambda k: F.substring("w", depth + k + 1, 1)
    fresh = words.where((F.col("first") <= depth) & (F.length("w") > depth))
    fresh = fresh.select("w", "n", F.substring("w", 1, depth).alias("node"), at(0).alias("a"), at(1).alias("b"), at(2).alias("c"), F.length("w").alias("z"))
    # Of a run of equal letters the last is dropped, in the order of the word.
    one_of_run = f"IF(startswith(w, '>'), a <> b, substring(w, {depth}, 1) <> a)"
    replaces = f"k.letter > a AND IF({depth + 1} = z, k.n > 0, instr(k.next, b) > 0)"
    drops = f"{depth + 1} < z AND k.letter = b AND {one_of_run} AND IF({depth + 2} = z, k.n > 0, instr(k.next, c) > 0)"
    kids = fresh.join(nodes.where("kids IS NOT NULL").select("node", "kids"), "node").select("w", "n", "node", "a", "b", "c", "z", F.explode("kids").alias("k"))
    moves = F.explode(F.expr(f"array_compact(array(IF({replaces}, {depth + 1}, NULL), IF({drops}, {depth + 2}, NULL)))")).alias("pos")
    led = kids.where(f"({replaces}) OR ({drops})").select("w", "n", "z", "node", "k", moves)
    return led.select("w", "n", "pos", F.concat("node", "k.letter").alias("node"), F.when(F.col("pos") == F.col("z"), F.col("k.n")).alias("m"))


def followed(states: DataFrame, below: DataFrame) -> DataFrame:
    """States with an edit after their word's next letter; ``below`` are the nodes one deeper. States that have ended stay."""
    letter = lambda k: F.expr(f"substring(w, pos + {k + 1}, 1)")
    ended = F.col("m").isNotNull()
    to = F.when(ended, F.concat(F.lit("!"), "w")).otherwise(F.concat("node", letter(0)))  # the ended match none, each on its own key
    met = states.withColumn("to", to).join(below.select(F.col("node").alias("to"), "own", "letters"), "to", "left")
    last = F.expr("pos + 1 = length(w)")
    on = F.when(last, F.col("own") > 0).otherwise(F.instr("letters", letter(1)) > 0)
    further = (F.col("pos") + 1).alias("pos")
    kept = met.where(ended | on)
    return kept.select("w", "n", F.when(ended, F.col("pos")).otherwise(further).alias("pos"), F.when(ended, F.col("node")).otherwise(F.col("to")).alias("node"), F.when(ended, F.col("m")).when(last, F.col("own")).alias("m"))


def neighbours(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """word, n, other, m: each pair of words up to ``levels`` letters that are one edit apart, once, with their counts."""
    lines = written(both_ways(words.where(F.length("word") <= levels)), "lines")
    nodes = written(trie(lines).repartition("depth", "node").sortWithinPartitions("depth"), "nodes")
    shape = lines.agg(F.min("first"), F.max(F.length("w"))).first()  # two numbers
    # A word without its last letter, where that is a word.
    cut = lines.where("first < length(w) AND (startswith(w, '>') OR right(w, 1) <> substring(w, -2, 1))").withColumn("node", F.expr("substring(w, 1, length(w) - 1)"))
    states = cut.join(lines.select(F.col("w").alias("node"), F.col("n").alias("m")), "node").select("w", "n", F.length("w").alias("pos"), "node", "m")
    for depth in range(shape[0] or 0, shape[1] or 0):
        level = lambda d: nodes.where(F.col("depth") == d).drop("depth")
        # What was edited before stands at nodes of this depth.
        states = followed(states, level(depth + 1)).unionByName(edited(lines, level(depth), depth))
        if (depth - shape[0]) % STRIDE == STRIDE - 1:
            states = written(states, f"frontier-{depth}")
    plain = lambda c: F.when(F.startswith(c, F.lit("<")), F.reverse(F.substring(c, 2, levels))).otherwise(F.substring(c, 2, levels))
    return states.where("m IS NOT NULL").select(plain(F.col("w")).alias("word"), "n", plain(F.col("node")).alias("other"), "m")


def _deletions(batches):
    """Of each word: hashes of itself (at -1) and of what is left without each letter; ``last`` unless its equal follows."""
    rng = np.random.default_rng(13)
    value = rng.integers(1, 2**63, 65536, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 2**64))
    for b in batches:
        for key, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a = np.frombuffer(w.encode("utf-16-le"), np.uint16)
            power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(a), base))])
            sums = np.concatenate([[np.uint64(0)], np.cumsum(value[a] * power[:-1])])
            left = sums[:-1] + (sums[-1] - sums[1:]) * inverse
            h = mix64(np.concatenate([sums[-1:], left])).view(np.int64)
            last = np.concatenate([[False], a[:-1] != a[1:], [True]])
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.int64()), pa.array(np.arange(-1, len(a)), pa.int32()), pa.array(h, pa.int64()), pa.array(last)], ["key", "at", "h", "last"])


def long_neighbours(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The pairs of ``neighbours`` of which a word is longer than ``levels`` letters."""
    long_words = written(words.where(F.length("word") >= levels).withColumn("key", F.xxhash64("word")), "long")
    cuts = written(long_words.select("key", "word").mapInArrow(_deletions, "key long, at int, h long, last boolean"), "cuts")
    whole = cuts.where("at < 0").select(F.col("key").alias("b"), "h")
    shorter = cuts.where("last").select(F.col("key").alias("a"), "h", "at").join(whole, "h")
    other = cuts.where("at >= 0").select(F.col("key").alias("b"), "h", "at")
    replaced = cuts.where("at >= 0").select(F.col("key").alias("a"), "h", "at").join(other, ["h", "at"]).where("a <> b")
    found = shorter.select("a", "b", "at", F.lit(0).alias("skip")).unionByName(replaced.select("a", "b", "at", F.lit(1).alias("skip")))
    side = lambda key, word, n: long_words.select(F.col("key").alias(key), F.col("word").alias(word), F.col("n").alias(n))
    full = found.join(side("a", "word", "n"), "a").join(side("b", "other", "m"), "b")
    left = F.expr("concat(substring(word, 1, at), substring(word, at + 2)) = IF(skip = 0, other, concat(substring(other, 1, at), substring(other, at + 2)))")
    once = F.expr(f"(skip = 0 OR word < other) AND greatest(length(word), length(other)) > {levels}")
    return full.where(left & once & (F.col("word") != F.col("other"))).select("word", "n", "other", "m")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every row of word and form: what following forms ends at, by pointer doubling."""
    to = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        to = written(to.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not to.where("moved").limit(1).count():
            return to.select("word", "root")
        to = to.select("word", "root")


def variants(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", modulus: int = MODULUS, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, levels: int = LEVELS
) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = written(count_words(docs, id_col, text, modulus, least_letters, least_count), "words")
    with scratch(docs.sparkSession):
        pairs = neighbours(words, levels).unionByName(long_neighbours(words, levels))
        both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
        # A word has at most a few times its length of neighbours for each letter of the alphabet.
        best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
        fits = -F.col("best.m") >= ratio * F.col("n")
        near = written(best.select("word", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "near", outlives=True)
    with scratch(docs.sparkSession):
        to = written(roots(near.where("form IS NOT NULL")), "root", outlives=True)
    out = words.join(near.join(to, "word", "left"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
