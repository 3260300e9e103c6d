"""Operator 6: benchmark decontamination by canonical templates.

Texts and benchmark items become templates: numbers, names and units turn into typed
placeholders (neighbouring ones of a type into one), other words are lower-cased and
punctuation goes. Windows of ``WINDOW`` template words (fewer for a shorter item) are
hashed and joined. A document and an item match when enough of the item's windows occur
in the document and the slots agree: each value of an item's placeholder always
stands for the same value in the document, and different values for different ones.
That finds verbatim copies and questions with other numbers or names alike.

An item without such windows (a few words, or mostly numbers and names) is matched
verbatim instead: windows of its lower-cased words as they are. One of fewer than
``LEAST_VERBATIM`` words, which stand in any text, matches texts of just these words.

Windows reach the join only if their hash is one of the benchmark's. That set, and the
benchmark's side of the join, are broadcast while they hold at most
``BROADCAST_WINDOWS`` windows (about 30 MB), which is checked; beyond it all windows are shuffled to
an equi-join.

Defined results: null and empty texts, and items without a word,
match nothing. Items that repeat an id are separate items of that id. Rows that
repeat an id with the same text match as one. Null ids are kept as null.
Extra columns are ignored, or kept by ``drop_contaminated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octaspark.llm.common import WordHasher, cut_lineage, mix64

WINDOW, LEAST_WORDS, LEAST_LITERALS = 8, 5, 4
LEAST_VERBATIM = 3
#: Enough windows: this share of the item's, or so many.
COVER, MANY = 0.4, 24
BROADCAST_WINDOWS = 250_000

#: Alignments of an item's windows in a document that differ by no more belong to one occurrence.
SHIFT = 4

# Words for numbers (English, German, French, Spanish) and units.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million "
    "zwei drei vier fünf sechs sieben acht neun zehn zwölf zwanzig dreißig vierzig fünfzig hundert tausend million "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce veinte treinta cuarenta cincuenta cien mil millón"
).split()
UNIT_WORDS = (
    "mm cm m km in ft yd mi mg g kg lb oz ml l s ms min h hr hz khz mhz w kw v a j n pa k c f inch inches foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars cent cents euro euros percent degree degrees tag tage stunden minuten sekunden kilometer jahre monate wochen grad prozent jours heures minutes secondes kilomètres mètres ans mois semaines "
    "degrés pourcent días horas minutos segundos kilómetros metros años meses semanas grados"
).split()

_hasher = WordHasher(bytes(b for b in range(128) if not chr(b).isalnum()), seed=31)
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1111, 0x2222, 0x3333))
_number_words = np.sort(_hasher.words(" ".join(NUMBER_WORDS).encode())[0])
_unit_words = np.sort(_hasher.words(" ".join(UNIT_WORDS).encode())[0])
_digit = np.zeros(256, bool)
_digit[48:58] = True
_stop = np.zeros(256, bool)
_stop[list(b'.!?:;"\n')] = True
_BASE = 0x9FB21C651E98DF25


def template(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Template words as hashes, and the values of placeholders (0 for words)."""
    data = text.encode("utf-8", "surrogatepass")
    low = text.lower().encode("utf-8", "surrogatepass")
    h, low_start, end = _hasher.words(low)
    start = low_start
    if len(low) != len(data):  # some letter's lower case has another length: same words, other places
        _, start, end = _hasher.words(data)
    n = len(h)
    if not n:
        return h, h
    a, z = np.frombuffer(data, np.uint8), np.frombuffer(low, np.uint8)
    c = a[start]
    length = 1 + (c >= 0xC0).astype(np.int64) + (c >= 0xE0) + (c >= 0xF0)
    capital = np.zeros(n, bool)
    for k in range(4):  # the first letter's bytes
        capital |= (length > k) & (a[np.minimum(start + k, len(a) - 1)] != z[np.minimum(low_start + k, len(z) - 1)])
    stops = np.concatenate([[0], np.cumsum(_stop[a])])
    begins = np.ones(n, bool)
    begins[1:] = stops[start[1:]] > stops[end[:-1]]
    number = _digit[c] | np.isin(h, _number_words)
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & ~number[1:] & np.isin(h[1:], _unit_words)
    name = capital & ~begins & ~number & ~unit
    kind = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, np.uint64(0))))
    new = np.ones(n, bool)
    new[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1])
    at = np.flatnonzero(new)
    # A slot's value is its words in order.
    place = np.arange(n) - np.repeat(at, np.diff(np.concatenate([at, [n]])))
    own = mix64(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value = np.add.reduceat(np.where(kind != 0, own, np.uint64(0)), at)
    kind, h = kind[at], h[at]
    return np.where(kind != 0, kind, h), value


def windows(words: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each window with enough literal words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total, literal = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for j in range(size):
        total = total * np.uint64(_BASE) + words[j : j + n]
        literal += value[j : j + n] == 0
    at = np.flatnonzero(literal >= min(LEAST_LITERALS, size - 1))
    return at, mix64(total[at] + np.uint64(size)).view(np.int64)


def verbatim(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each window of ``size`` lower-cased words; below LEAST_VERBATIM only of the whole text."""
    words = _hasher.words(text.lower().encode("utf-8", "surrogatepass"))[0]
    n = len(words) - size + 1
    if n <= 0 or size < LEAST_VERBATIM and n > 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * np.uint64(_BASE) + words[j : j + n]
    return np.arange(n), mix64(total ^ np.uint64(size)).view(np.int64)


def item_windows(benchmark: DataFrame, id_col: str, text: str) -> DataFrame:
    """item, text_hash, size (negative if verbatim), n_windows, item_at, h and item_values of all windows of all items."""
    names = ["item", "item_hash", "size", "n_windows", "item_at", "h", "item_values"]

    def run(batches):
        for b in batches:
            rows = []
            for item, own, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                words, value = template(t or "")
                size = min(WINDOW, len(words))
                at, h = windows(words, value, size) if size >= LEAST_WORDS else (words[:0], words[:0])
                v = value.view(np.int64)
                if not len(at) and len(words):
                    size = min(WINDOW, len(_hasher.words(t.lower().encode("utf-8", "surrogatepass"))[0]))
                    at, h = verbatim(t, size)
                    rows += [(item, own, -size, len(at), int(p), int(x), []) for p, x in zip(at, h)]
                    continue
                rows += [(item, own, size, len(at), int(p), int(x), v[p : p + size].tolist()) for p, x in zip(at, h)]
            cols = list(zip(*rows)) or [[]] * 7
            types = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names)

    kind = benchmark.schema[id_col].dataType.simpleString()
    rows = benchmark.select(F.col(id_col).alias("item"), F.xxhash64(text).alias("own"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"item {kind}, item_hash long, size int, n_windows long, item_at int, h long, item_values array<long>")


def document_windows(docs: DataFrame, sizes: list[int], wanted: np.ndarray | None, id_col: str, text: str) -> DataFrame:
    """id, own, size, h and all places (at, values) of each distinct window of a document, if given only of hashes in ``wanted`` (sorted)."""
    place = pa.struct([("at", pa.int32()), ("values", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part, ids, cols = b.slice(lo, 512), [], [[], [], []]
                for k, t in enumerate(part.column(2).to_pylist()):
                    if not t:
                        continue
                    words, value = template(t)
                    v = value.view(np.int64)
                    for size in sizes:
                        at, h = windows(words, value, size) if size > 0 else verbatim(t, -size)
                        if wanted is not None and len(h):
                            near = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                            at, h = at[ok := wanted[near] == h], h[ok]
                        order = np.argsort(h, kind="stable")
                        for same in np.split(order, np.flatnonzero(np.diff(h[order])) + 1) if len(h) else ():
                            ids.append(k)
                            found = [{"at": int(p), "values": v[p : p + max(size, 0)].tolist()} for p in at[same]]
                            for c, x in zip(cols, (size, int(h[same[0]]), found)):
                                c.append(x)
                rows = pa.array(ids, pa.int64())
                types = (pa.int32(), pa.int64(), pa.list_(place))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *(pa.array(c, k) for c, k in zip(cols, types))], ["id", "own", "size", "h", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("own"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, own long, size int, h long, places array<struct<at:int,values:array<bigint>>>")


def _bound(matches: list[tuple]) -> tuple[int, int]:
    """Windows of the item that agree, and slot values that changed, of matches (item_at, at, item_values, values) in the item's order."""
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    met, changed = set(), set()
    for item_at, _, own, values in matches:
        pairs = [(x, y) for x, y in zip(own, values) if x or y]
        if all(there.get(x, y) == y and back.get(y, x) == x for x, y in pairs):
            there.update(pairs)
            back.update((y, x) for x, y in pairs)
            met.add(item_at)
            changed.update(x for x, y in pairs if x != y)
    return len(met), len(changed)


def slots_agree(shared: list[tuple[list, list]], needed: float = 0) -> tuple[int, int]:
    """How many of an item's windows occur with agreeing slots, and how many slot values changed.

    ``shared`` has, for each window that both have, its places in the document (at, values) and in the item (item_at,
    item_values). Windows are taken in the item's order; one whose slots contradict those taken before isn't
    counted. Each occurrence (places that lie in the document as in the item, up to ``SHIFT``) is judged on its own,
    and all together; the best counts. Of places in one occurrence that have the same values only the first matters. So
    what is held at a time grows with the document and the item, not with the product of places of a window that
    both repeat. Occurrences with fewer than ``needed`` windows, which can't match, aren't judged.
    """
    rows = []
    for places, own in shared:
        kinds: dict[tuple, int] = {}
        at = sorted((p["at"], kinds.setdefault(tuple(p["values"]), len(kinds))) for p in places)
        rows.append((np.array([a for a, _ in at], np.int64), np.array([k for _, k in at], np.int64), list(kinds), [(w["item_at"], w["item_values"]) for w in own]))
    low = min(int(a[0]) - w[0] for a, _, _, own in rows for w in own)
    high = max(int(a[-1]) - w[0] for a, _, _, own in rows for w in own)
    present = np.zeros(high - low + 1, bool)
    for a, _, _, own in rows:
        for item_at, _ in own:
            present[a - item_at - low] = True
    there = np.flatnonzero(present)
    group = np.zeros(len(present), np.int32)
    group[there] = np.concatenate([[0], np.cumsum(np.diff(there) > SHIFT)])

    def collected(by_group: bool) -> list[np.ndarray]:
        """group, item_at, first place, row, number in the row's own places, kind of values."""
        out = []
        for r, (a, kind, kinds, own) in enumerate(rows):
            for k, (item_at, _) in enumerate(own):
                g = group[a - item_at - low].astype(np.int64) if by_group else np.zeros(len(a), np.int64)
                key, first = np.unique(g * len(kinds) + kind, return_index=True)
                out.append(np.stack([key // len(kinds), np.full(len(key), item_at), a[first], np.full(len(key), r), np.full(len(key), k), key % len(kinds)]))
        found = np.concatenate(out, 1)
        return found[:, np.lexsort((found[2], found[1], found[0]))]

    def judged(found: np.ndarray) -> tuple[int, int]:
        return _bound([(item_at, at, rows[r][3][k][1], rows[r][2][kind]) for _, item_at, at, r, k, kind in found.T.tolist()])

    found = collected(True)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(found[0])) + 1, [found.shape[1]]])
    best = (0, 0)
    for a, b in zip(cuts, cuts[1:]):
        most = 1 + int((np.diff(found[1, a:b]) > 0).sum())
        if most >= needed and most >= best[0]:
            best = max(best, judged(found[:, a:b]), key=lambda x: (x[0], -x[1]))
    if len(cuts) > 2:
        best = max(best, judged(collected(False)), key=lambda x: (x[0], -x[1]))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of document and item that match: ids, n_matched, n_windows, coverage, slots_changed.

    A document and an item meet once for each distinct window that both have, whatever its places.
    """
    by_item = item_windows(benchmark, item_col, item_text).groupBy("item", "item_hash", "size", "n_windows", "h")
    items = cut_lineage(by_item.agg(F.array_sort(F.collect_set(F.struct("item_at", "item_values"))).alias("own_places")))
    n = items.agg(F.coalesce(F.sum(F.size("own_places")), F.lit(0))).first()[0]
    wanted, right = None, items
    if n <= BROADCAST_WINDOWS:
        found = items.select("h").distinct().toPandas()["h"].to_numpy(np.int64)
        wanted = np.sort(found)
        right = F.broadcast(items)
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # 2 * WINDOW values at most
    if not sizes:
        wanted = np.zeros(1, np.int64)
    left = document_windows(docs, sizes, wanted, id_col, text)
    joined = left.join(right, ["size", "h"])
    matches = joined.groupBy("id", "own", "item", "item_hash").agg(
        F.max("n_windows").alias("n_windows"), F.sum(F.size("own_places")).alias("most"), F.collect_set(F.struct("places", "own_places")).alias("shared")
    )
    enough = matches.where(F.col("most") >= F.least(F.ceil(COVER * F.col("n_windows")), F.lit(MANY)))
    names = [id_col, item_col, "n_matched", "n_windows", "coverage", "slots_changed"]

    def judge(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part, keep, rows = b.slice(lo, 64), [], []
                for k in range(part.num_rows):
                    total = part.column(2)[k].as_py()
                    needed = min(COVER * total, MANY)
                    met, changed = slots_agree([(m["places"], m["own_places"]) for m in part.column(3)[k].as_py()], needed)
                    if met >= needed:
                        keep.append(k)
                        rows.append((met, total, met / total, changed))
                at = pa.array(keep, pa.int64())
                cols = list(zip(*rows)) or [[]] * 4
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, n_matched long, n_windows long, coverage double, slots_changed long"
    return enough.select("id", "item", "n_windows", "shared").mapInArrow(judge, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that match an item; rows with a null id stay."""
    found = cut_lineage(contaminated(docs, benchmark, id_col, text).select(id_col).distinct())
    return docs.join(found, id_col, "left_anti").select(docs.columns)
