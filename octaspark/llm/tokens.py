"""Operator 10: token counts of a sentencepiece BPE model, lengths only.

Texts reach Python in Arrow batches. They are regrouped into batches of about
``BATCH_BYTES``, cut into units at safe boundaries, and only units that the worker
doesn't remember are encoded, all of a batch in one call. Short units are remembered, up to ``REMEMBERED_BYTES``. A boundary before white
space is safe when no piece of the vocabulary holds the white-space mark after
another character (checked when the model is loaded; otherwise whole texts are
encoded). A unit longer than ``LONG_UNIT`` is cut further, between two characters
that stand side by side in no piece.

Defined results: null and empty text have no tokens. Equal texts have equal counts.
Rows with a null id are counted like others. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame

from octaspark.llm.common import chunks

BATCH_BYTES = 4 << 20
LONG_UNIT = 4096
#: What a worker's memory of units may take; beyond it the memory is emptied and filled anew. Longer units are never kept.
REMEMBERED_BYTES, LONGEST_KEPT = 96 << 20, 48
LIMIT = 4096
MARK = "▁"
#: Of an entry beside its text: its place in the table and its number.
ENTRY_BYTES = 140
_UNIT = re.compile(" +[^ ]*")


class PieceCounter:
    """Counts tokens with a sentencepiece model, remembering short units."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.whole = spm.SentencePieceProcessor(model_file=path)
        pieces = [p.piece for p in proto.pieces if p.type in (1, 4, 5)]
        spec = proto.normalizer_spec
        self.splits = (
            proto.trainer_spec.model_type == 2
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and not spec.precompiled_charsmap
            and not spec.remove_extra_whitespaces
            and spec.escape_whitespaces
            and not any(MARK in p.lstrip(MARK) for p in pieces)
            and not any(p.type in (4, 5) for p in proto.pieces)
        )
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        proto.normalizer_spec.add_dummy_prefix = False
        self.bare = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.seen: dict[str, int] = {}
        self.held = 0  # bytes of what is remembered, about

    def units(self, text: str) -> list[str]:
        """Units whose token counts add up to the text's."""
        if not text:
            return []
        text = (" " if self.prefix else "") + text.replace(MARK, " ")
        if text[0] == " " and "  " not in text and text[-1] != " ":
            parts = text[1:].split(" ")  # the blank before each is put back in count()
        else:
            head = len(text) - len(text.lstrip(" "))
            first = text[: text.find(" ")] if head == 0 and " " in text else ("" if head else text)
            parts = [x[1:] for x in _UNIT.findall(text)]
            if first:
                return ["\0" + first, *parts]
        return parts

    def _cut(self, unit: str) -> list[str]:
        out, at = [], 0
        for i in range(1, len(unit)):
            if i - at >= LONG_UNIT // 4 and unit[i - 1 : i + 1].replace(" ", MARK) not in self.pairs:
                out.append(unit[at:i])
                at = i
        return [*out, unit[at:]]

    def _encode(self, units: list[str]) -> list[int]:
        texts, of = [], []
        for k, u in enumerate(units):
            full = u[1:] if u[:1] == "\0" else " " + u
            for part in self._cut(full) if len(full) > LONG_UNIT else [full]:
                texts.append(part)
                of.append(k)
        out = [0] * len(units)
        for k, ids in zip(of, self.bare.encode(texts, num_threads=1)):
            out[k] += len(ids)
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        if not self.splits or any(t and "\0" in t for t in texts):
            return [len(x) for x in self.whole.encode([t or "" for t in texts], num_threads=1)]
        per_text = [self.units(t or "") for t in texts]
        seen = self.seen
        new = list({u for us in per_text for u in us if u not in seen})
        seen.update(zip(new, self._encode(new)))
        out = [sum(map(seen.__getitem__, us)) for us in per_text]
        for u in new:
            if len(u) > LONGEST_KEPT:
                del seen[u]
            else:
                self.held += sys.getsizeof(u) + ENTRY_BYTES
        if self.held > REMEMBERED_BYTES:
            seen.clear()
            self.held = 0
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One per Python worker."""
    return PieceCounter(path)


@functools.lru_cache(maxsize=2)
def library_counter(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row.

    ``model_path`` names a sentencepiece ``.model`` or a ``.json`` of the tokenizers
    library, present on every worker.
    """

    def lengths(texts: list[str | None]) -> list[int]:
        if model_path.endswith(".json"):
            return [len(e.ids) for e in library_counter(model_path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        return counter(model_path).count(texts)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            n_tokens: list[int] = []
            for part in chunks(n_bytes, BATCH_BYTES):
                n_tokens += lengths(texts[part])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
