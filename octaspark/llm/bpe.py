"""Operator 3: byte-level BPE by a sentencepiece model built from the ranks.

``build_model`` serialises a sentencepiece BPE model directly from a rank table:
every token's bytes are mapped to printable characters, one piece each, scored by the
negative rank, with identity normalisation and no white-space handling. sentencepiece
joins the adjacent pair with the highest score first, leftmost among equals, which is
the rank order of byte-level BPE. A pre-token that is a vocabulary entry as a whole
is that entry, as in the tiktoken library, even if merges would not reach it.

Texts are cut into pre-tokens by a pattern; each distinct pre-token is encoded once
per worker memory, each apart. Short ones are remembered, up to ``REMEMBERED_BYTES``. Decoding maps a document's
ids back to bytes, one by one.

Defined results: null text counts as empty and has no ids. Lone surrogates, which no
Spark string holds, are not expected. Equal texts get equal results. Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from octaspark.llm.common import chunks

#: What a worker's memory of pre-tokens may take; beyond it the memory is emptied and filled anew. Longer ones are never kept.
REMEMBERED_BYTES, LONGEST_KEPT = 64 << 20, 64
#: Of an entry beside its texts: its place in the table.
ENTRY_BYTES = 110
#: Characters whose new pre-tokens are encoded together.
BATCH_CHARS = 2 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte value: itself where it prints, else 256 and up."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in prints)
    other = {b: chr(256 + i) for i, b in enumerate(rest)}
    return [other.get(b, chr(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def build_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model; piece 0 is unknown, then the tokens by rank."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    proto = pb.ModelProto()
    proto.pieces.add(piece="<unk>", score=0.0, type=2)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        proto.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank), type=1)
    proto.trainer_spec.model_type = 2
    proto.trainer_spec.vocab_size = len(proto.pieces)
    proto.trainer_spec.unk_id, proto.trainer_spec.bos_id = 0, -1
    proto.trainer_spec.eos_id, proto.trainer_spec.pad_id = -1, -1
    spec = proto.normalizer_spec
    spec.name, spec.precompiled_charsmap = "identity", b""
    spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
    return proto.SerializeToString()


#: The usual byte-level pattern, and the same for Python's faster ``re``. The two agree on
#: texts whose characters are all in Splitter.plain.
MULTI_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = r" ?[^\W\d_]++| ?\d++|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s+"


class Splitter:
    """Cuts a text into the matches of a pattern."""

    def __init__(self, pattern: str):
        import regex

        self.general = regex.compile(pattern).findall
        self.plain = self.odd = None
        if pattern == MULTI_PATTERN:
            kinds = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
            pairs = [(regex.compile(a).match, re.compile(b).match) for a, b in kinds]
            same = [c for c in map(chr, range(0x3000)) if all(bool(a(c)) == bool(b(c)) for a, b in pairs)]
            self.plain = re.compile(PLAIN_PATTERN).findall
            self.odd = re.compile("[^" + re.escape("".join(same)) + "]").search

    def __call__(self, text: str) -> list[str]:
        if self.plain and (not self.odd(text)):
            return self.plain(text)
        return self.general(text)


class ByteBPE:
    """Encodes and decodes; remembers the ids of short pre-tokens it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece as spm

        self.processor = spm.SentencePieceProcessor(model_proto=build_model(ranks))
        self.split = Splitter(pattern)
        self.ranks = ranks
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.decimal = [""] + [str(i) for _, i in by_rank]  # of each piece: its id as a decimal
        self.bytes_of = {str(i): t for t, i in ranks.items()}  # of an id as a decimal
        self.table = dict(enumerate(byte_characters()))
        self.ids: dict[str, str] = {}  # of a pre-token, as decimals joined by commas
        self.held = 0  # bytes of what is remembered, about

    def _learn(self, tokens: set[str]) -> list[str]:
        """Finds the ids of tokens that aren't known, and tells which those are."""
        ids, hard = self.ids, []
        new = [t for t in tokens if t not in ids]
        for t in new:
            rank = self.ranks.get(t.encode("utf-8"))
            if rank is None:
                hard.append(t)
            else:
                ids[t] = str(rank)
        blank, table = self.table[32], self.table
        mapped = [t.replace(" ", blank) if t.isascii() and t.isprintable() else t.encode("utf-8").decode("latin-1").translate(table) for t in hard]
        decimal = self.decimal.__getitem__
        for t, pieces in zip(hard, self.processor.encode(mapped, num_threads=1)):
            ids[t] = ",".join(map(decimal, pieces))
        return new

    def _forget(self, new: list[str]) -> None:
        ids = self.ids
        for t in new:
            if len(t) > LONGEST_KEPT:
                del ids[t]
            else:
                self.held += sys.getsizeof(t) + sys.getsizeof(ids[t]) + ENTRY_BYTES
        if self.held > REMEMBERED_BYTES:
            ids.clear()
            self.held = 0

    def ids_of(self, texts: list[str | None]) -> list[str]:
        """The ids of each text, as decimals joined by commas."""
        cut = [self.split(t) if t else [] for t in texts]
        new = self._learn(set().union(*cut))
        out = [",".join(map(self.ids.__getitem__, tokens)) for tokens in cut]
        self._forget(new)
        return out

    def encode(self, text: str | None) -> list[int]:
        ids = self.ids_of([text])[0]
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, map(str, ids)))

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, sha256 of the joined ids and of what these ids decode to, of each text."""
        out = []
        for ids in self.ids_of(texts):
            each = ids.split(",") if ids else []
            back = b"".join(map(self.bytes_of.__getitem__, each))
            out.append((len(each), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    """One per Python worker."""
    return ByteBPE(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and the ids of the whole text."""

    def run(batches):
        bpe = codec(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """id and the decoded bytes."""

    def run(batches):
        bpe = codec(ranks_path, pattern)
        for b in batches:
            out = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: encode, digest and decode in one pass."""

    def run(batches):
        bpe = codec(ranks_path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [x for part in chunks([len(t or "") for t in texts], BATCH_CHARS) for x in bpe.digests(texts[part])]
            n, a, d = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
