"""Operators 3 and 10 against the libraries themselves."""

import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece as spm
import tiktoken

from octaspark.llm import bpe, tokens
from tests.llm.conftest import ODD

PARTS = ["a", "b", "the", " ", "  ", "▁", "\n", "é", "\t", "ß", "x.", "\0", "日", "🙂", "<s>", "<|endoftext|>", "'s", "12", "½", "²", "ا", "_", "\x1c", "\x85", "\xa0", "٣"]


def odd_texts(n=1500, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["", " ", "x" * 9000, " " * 3000, "ab" * 8000, "日本" * 6000, "a b  c   d " * 50]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return spm.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_bpe_equals_the_library(reference, texts):
    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for t in [*odd_texts(), *texts.values()]:
        ids = codec.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_takes_whole_tokens_that_merges_miss():
    # 'abc' can't be reached by merges: neither 'ab' nor 'bc' is a token.
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    codec = bpe.ByteBPE(ranks, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ("abc", "abcd", " abc", "xabc abc"):
        assert codec.encode(t) == library.encode_ordinary(t)


def test_bpe_forgets_without_harm(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 4000)
    codec = bpe.ByteBPE(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    for t in odd_texts(200, 2):
        assert codec.encode(t) == reference.encode_ordinary(t)


def test_bpe_documents(make_docs, reference):
    docs, path = make_docs(ODD, extra=["ids", "n_tokens"]), P.path("byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: r for r in bpe.digest_documents(docs, path, P.PATTERN).collect()}
    for i, t in ODD:
        ids = reference.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode_documents(docs, path, P.PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(encoded, path, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in ODD}
    assert bpe.digest_documents(docs.limit(0), path, P.PATTERN).count() == 0


def test_counts_equal_the_library(pieces, texts):
    counter = tokens.PieceCounter(P.path("piece_bpe_32k.model"))
    assert counter.splits
    some = [*odd_texts(), *texts.values()]
    want = [len(x) for x in pieces.encode(some)]
    assert [counter.count([t])[0] for t in some] == want
    assert counter.count(some) == want


def test_counts_forget_without_harm(monkeypatch, pieces):
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 2000)
    counter = tokens.PieceCounter(P.path("piece_bpe_32k.model"))
    for t in odd_texts(150, 3):
        assert counter.count([t, t]) == [len(pieces.encode(t))] * 2


def test_count_documents(make_docs, pieces):
    docs = make_docs(ODD, extra=["n_bytes"])
    got = {r.doc_id: r for r in tokens.count_tokens(docs, P.path("piece_bpe_32k.model")).collect()}
    for i, t in ODD:
        n = len(pieces.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    other = tokens.count_tokens(docs, P.path("byte_bpe_50k.json"))
    assert other.where("doc_id = 2").first().n_tokens == 0
    assert tokens.count_tokens(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def deep_size(memory):
    import sys

    return sys.getsizeof(memory) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in memory.items())


def odd_units(seed):
    """Texts without blanks, long words, and very many short words."""
    rng = random.Random(seed)
    letters = [chr(0x4E00 + k) for k in range(3000)]
    yield from ("".join(rng.choices(letters, k=3000)) for _ in range(60))
    yield from ("".join(rng.choices("abcdefgh/+", k=20_000)) for _ in range(20))
    yield from (" ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(3000)) for _ in range(60))


def test_what_workers_remember_is_bounded_by_bytes(monkeypatch):
    bound = 1 << 20
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", bound)
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", bound)
    path = P.path("piece_bpe_32k.model")
    counter, library = tokens.PieceCounter(path), spm.SentencePieceProcessor(model_file=path)
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    codec, other = bpe.ByteBPE(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    emptied = 0
    for k, text in enumerate(odd_units(1)):
        assert counter.count([text, text]) == [len(library.encode(text))] * 2
        assert codec.encode(text) == other.encode_ordinary(text)
        assert deep_size(counter.seen) < 1.3 * bound and deep_size(codec.ids) < 1.3 * bound
        assert max(map(len, counter.seen), default=0) <= tokens.LONGEST_KEPT and max(map(len, codec.ids), default=0) <= bpe.LONGEST_KEPT
        emptied += not counter.seen
        if k == 79:
            assert not counter.seen  # nothing but long units so far
    assert emptied > 80  # the short ones filled the memory more than once


def test_ids_are_what_is_decoded(monkeypatch):
    """Digests of decoded bytes come from the document's ids: another byte for one id changes them."""
    codec = bpe.ByteBPE(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    before = codec.digests(["a small text"])
    codec.bytes_of[str(codec.encode("a small text")[1])] = b"?"
    after = codec.digests(["a small text"])
    assert before[0][:2] == after[0][:2] and before[0][2] != after[0][2]
