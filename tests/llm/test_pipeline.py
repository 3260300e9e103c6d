import hashlib

import corpus_pipeline
import public_tokenizers as P
import tiktoken

from octaspark.llm import bpe
from tests.llm.test_decontam import brute_pairs as contaminated
from tests.llm.test_minhash import brute as components
from tests.llm.test_substring import brute as without_repeats


def test_pipeline_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs = {i: t for i, t in docs.items() if any(c.isalpha() for c in t)}
    docs = {i: docs[i] for i, (_, root) in components(docs.items()).items() if root == i}
    docs = {i: t for i, t in without_repeats(docs.items()).items() if t.strip()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    sure = {i: t for i, t in docs.items() if not any(b in t for b in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    missing = [(i, docs[i]) for i in sorted(set(sure) - set(got))]  # items with other numbers or names, or a word changed
    assert set(got) <= set(sure) and {i for i, _ in contaminated(missing, list(enumerate(items)))} == {i for i, _ in missing} and len(missing) <= 3
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        ids = library.encode_ordinary(docs[i])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[i].encode()).hexdigest()


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "byte_bpe"]


def test_odd_rows(spark, make_docs, tmp_path):
    """Nulls, empty texts, repeated rows and extra columns with clashing names go through all stages; so does an empty table."""
    from tests.llm.conftest import ODD

    story = "The river ran under a bridge near our old house. We took bread and cheese along that morning. Nobody spoke until the sun was high."
    rows = [*ODD, (20, story), (21, story), (22, story.upper()), (20, story), (None, None)]
    make_docs(rows, extra=["key", "_row", "h", "reach"]).write.parquet(f"{tmp_path}/some/documents.parquet")
    make_docs(rows, extra=["key"]).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("some", "none"):
        spark.createDataFrame([(1, None), (2, ""), (3, "One sentence. Another one! A third? And a fourth here.")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = sorted((r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()), key=str)
    # No letters: 1 to 4. Copies: 7 of 6, 21 and 22 of 20. Benchmark: 11.
    assert got == sorted([5, 6, 8, 9, 10, 20, None], key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
