"""A corpus-cleaning pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. The stages' own modules say what they
do with nulls, empty texts, ties and repeated rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octaspark.llm import bpe, decontam, langid, minhash, substring
from octaspark.llm.common import read, remove_folder, scratch, shared_folder
from octaspark.llm.queries import pattern, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, no letters) go."""
    return langid.keep_identified(docs, langid.train_on_folds(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the least id."""
    return minhash.drop_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated spans go, except in the first place; n_chars follows the text.

    A document of which nothing is left goes.
    """
    shorter = substring.remove_repeats(docs)
    n = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return shorter.withColumn("n_chars", n).where("text IS NULL OR trim(BOTH ' \t\r\n' FROM text) <> ''").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that match a benchmark item go."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text: doc_id, n_tokens and the digests of ids and decoded bytes."""
    return bpe.digest_documents(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: Near-duplicate components and byte-level BPE can't be written in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.

    What lies between the stages is written to the shared folder, and deleted when the next
    stage has read it; tables that a stage makes on its way are deleted when it is written.
    """
    docs = read(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
