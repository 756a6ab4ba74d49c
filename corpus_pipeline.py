"""The corpus pipeline: five stages over ``documents``, each a Parquet table for the next.

Defined cases, the same in every stage but the last: other columns may have any names and stay; ids may be null and repeat, as
rows have keys of their own; texts of any length are read whole; an empty table stays empty, with its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from lattiq.llm.common import Scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the classifier learns from labelled rows outside every fifth fold.

    Null texts, texts without a letter and texts without a known n-gram go; without labels all go.  Ties between languages do
    not matter here, and repeated rows stay or go together.
    """
    return language_id.keep_identified(docs, language_id.fit(docs.where(~language_id.held_out(F.col("doc_id")))))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered, null as empty) one row stays: that with the largest id, or any of them if that is repeated."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id (null is the largest); texts without words all stay."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each pass over a source that takes words of a document.

    Texts without words go; a null source is one of its own; repeated rows are taken each by itself.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text with their digests, a row for each row; decoding gives the text back.  A null text is empty."""
    return bpe.bpe_digests(docs, bpe.default_path(), with_ids=True)


STAGES = [("language_id", identify), ("exact_dedup", drop_exact), ("ngram_join", drop_near), ("mixing", mix), ("bpe", encode)]
#: BPE encoding and the learnt language filter have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name, "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
