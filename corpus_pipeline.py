"""The corpus pipeline: documents in, tokenised documents out, a stage after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, decontaminate, langid, linededup, simhash
from ledgerloom.llm.common import forget_stored, let_workers_import, release, stored, stored_count, table
from ledgerloom.llm.queries import RANKS


def _begin(spark: SparkSession) -> None:
    """Workers can import the operators; what earlier stages sent to the executors goes, as their rows are stored by now."""
    release()
    let_workers_import(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters, or unlike any language learned, go."""
    _begin(spark)
    return langid.only_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but their first, and so do documents that lose every line."""
    _begin(spark)
    return linededup.without_recurring(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    _begin(spark)
    return simhash.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    _begin(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, as encoded and decoded again."""
    _begin(spark)
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("language", language), ("lines", lines), ("copies", copies), ("leaks", leaks), ("tokens", tokens)]

#: SQL expresses neither the language model, the fingerprints nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is stored in the shared folder and read by the next one.

    What a stage stored on its way, and the stage before, is removed once the stage is stored.
    """
    docs, since = table(spark, sf_dir, "documents"), stored_count()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        forget_stored(spark, since)
    return docs
