"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, chat, collocations, crosstoken, decontaminate, fingerprint, jaccard, langid, linededup, pii, quality, simhash, warc
from ledgerloom.llm.common import let_workers_import, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    ranks = public_tokenizers.path(RANKS)
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(turns.unionByName(chat.sample_attack(turns))))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return crosstoken.report(table(spark, sf_dir, "documents"), *paths)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_linededup, op2_warc, op3_simhash, op4_fingerprint, op5_bpe, op6_chat, op7_decontaminate, op8_langid, op9_quality, op10_pii]
    made += [op11_crosstoken, op12_collocations, op13_jaccard]
    return {query.__name__: query for query in made} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_linededup": linededup.ORACLE, "op2_warc": warc.ORACLE, "op6_chat": chat.ORACLE, "op12_collocations": collocations.ORACLE, "op13_jaccard": jaccard.ORACLE}
