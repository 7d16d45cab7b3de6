"""Rejection limits of a language with few rows beside one with many."""

from pyspark.sql import functions as F

from ledgerloom.llm import langid


def test_a_rare_language_has_limits_too(spark):
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.format_string("the river ran to mill %s", F.hex("id")).alias("text"))
    ids = spark.range(100_000, 100_100).select(F.col("id").alias("doc_id"))
    # One that is learned from, and that every second row, by hash, would leave out.
    rare = ids.filter(langid.learns(ids) & (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)).limit(1)
    rare = rare.select("doc_id", F.lit("xx").alias("lang"), F.lit("qzj vwk zzq jjv kwq " * 10).alias("text"))
    model = langid.fit(many.unionByName(rare))
    assert set(model.limits) == set(model.languages) == {"en", "xx"}
    assert all(x < float("inf") for limits in model.limits.values() for x in limits)
    assert all(a >= b for a, b in zip(model.limits["xx"][1:], model.limits["en"][1:], strict=True))
