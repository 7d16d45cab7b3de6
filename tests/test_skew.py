"""The main queries on a ledger in which one document, account and customer hold a third of all lines."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from ledgerloom.operators.star import BROADCAST_KEY
from test_oracle import ORACLE, TABLES, canonical


@pytest.fixture(scope="module")
def skewed_dir(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("skewed")
    for table in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if table == "lineitem":
            hot, lost = F.pmod(F.hash(*df.columns), F.lit(3)) == 0, F.col("l_linenumber") == 5
            # Key 16 is a document of its year, an account with a line and, thus, a customer.
            year = F.to_timestamp_ntz(F.lit("2000-02-03"))
            df = df.select(
                *[
                    F.when(hot, 11 if c in ("l_partkey", "l_suppkey") else 16).otherwise(F.col(c)).cast("bigint").alias(c)
                    if c in ("l_orderkey", "l_partkey", "l_suppkey")
                    else F.when(hot, year).otherwise(F.col(c)).alias(c)
                    if c == "l_shipdate"
                    else F.col(c)
                    for c in df.columns
                ]
            ).withColumn("l_suppkey", F.when(~lost, F.col("l_suppkey")))
        if table == "orders":
            mine = F.when(F.col("o_orderkey") == 16, F.to_timestamp_ntz(F.lit("2000-02-01")))
            df = df.withColumn("o_orderdate", F.coalesce(mine, "o_orderdate"))
        df.write.parquet(f"{root}/{table}.parquet")
    return str(root)


@pytest.fixture
def shuffled_joins(spark):
    settings = {
        BROADCAST_KEY: "-1",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in list(settings)[:2]:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", ["postings_full", "pnl_mart", "pnl_mart_from_postings", "dq_report", "dim_account"])
def test_results_are_whole(spark, skewed_dir, shuffled_joins, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{skewed_dir}/{table}.parquet/*.parquet'")
    result = duck.execute(ORACLE[name])
    found = [c[0] for c in result.description]
    columns = sorted(found)
    order = [found.index(c) for c in columns]
    expected = Counter(tuple(canonical(row[i]) for i in order) for row in result.fetchall())
    actual = driver.queries()[name](spark, skewed_dir).select(*columns)
    assert Counter(tuple(canonical(v) for v in row) for row in actual.collect()) == expected
    if name == "postings_full":
        plan = actual._jdf.queryExecution().executedPlan().toString()
        assert all(f"__{side}_piece" in plan for side in ("bkpf", "kna1", "mara", "t001w", "csks", "ska1"))
