from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.star import (
    BROADCAST_KEY,
    Side,
    Spread,
    attach,
    duplicated_sides,
    find_spread,
    measured_bytes,
    star,
)


@pytest.fixture
def no_broadcast(spark):
    """A session in which nothing is small enough to broadcast."""
    spark.conf.set(BROADCAST_KEY, "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset(BROADCAST_KEY)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def fact(spark):
    # A third of the rows share one key and a third have none.
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None))
    return spark.range(0, 30_000, numPartitions=6).select(
        "id", key.otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), (F.col("id") % 2).alias("j")
    )


@pytest.fixture(scope="module")
def dim(spark):
    rows = [("hot", 0, "h0"), ("hot", 1, "h1"), ("absent", 0, "x"), (None, 0, "none")]
    rows += [(f"k{n}", n % 2, f"v{n}") for n in range(2, 450)]
    rows += [("k2", 0, "again")]
    return spark.createDataFrame(rows, "dk string, dj int, v string")


ONE = Side("one", {"k": "dk"}, {"v": "v"})
TWO = Side("two", {"k": "dk", "j": "dj"}, {"w": "v"})


def rows(df):
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


def plain(fact, dim, side):
    on = [F.col(a) == F.col(b) for a, b in side.on.items()]
    carried = [F.col(c).alias(n) for n, c in side.columns.items()]
    keys = list(side.on.values())
    return fact.join(dim.select(*keys, *carried), on, side.how).drop(*keys)


@pytest.mark.parametrize("side", [ONE, TWO, ONE.required(), TWO.required()], ids=["left-1", "left-2", "inner-1", "inner-2"])
def test_every_way_of_joining_gives_the_same_rows(spark, fact, dim, no_broadcast, side):
    expected = rows(plain(fact, dim, side))
    projected = side.project(dim)
    spread = find_spread(fact, [side], 30)[side.name]
    assert spread.hot and spread.missing > 1
    assert rows(attach(fact, projected, side)) == expected
    assert rows(attach(fact, projected, side, hint="broadcast")) == expected
    assert rows(attach(fact, projected, side, spread=spread, spread_by=["id"])) == expected
    assert rows(attach(fact, projected, side, spread=Spread({}, 5), spread_by=["id"])) == expected
    assert rows(star(fact, [(side, dim)], ["id"])) == expected


def test_hot_and_missing_keys_are_found(spark, fact):
    spread = find_spread(fact, [ONE, TWO], 60)
    assert spread["one"].hot == {"hot": 20} and spread["one"].missing == 20
    assert spread["two"].hot == {"hot\x1f0": 10, "hot\x1f1": 10}


def test_no_fact_no_spread(spark, fact, dim):
    assert not find_spread(fact.limit(0), [ONE], 8)["one"]
    assert rows(star(fact.limit(0), [(ONE, dim)], ["id"])) == Counter()


def test_spread_rows_share_the_work(spark, fact, dim, no_broadcast, many_partitions):
    """No partition of the join holds much more than its part, though one key has a third of the rows."""
    sizes = {}
    for name, joined in {
        "plain": attach(fact, ONE.project(dim), ONE),
        "spread": star(fact, [(ONE, dim)], ["id"]),
    }.items():
        per_task = joined.groupBy(F.spark_partition_id()).count().collect()
        sizes[name] = max(r["count"] for r in per_task)
    # Hot rows match two dimension rows: 40,000 rows in 30 partitions.
    assert sizes["plain"] >= 20_000
    assert sizes["spread"] <= 9_000


def test_large_sides_are_joined_by_key_and_piece(spark, fact, dim, no_broadcast, many_partitions):
    plan = star(fact, [(ONE, dim)], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    left_shuffle = [text for text in plan.splitlines() if "Exchange hashpartitioning(k#" in text]
    assert left_shuffle and all("__one_piece#" in text for text in left_shuffle)


def test_small_sides_are_broadcast(spark, fact, dim):
    sides = [replace(side, bounded=True) for side in (ONE, TWO)]
    plan = star(fact, [(side, dim) for side in sides])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_derived_tables_are_measured(spark, fact):
    # Catalyst estimates a distinct by its input, far above what is left of it.
    wide = spark.range(3_000_000).select((F.col("id") % 7).cast("string").alias("dk"), F.lit("v").alias("v"))
    side = Side("seven", {"k": "dk"}, {"v": "v"}, bounded=True)
    plan = star(fact, [(side, wide.distinct())])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert measured_bytes({"seven": wide.distinct()})["seven"] < 1_000
    assert measured_bytes({"none": wide.limit(0)}) == {"none": 0}


def test_duplicated_keys(spark, dim):
    unique = dim.filter("v <> 'again'")
    assert duplicated_sides([(ONE, dim), (TWO, unique)]) == {"one"}
    assert duplicated_sides([]) == set()
