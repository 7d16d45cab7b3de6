from decimal import Decimal

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from ledger import ledger, line
from ledgerloom.operators import star
from ledgerloom.operators.star import BROADCAST_KEY
from ledgerloom.plans import postings
from ledgerloom.plans.dimensions import dimension
from ledgerloom.sources.driver_tables import RawTables


def facts(spark, *journal, **tables):
    return postings.posting_rows(ledger(spark, list(journal), **tables))


def test_columns_and_types(spark):
    raw = ledger(spark, [line()])
    df = postings.postings(raw)
    assert df.columns == [*postings.COLUMNS, "silver_transformation_ts"]
    assert len(postings.COLUMNS) == 71
    types = dict(df.dtypes)
    assert {c for c, t in types.items() if t == "int"} == {
        "line_item_number", "fiscal_period", "pnl_sort_order", "pnl_sign",
    }
    assert {c for c, t in types.items() if t == "date"} == {"posting_date", "document_date"}
    assert sum(t == "decimal(18,2)" for t in types.values()) == 4
    assert types["fiscal_year"] == "string"
    row = df.first()
    assert (row["account_name"], row["document_type"], row["customer_name"]) == ("Account 400000", "RV", "Customer 1")


def test_lineage_follows_the_journal(spark):
    from ledgerloom.sources.landing import INGESTION_TS, SOURCE_FILE

    raw = ledger(spark, [line()])
    raw["acdoca"] = raw["acdoca"].selectExpr("*", f"now() AS {INGESTION_TS}", f"'f' AS {SOURCE_FILE}")
    raw["tspa"] = raw["tspa"].selectExpr("*", f"now() AS {INGESTION_TS}", f"'g' AS {SOURCE_FILE}")
    df = postings.postings(raw)
    assert len(df.columns) == 74
    assert df.first()["bronze_source_file"] == "f"


@pytest.mark.parametrize(
    ("account", "kind"),
    [("400000", "P&L"), ("100000", "BS"), ("900000", "OTHER"), ("699999", "P&L"), ("unknown", "OTHER")],
)
def test_account_type(spark, account, kind):
    row = facts(spark, line(RACCT=account)).first()
    assert row["account_type"] == kind


def test_rounding(spark):
    rows = facts(spark, line(KSL="12.345"), line(KSL="-12.345")).collect()
    assert [r["amount_group_currency"] for r in rows] == [Decimal("12.35"), Decimal("-12.35")]


def test_malformed_text(spark):
    raw = ledger(spark, [line(BUDAT="20240131")])
    with pytest.raises((PySparkException, Py4JError)):
        postings.posting_rows(raw).collect()
    assert postings.posting_rows(raw, lenient=True).first()["posting_date"] is None


def test_two_part_keys_need_both_parts(spark):
    row = facts(spark, line(RBUKRS="C2")).first()
    assert row["cost_center_id"] == "CC1" and row["cost_center_name"] is None
    assert row["profit_center_name"] is None and row["document_type"] is None


def test_document_key_is_needed(spark):
    raw = ledger(spark, [line(BELNR=None), line(GJAHR=None), line(RBUKRS=None)])
    assert postings.postings(raw).count() == 1
    assert postings.posting_rows(raw).count() == 3


def test_duplicate_keys_multiply_rows(spark):
    twice = [{"SPART": "01", "VTEXT": "a"}, {"SPART": "01", "VTEXT": "b"}]
    assert {r["division_name"] for r in facts(spark, line(), tspa=twice).collect()} == {"a", "b"}


def test_dropped_dimension_rows_still_enrich(spark):
    # The fact reads raw tables: a dimension's rules do not act on it.
    raw = ledger(spark, [line(VKORG="S9")], tvko=[{"VKORG": "S9"}, {"VTEXT": "no id"}])
    assert dimension("sales_org", raw).count() == 1
    assert postings.posting_rows(raw).count() == 1


def test_row_count_is_kept(spark, sf_dir):
    raw = RawTables(spark, sf_dir)
    assert postings.posting_rows(raw).count() == raw["acdoca"].count() == 6000


def test_matches_on_the_test_tables(spark, sf_dir):
    row = postings.posting_rows(RawTables(spark, sf_dir)).selectExpr(
        "count(document_type) AS header",
        "count(company_name) AS company",
        "count(pnl_line_id) AS line",
        "count_if(account_type = 'P&L') AS pl",
        "count_if(account_type = 'BS') AS bs",
        "count_if(account_type = 'OTHER') AS other",
        "count(material_name) AS material",
        "count(cost_center_name) AS cost_center",
        "count(plant_name) AS plant",
        "count_if(distribution_channel_id IS NULL) AS no_channel",
    )
    assert row.first().asDict() == {
        "header": 867, "company": 5988, "line": 5026, "pl": 5263, "bs": 479, "other": 258,
        "material": 5872, "cost_center": 5503, "plant": 6000, "no_channel": 1968,
    }


def test_joins_by_key_give_the_same_fact(spark, sf_dir):
    raw = RawTables(spark, sf_dir)
    broadcast = postings.postings(raw).drop("silver_transformation_ts")
    spark.conf.set(BROADCAST_KEY, "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = postings.postings(raw).drop("silver_transformation_ts")
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 13 and "Cartesian" not in plan
        assert "__kna1_piece" in plan
        rows = sorted(shuffled.collect(), key=str)
    finally:
        spark.conf.unset(BROADCAST_KEY)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == sorted(broadcast.collect(), key=str)


def test_lines_travel_with_what_they_share_side_by_side(spark, sf_dir):
    raw = RawTables(spark, sf_dir)
    lines = postings.journal_lines(raw["acdoca"])
    moved = postings.packed(lines)
    assert sorted(moved.columns) == sorted(lines.columns) and tuple(moved.columns[-len(postings.VARYING) :]) == postings.VARYING
    enriched = postings.enrich(lines, raw, ["bkpf"])
    assert enriched.columns == [*moved.columns, *postings.SIDES["bkpf"].columns]
    assert sorted(enriched.select(*lines.columns).collect(), key=str) == sorted(lines.collect(), key=str)


def test_small_tables_move_no_journal_rows(spark, sf_dir):
    raw = RawTables(spark, sf_dir)
    plan = postings.postings(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 13
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_violations_and_divisions_on_the_test_tables(spark, sf_dir):
    raw = RawTables(spark, sf_dir)
    counts = {r["rule_name"]: r["violations"] for r in postings.posting_report(raw).collect()}
    assert counts == {"document_key_not_null": 5, "valid_fiscal_year": 4362, "company_code_not_null": 12}
    known = raw["acdoca"].join(raw["tspa"], "SPART", "left_semi")
    assert known.count() == 4780


def test_hot_keys_are_looked_for_in_the_rows_named(spark, sf_dir, monkeypatch):
    raw = RawTables(spark, sf_dir)
    lines, seen = postings.journal_lines(raw["acdoca"]), []
    monkeypatch.setattr(star, "find_spread", lambda fact, sides, n, find=star.find_spread: seen.append(fact) or find(fact, sides, n))
    spark.conf.set(BROADCAST_KEY, "-1")
    try:
        joined = postings.enrich(lines, raw, ["bkpf"])
        rows = postings.enrich(joined.drop(*postings.SIDES["bkpf"].columns), raw, ["kna1", "mara"], keys=lines)
        assert any(fact is lines for fact in seen)
    finally:
        spark.conf.unset(BROADCAST_KEY)
    assert rows.count() == lines.count()
