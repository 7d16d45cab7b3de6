from collections import Counter

from ledger import ledger, line
from ledgerloom.operators.quality import DROP, Rule, enforce, observe, quarantine, report
from ledgerloom.plans import postings
from ledgerloom.plans.rules import RULES

SAMPLE = [Rule("has_a", "a IS NOT NULL", DROP), Rule("small_b", "b < 10")]


def sample(spark):
    return spark.createDataFrame([(1, 5), (None, 50), (2, None), (3, 11)], "a int, b int")


def test_only_drop_rules_drop(spark):
    assert [tuple(r) for r in enforce(sample(spark), SAMPLE).collect()] == [(1, 5), (2, None), (3, 11)]


def test_unknown_counts_as_violation(spark):
    rows = report(sample(spark), SAMPLE, "t").collect()
    assert [tuple(r) for r in rows] == [("t", "has_a", "drop", 1), ("t", "small_b", "warn", 3)]


def test_counts_come_with_the_pass_that_writes(spark, tmp_path):
    counted, observation = observe(sample(spark), SAMPLE, "sample")
    enforce(counted, SAMPLE).write.parquet(str(tmp_path / "out"))
    assert observation.get == {"rows": 4, "has_a": 1, "small_b": 3}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_quarantine_names_the_failed_rules(spark):
    rows = quarantine(sample(spark), SAMPLE).collect()
    assert [(r["a"], r["failed_rules"]) for r in rows] == [
        (None, ["has_a", "small_b"]),
        (2, ["small_b"]),
        (3, ["small_b"]),
    ]


def test_number_of_rules():
    actions = Counter(rule.action for rules in RULES.values() for rule in rules)
    assert actions == {"drop": 13, "warn": 9}
    assert len(RULES) == 13


def test_malformed_year_is_counted_and_does_not_stop(spark):
    raw = ledger(spark, [line(GJAHR="20X4"), line(GJAHR=None), line(GJAHR="1999"), line()])
    counts = {r["rule_name"]: r["violations"] for r in postings.posting_report(raw).collect()}
    assert counts == {"document_key_not_null": 1, "valid_fiscal_year": 3, "company_code_not_null": 0}


def test_report_counts_rows_that_a_join_multiplies(spark):
    raw = ledger(
        spark,
        [line(RBUKRS=None, VTWEG="10"), line(RBUKRS=None, VTWEG=None)],
        tvtw=[{"VTWEG": "10", "VTEXT": "a"}, {"VTWEG": "10", "VTEXT": "b"}, {"VTWEG": "20"}],
        dim_pnl_line=[{"PNL_LINE_ID": "PL01", "PNL_LINE_NAME": name} for name in "xyz"],
    )
    counts = {r["rule_name"]: r["violations"] for r in postings.posting_report(raw).collect()}
    facts = postings.posting_rows(raw)
    assert facts.count() == 2 * 3 + 3
    assert counts["company_code_not_null"] == 9
