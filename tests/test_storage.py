import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledger import ledger, line
from ledgerloom.plans import clustered, keys, layers, pnl, postings, repairs
from ledgerloom.plans.postings import SIDES
from ledgerloom.plans.rules import RULES
from ledgerloom.sources import landing, scratch
from test_layers import job, land_all  # noqa: F401


def test_filters_skip_files(spark, tmp_path):
    rows = spark.range(8000).selectExpr("cast(2000 + id % 8 AS string) AS y", "concat('C', id % 5) AS c", "id")
    rows = rows.unionByName(spark.range(4000).selectExpr("'2004' AS y", "'C1' AS c", "id")).unionByName(spark.range(3).selectExpr("NULL AS y", "'C1' AS c", "id"))
    folder = str(tmp_path / "clustered")
    clustered.write_clustered(rows, folder, ["y", "c"], files=16)
    every = clustered.files_with(spark, folder, ["y", "c"], {})
    for wanted in ({"y": ["2003"]}, {"y": ["2004"], "c": ["C1"]}, {"y": [None]}, {"y": ["1999"]}, {"c": ["C2"], "y": ["2000", "2007"]}):
        read = clustered.read_clustered(spark, folder, ["y", "c"], wanted)
        assert len(read.inputFiles()) < len(every) == 16
        same = rows
        for column, values in wanted.items():
            same = same.filter(F.col(column).isin([v for v in values if v]) | (F.col(column).isNull() if None in values else F.lit(False)))
        assert sorted(map(str, read.collect())) == sorted(map(str, same.collect()))
    # The frequent value fills several files.
    assert len(clustered.files_with(spark, folder, ["y", "c"], {"y": ["2004"], "c": ["C1"]})) > 2


def test_corrected_rows_are_taken_back_once(spark, job):  # noqa: F811
    rules = RULES[postings.FACT]
    journal = postings.journal_lines(ledger(spark, [line(BELNR=None, BUZEI="1"), line(BELNR=None, BUZEI="2"), line(BUZEI="3")])["acdoca"])
    for _ in range(2):
        repairs.set_aside(spark, job, "journal", journal, rules, "load-1")
    waiting = repairs.set_aside_rows(spark, job, "journal")
    assert sorted((r.line_item_number, r._failed_rules) for r in waiting.collect()) == [(1, ["document_key_not_null"]), (2, ["document_key_not_null"])]
    corrected = waiting.filter("line_item_number = 1").withColumn("document_number", F.lit("77")).select(*journal.columns, repairs.ID)
    still_broken = waiting.filter("line_item_number = 2").select(*journal.columns, repairs.ID)
    unknown = corrected.withColumn(repairs.ID, F.lit("load-1/none"))
    sent = corrected.unionByName(corrected).unionByName(still_broken).unionByName(unknown)
    for _ in range(2):
        repairs.take_back(spark, job, "journal", sent, rules)
        rows = repairs.repaired(spark, job, "journal", journal, rules)
        assert sorted((r.line_item_number, r.document_number) for r in rows.collect()) == [(1, "77"), (3, "0000000001")]
    assert [r.line_item_number for r in repairs.set_aside_rows(spark, job, "journal").collect()] == [2]


def test_files_are_mapped_by_their_own_headers(spark, tmp_path):
    folder = tmp_path / "TSPA.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("SPART,VTEXT\n01,one\n02,\"two, and more\"\n")
    (folder / "b.csv").write_text("VTEXT,EXTRA,SPART\nthree,x,03\nfour,,04\nfive,y,05,surplus\n")
    (folder / "c.csv").write_text("SPART\n06\n")
    rows = landing.read_reconciled(spark, "TSPA", str(folder), lineage=False).collect()
    got = {r["SPART"]: (r["VTEXT"], json.loads(r[landing.RESCUED] or "null")) for r in rows}
    assert got == {
        "01": ("one", None), "02": ("two, and more", None), "03": ("three", {"EXTRA": "x"}), "04": ("four", None),
        "05": ("five", {"EXTRA": "y", "": "five,y,05,surplus"}), "06": (None, None),
    }
    assert landing.read_reconciled(spark, "TSPA", str(folder)).filter(F.col(landing.SOURCE_FILE).endswith("b.csv")).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        landing.read_reconciled(spark, "TSPA", str(tmp_path / "nothing.csv"))


def test_a_refresh_with_bucketed_documents_and_a_clustered_fact(spark, job):  # noqa: F811
    journal = [line(BUZEI="1"), line(BUZEI="2", GJAHR="2023"), line(BUZEI="3", BELNR="9"), line(BELNR=None)]
    land_all(ledger(spark, journal), job)
    layers.refresh(spark, job)
    plain = sorted(map(str, layers.read_layer(spark, job, "conformed", postings.FACT).select(*postings.COLUMNS).collect()))
    other = replace(job, bucket_documents=True, cluster_fact_by=("fiscal_year", "company_code"))
    for _ in range(3):
        layers.refresh(spark, other)
    assert sorted(map(str, layers.read_layer(spark, job, "conformed", postings.FACT).select(*postings.COLUMNS).collect())) == plain
    assert layers.read_layer(spark, job, "mart", pnl.MART).count() == 10
    rows = layers.read_fact(spark, other, {"fiscal_year": ["2023"]})
    assert [r.line_item_number for r in rows.collect()] == [2] and len(rows.inputFiles()) == 1
    assert layers.stored_documents(spark, other).count() == 4
    assert any("journal_lines_" in name for name in layers.clean(spark, other, older_than=0))
    assert layers.stored_documents(spark, other).count() == 4
    layers.clean(spark, other, older_than=0)
    assert len(layers.log_of(spark, job).folders(job.folder("conformed", postings.FACT))) == 2


def test_keys_are_counted_only_after_changes(spark, job, monkeypatch):  # noqa: F811
    land_all(ledger(spark, [line()]), job)
    layers.refresh_raw(spark, job)
    first = sorted(map(tuple, layers.rule_report(spark, job).collect()))

    def never(*_):
        raise AssertionError("keys were counted again")

    with monkeypatch.context() as patched:
        patched.setattr(keys, "duplicated_sides", never)
        assert sorted(map(tuple, layers.rule_report(spark, job).collect())) == first
    own = SIDES["kna1"]

    def unique():
        with layers.begun(spark, job) as run:
            return "kna1" not in keys.repeating(run, [own])

    rows = lambda *names: ledger(spark, [], kna1=[{"KUNNR": n} for n in names])["kna1"]
    seen = []
    monkeypatch.setattr(keys, "duplicated_sides", lambda pairs, count=keys.duplicated_sides: seen.append(pairs[0][1].count()) or count(pairs))
    for names, wanted in ((["K2", "K3"], True), (["K4", None, None], True), (["K3"], False), (["K5"], False)):
        landing.land(rows(*names), "KNA1", job.landing, mode="append")
        layers.refresh_raw(spark, job, ["KNA1"], append=True)
        assert unique() is wanted
    # Only the new keys were grouped, and nothing once a key was found twice.
    assert seen == [2, 1, 1]


def test_old_scratch_folders_are_removed(spark):
    made, kept = (scratch.scratch_folder(spark, label) for label in ("old-one", "other"))
    for path in (made, kept, made.rsplit("/", 1)[0] + "/own folder"):
        spark.range(1).write.mode("overwrite").parquet(path)
    assert made.rsplit("/", 1)[1] not in scratch.remove_scratch(spark)
    scratch.remove_folder(spark, made)
    assert spark.read.parquet(kept).count() == 1
    with pytest.raises(ValueError, match="no scratch"):
        scratch.remove_folder(spark, kept.rsplit("/", 1)[0])


def test_values_are_dealt_by_their_counts(spark, monkeypatch):
    rows = spark.range(900).selectExpr("if(id < 500, 'a', nullif(cast(id % 4 AS string), '3')) AS y", "id")
    plan = lambda: clustered.dealt(rows, ["y"], 9)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan()
    parts = clustered.dealt(rows, ["y"], 9).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.collect_set("y").alias("ys")).collect()
    assert len(parts) == 9 and sum(r["n"] for r in parts) == 900 and max(r["n"] for r in parts) < 200 and max(len(r["ys"]) for r in parts) <= 2
    assert sorted(map(str, clustered.dealt(rows, ["y"], 9).collect())) == sorted(map(str, rows.collect()))
    monkeypatch.setattr(clustered, "COUNTED", 3)
    assert "rangepartitioning" in plan()
    assert clustered.dealt(rows, ["y"], 9).columns == ["y", "id"]
    assert clustered.dealt(rows.limit(0), ["y"]).count() == 0


def test_a_clustered_fact_has_its_violations_counted_once(spark, job):  # noqa: F811
    land_all(ledger(spark, [line(BUZEI="1"), line(BUZEI="2", GJAHR="2023"), line(BELNR=None)]), job)
    counts = layers.refresh(spark, replace(job, cluster_fact_by=("fiscal_year",)))
    assert counts[postings.FACT]["rows"] == 3 and counts[postings.FACT]["document_key_not_null"] == 1


def test_postings_are_clustered_before_or_after_their_joins(spark, tmp_path):
    raw = ledger(spark, [line(BUZEI=str(k), GJAHR=str(2020 + k % 3)) for k in range(9)])
    wanted = {"fiscal_year": ["2020", "2021"]}
    plain = postings.postings(raw).drop("silver_transformation_ts").filter("fiscal_year <= '2021'")
    for limit in (None, "0"):
        if limit:
            spark.conf.set("ledgerloom.broadcast.bytes", limit)
        try:
            clustered.write_postings(raw, f"{tmp_path}/{limit}", ["fiscal_year"])
        finally:
            spark.conf.unset("ledgerloom.broadcast.bytes")
        rows = clustered.read_clustered(spark, f"{tmp_path}/{limit}", ["fiscal_year"], wanted)
        assert sorted(map(str, rows.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        assert len(rows.inputFiles()) < len(clustered.files_with(spark, f"{tmp_path}/{limit}", ["fiscal_year"], {}))
