import threading
from dataclasses import replace

import pytest
from pyspark.errors import PySparkException

from ledger import ledger, line
from ledgerloom.plans import layers, pnl, portions, postings, runs
from ledgerloom.sources import landing


@pytest.fixture
def job(spark, tmp_path):
    run = tmp_path.name.replace("-", "_")
    schemas = {layer: f"{name}_{run}" for layer, name in layers.SCHEMAS.items()}
    for schema in schemas.values():
        spark.sql(f"CREATE SCHEMA {schema}")
    yield layers.Job(f"{tmp_path}/landed", f"{tmp_path}/tables", schemas=schemas)
    for schema in schemas.values():
        spark.sql(f"DROP SCHEMA {schema} CASCADE")


def land_all(raw, job, mode="errorifexists"):
    for name, df in raw.items():
        landing.land(df, name.upper(), job.landing, mode)


def lines_of(spark, job):
    return sorted(r["BUZEI"] for r in layers.read_layer(spark, job, "raw", "acdoca").collect())


def test_schemas_are_taken_from_the_session(spark):
    spark.conf.set("ledgerloom.schema.raw", "landed_here")
    try:
        assert layers.schemas_of(spark) == {**layers.SCHEMAS, "raw": "landed_here"}
    finally:
        spark.conf.unset("ledgerloom.schema.raw")


def test_refresh(spark, job):
    land_all(ledger(spark, [line(), line(BELNR=None), line(RBUKRS=None, GJAHR="1999")]), job)
    counts = layers.refresh(spark, job)
    assert counts["financial_postings"] == {
        "rows": 3, "document_key_not_null": 1, "valid_fiscal_year": 1, "company_code_not_null": 1,
    }
    assert counts["profit_and_loss"]["company_code_not_null"] == 5
    assert counts["pnl_line"] == {"rows": 15, "pnl_line_id_not_null": 0, "valid_line_type": 15}
    fact = layers.read_layer(spark, job, "conformed", "financial_postings")
    assert len(fact.columns) == 74 and fact.count() == 2
    mart = spark.table(job.table("mart", pnl.MART))
    assert mart.columns[-1] == pnl.MART_TS and mart.count() == 5
    stored = layers.read_layer(spark, job, "mart", layers.COUNTS)
    assert stored.filter("table = 'financial_postings' AND rule = 'rows'").first()["violations"] == 3
    assert spark.catalog.getTable(job.table("mart", pnl.MART)).description.startswith("P&L by")
    layers.refresh(spark, job)  # replaces what the first one left
    assert spark.table(job.table("mart", pnl.MART)).count() == 5


def test_stored_rows_are_packed(spark, job, tmp_path):
    land_all(ledger(spark, [line()]), job)
    layers.refresh(spark, job)
    names = [f.name for f in (tmp_path / "tables").rglob("part-*.parquet")]
    plain = [f for f in (tmp_path / "tables").rglob("part-*.parquet") if not f.name.endswith(".zstd.parquet")]
    # What isn't: the empty files that name a raw table's columns, and a few counts of rules.
    assert len(names) > 30 and all("_batch=" in str(f.parent) for f in plain)
    assert not any("financial_postings" in str(f) or "_batch=0" in str(f.parent) and "rule_history" not in str(f) for f in plain)


def test_a_failed_refresh_keeps_the_last_tables(spark, job):
    land_all(ledger(spark, [line()]), job)
    layers.refresh(spark, job)
    landing.land(ledger(spark, [line(KSL="12,x")])["acdoca"], "ACDOCA", job.landing, mode="append")
    with pytest.raises(PySparkException):
        layers.refresh(spark, job)
    assert layers.read_layer(spark, job, "mart", pnl.MART).count() == 5
    assert layers.read_layer(spark, job, "conformed", "financial_postings").count() == 1
    # A lenient one takes the malformed amount as missing.
    assert layers.refresh(spark, replace(job, lenient=True))["financial_postings"]["rows"] == 2


def test_full_and_appending_loads_take_turns(spark, job):
    journal = lambda *numbers: ledger(spark, [line(BUZEI=n) for n in numbers])["acdoca"]
    landed = []
    for number, append in (("1", False), ("2", True), ("3", False), ("4", True), (None, True)):
        if number:
            landing.land(journal(number), "ACDOCA", job.landing, mode="append")
            landed.append(number)
        layers.refresh_raw(spark, job, ["ACDOCA"], append)
        assert lines_of(spark, job) == landed


def test_a_single_file_is_appended(spark, job, tmp_path):
    for source in ("TSPA", "TVTW"):
        (tmp_path / "landed").mkdir(exist_ok=True)
        name = landing.contract(source).fieldNames()
        (tmp_path / "landed" / f"{source}.csv").write_text(",".join(name) + "\n01,x\n")
        layers.refresh_raw(spark, job, [source], append=True)
        layers.refresh_raw(spark, job, [source], append=True)
        assert layers.read_layer(spark, job, "raw", source.lower()).count() == 1


def test_misfits_can_be_rescued_in_a_refresh(spark, job, tmp_path):
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "TSPA.csv").write_text("SPART,VTEXT\n01,a\n02,b,c\n")
    with pytest.raises(PySparkException):
        layers.refresh_raw(spark, job, ["TSPA"])
    layers.refresh_raw(spark, replace(job, misfits=landing.Misfits.RESCUE, lineage=False), ["TSPA"])
    rows = {tuple(r) for r in layers.read_layer(spark, job, "raw", "tspa").collect()}
    assert rows == {("01", "a", None), ("02", "b", "02,b,c")}


def test_mart_refresh_reads_only_what_it_needs(spark, job):
    land_all(ledger(spark, [line()]), job)
    layers.refresh_raw(spark, job)
    layers.refresh_conformed(spark, replace(job, partition_fact_by=["fiscal_year"]))
    fact = layers.read_layer(spark, job, "conformed", "financial_postings")
    plan = pnl.profit_and_loss(fact)._jdf.queryExecution().executedPlan().toString()
    scans = [text for text in plan.splitlines() if "FileScan" in text]
    assert len(scans) == 1
    assert "EqualTo(account_type,P&L)" in scans[0] and "IsNotNull(pnl_line_id)" in scans[0]
    assert "customer_name" not in scans[0] and "document_header_text" not in scans[0]


def test_report_filters_reach_the_stored_fact(spark, job):
    land_all(ledger(spark, [line()]), job)
    layers.refresh_raw(spark, job)
    layers.refresh_conformed(spark, job)
    fact = layers.read_layer(spark, job, "conformed", "financial_postings")
    rows = pnl.profit_and_loss(fact).filter("fiscal_year = '2024' AND company_code = 'C1'")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    try:
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [text for text in plan.splitlines() if "FileScan" in text]
    assert len(scans) == 1 and "Expand" not in plan
    assert "EqualTo(fiscal_year,2024)" in scans[0] and "EqualTo(company_code,C1)" in scans[0]


def test_landed_files_are_dealt_to_several_tasks_a_core(spark, job, tmp_path):
    rows = ledger(spark, [line(BUZEI=str(k)) for k in range(64)])["acdoca"].repartition(64)
    landing.land(rows, "ACDOCA", job.landing)
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    layers.refresh_raw(spark, job, ["ACDOCA"])
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) == before
    # With fewer than two tasks a core, some cores would wait for a second round of the others.
    assert len(list((tmp_path / "tables").glob("*/acdoca/*/_batch=0/part-*"))) >= 2 * spark.sparkContext.defaultParallelism
    assert lines_of(spark, job) == sorted(str(k) for k in range(64))


def test_sources_are_loaded_side_by_side(spark, job, monkeypatch):
    raw = ledger(spark, [line()], kna1=[{"KUNNR": "K1"}])
    for name in ("acdoca", "kna1"):
        landing.land(raw[name], name.upper(), job.landing)
    both, note = threading.Barrier(2, timeout=60), runs.Run.note

    def met(run, event, **details):
        if event == "load":
            both.wait()
        note(run, event, **details)

    with monkeypatch.context() as patched:
        patched.setattr(runs.Run, "note", met)
        layers.refresh_raw(spark, job, ["ACDOCA", "KNA1"])
    log = layers.log_of(spark, job)
    for name in ("acdoca", "kna1"):
        (load,) = layers.loads(log, name)
        assert load["rows"] == 1 and f"/{name.upper()}.csv/" in load["files"][0]["file"]
        # The file's name is stored once.
        stored = spark.read.parquet(f"{runs.published(log)[f'raw.{name}'].folder}/{runs.BATCH}=0").columns
        assert stored == [*raw[name].columns, "_load_bytes", landing.INGESTION_TS, landing.SOURCE_FILE]
        assert layers.read_layer(spark, job, "raw", name).columns == [*raw[name].columns, landing.INGESTION_TS, landing.SOURCE_FILE]


def test_a_failed_load_ends_after_the_others(spark, job, tmp_path):
    land_all(ledger(spark, [line()]), job)
    (tmp_path / "landed" / "TSPA.csv" / "odd.csv").write_text("SPART,VTEXT\n01,a,surplus\n")
    with pytest.raises(PySparkException):
        layers.refresh_raw(spark, job, ["TSPA", "ACDOCA"])
    assert not spark.streams.active
    assert [r["rows"] for r in layers.loads(layers.log_of(spark, job), "acdoca")] == [1]
    (tmp_path / "landed" / "TSPA.csv" / "odd.csv").write_text("SPART,VTEXT\n99,a\n")
    layers.refresh_raw(spark, job, ["TSPA", "ACDOCA"])
    assert lines_of(spark, job) == ["1"] and layers.read_layer(spark, job, "raw", "tspa").filter("SPART = '99'").count() == 1


def test_the_fact_is_written_in_portions(spark, job, monkeypatch):
    """Portions of the journal's files are queries of their own, so that the shuffles of one go before the next; rows and counts are the same."""
    lines = [line(BUZEI=str(k), BELNR=None if k % 7 == 0 else f"{k % 5:010}", KUNNR=None if k % 3 else "K1") for k in range(48)]
    raw = ledger(spark, lines)
    land_all({**raw, "acdoca": raw["acdoca"].repartition(16)}, job)
    layers.refresh_raw(spark, job)
    whole = layers.refresh_conformed(spark, job)
    columns = [*postings.COLUMNS, *postings.LINEAGE]
    rows = layers.read_layer(spark, job, "conformed", postings.FACT).select(columns).collect()
    read, build = [], postings.posting_rows
    monkeypatch.setattr(postings, "posting_rows", lambda raw, **rest: read.append(raw["acdoca"]) or build(raw, **rest))
    monkeypatch.setattr(portions, "PORTIONS", 4)
    spark.conf.set(portions.PORTION_KEY, "1")
    try:
        counts = layers.refresh_conformed(spark, job)
    finally:
        spark.conf.unset(portions.PORTION_KEY)
    assert len(read) == 4 and sum(part.count() for part in read) == 48
    # Of each, only its own files are opened.
    assert max(part.select("BUZEI").rdd.getNumPartitions() for part in read) <= 5
    fact = layers.read_layer(spark, job, "conformed", postings.FACT)
    assert sorted(map(str, fact.select(columns).collect())) == sorted(map(str, rows)) and counts == whole
    assert fact.select("silver_transformation_ts").distinct().count() == 1


def test_a_portion_may_have_no_lines(spark, job, monkeypatch):
    land_all(ledger(spark, [line()]), job)
    layers.refresh_raw(spark, job)
    monkeypatch.setattr(portions, "PORTIONS", 2)
    spark.conf.set(portions.PORTION_KEY, "1")
    try:
        # One of the files is that which names the table's columns.
        assert layers.refresh_conformed(spark, job)[postings.FACT]["rows"] == 1
    finally:
        spark.conf.unset(portions.PORTION_KEY)
    assert layers.read_layer(spark, job, "conformed", postings.FACT).count() == 1
