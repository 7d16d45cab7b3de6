import pytest

from ledger import ledger, line
from ledgerloom.operators.star import Side, attach, attach_keyed
from ledgerloom.plans import documents, increments, layers, pnl, postings, runs
from ledgerloom.sources import landing
from test_layers import job, land_all  # noqa: F401


def mart(spark, job):  # noqa: F811
    return sorted(map(str, layers.read_layer(spark, job, "mart", pnl.MART).drop(pnl.MART_TS).collect()))


def direct(spark, journal):
    return sorted(map(str, pnl.profit_and_loss_from_journal(ledger(spark, journal)).drop(pnl.MART_TS).collect()))


FIRST = [line(), line(BUZEI="2", KSL=None), line(BUZEI="3", RACCT="500000", KSL="4.25", MONAT="04")]
SECOND = [line(BUZEI="4", KSL="-2.75"), line(BUZEI="5", RBUKRS=None), line(BUZEI="6", RACCT="690000", KSL=None), line(BELNR=None)]


def test_the_mart_follows_loads_and_retractions(spark, job):  # noqa: F811
    land_all(ledger(spark, FIRST), job)
    assert increments.refresh_by_load(spark, job) == [0]
    assert mart(spark, job) == direct(spark, FIRST)
    landing.land(ledger(spark, SECOND)["acdoca"], "ACDOCA", job.landing, mode="append")
    # What the first load left isn't there to be read again.
    log = layers.log_of(spark, job)
    state = runs.published(log)["raw.acdoca"]
    parts = [f for f in log.folders(state.folder) if f == f"{runs.BATCH}=0"]
    spark.read.parquet(f"{state.folder}/{parts[0]}").limit(0).write.mode("overwrite").parquet(f"{state.folder}-emptied")
    log.remove(f"{state.folder}/{parts[0]}")
    assert increments.refresh_by_load(spark, job) == [1]
    assert mart(spark, job) == direct(spark, FIRST + SECOND)
    file = layers.loads(log, "acdoca")[1]["files"][0]["file"]
    assert layers.retract(spark, job, "ACDOCA", file) == 1
    assert increments.refresh_merged(spark, job) == []
    assert mart(spark, job) == direct(spark, FIRST)
    landing.land(ledger(spark, SECOND[:1])["acdoca"], "ACDOCA", job.landing, mode="append")
    assert increments.refresh_by_load(spark, job) == [2]
    assert mart(spark, job) == direct(spark, FIRST + SECOND[:1])


def test_loads_are_noted_with_their_files(spark, job):  # noqa: F811
    landing.land(ledger(spark, FIRST)["acdoca"], "ACDOCA", job.landing)
    layers.refresh_raw(spark, job, ["ACDOCA"])
    layers.set_comment(spark, job, "raw", "acdoca", "It's the journal")
    assert spark.catalog.getTable(job.table("raw", "acdoca")).description == "It's the journal"
    landing.land(ledger(spark, SECOND)["acdoca"], "ACDOCA", job.landing, mode="append")
    layers.refresh_raw(spark, job, ["ACDOCA"], append=True)
    noted = layers.loads(layers.log_of(spark, job), "acdoca")
    assert [(r["batch"], r["rows"], sum(f["rows"] for f in r["files"])) for r in noted] == [(0, 3, 3), (1, 4, 4)]
    assert all(f["bytes"] > 0 and "/ACDOCA.csv/" in f["file"] for r in noted for f in r["files"])
    assert layers.read_layer(spark, job, "raw", "acdoca").count() == 7
    assert len(layers.read_layer(spark, job, "raw", "acdoca").columns) == len(landing.contract("ACDOCA")) + 2


def test_a_concurrent_run_is_refused(spark, job):  # noqa: F811
    landing.land(ledger(spark, FIRST)["acdoca"], "ACDOCA", job.landing)
    with layers.begun(spark, job), pytest.raises(runs.ConcurrentRun):
        layers.refresh_raw(spark, job, ["ACDOCA"])
    layers.refresh_raw(spark, job, ["ACDOCA"])
    assert layers.read_layer(spark, job, "raw", "acdoca").count() == 3


def test_layers_are_published_together(spark, job, monkeypatch):  # noqa: F811
    land_all(ledger(spark, FIRST), job)
    layers.refresh(spark, job)
    before = [mart(spark, job), layers.read_layer(spark, job, "raw", "acdoca").count()]
    landing.land(ledger(spark, SECOND)["acdoca"], "ACDOCA", job.landing, mode="append")

    def stop(*_):
        raise RuntimeError("no mart today")

    with monkeypatch.context() as patched, pytest.raises(RuntimeError):
        patched.setattr(layers, "stage_mart", stop)
        layers.refresh(spark, job, append=True)
    assert [mart(spark, job), layers.read_layer(spark, job, "raw", "acdoca").count()] == before
    assert layers.read_snapshot(spark, job, "conformed", postings.FACT).count() == len(FIRST)
    # The load isn't lost: the next refresh shows it with all that follows from it.
    layers.refresh(spark, job, append=True)
    assert mart(spark, job) == direct(spark, FIRST + SECOND)
    history = layers.read_layer(spark, job, "mart", layers.HISTORY)
    rows = history.filter(f"table = '{postings.FACT}' AND rule = 'rows'").select("violations").collect()
    assert sorted(r.violations for r in rows) == [3, 7]
    log = layers.log_of(spark, job)
    first = runs.publications(log)[0]["run"]
    assert layers.read_snapshot(spark, job, "conformed", postings.FACT, first).count() == len(FIRST)


def test_old_generations_are_removed(spark, job):  # noqa: F811
    landing.land(ledger(spark, FIRST)["acdoca"], "ACDOCA", job.landing)
    for _ in range(3):
        layers.refresh_raw(spark, job, ["ACDOCA"])
    log, root = layers.log_of(spark, job), job.folder("raw", "acdoca")
    assert len(log.folders(root)) == 6  # with the state of their loads
    assert layers.clean(spark, job) == []
    assert len(layers.clean(spark, job, older_than=0)) == 2
    assert len([f for f in log.folders(root) if not f.startswith("state-")]) == 2
    layers.refresh_raw(spark, job, ["ACDOCA"], append=True)
    assert layers.read_layer(spark, job, "raw", "acdoca").count() == 3


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [text for text in plan.splitlines() if "Exchange" in text]


def test_documents_join_where_they_lie(spark, tmp_path):
    journal = [line(BUZEI=str(k)) for k in range(300)] + [line(BELNR=None, BUZEI=str(k)) for k in range(300)]
    journal += [line(BELNR=f"{k:010d}", BUZEI="1") for k in range(2, 300)]
    headers = [{"BELNR": f"{k:010d}", "BUKRS": "C1", "GJAHR": "2024", "BLART": f"T{k}"} for k in range(1, 300, 2)]
    raw = ledger(spark, journal, bkpf=headers)
    names = [f"default.{t}_{tmp_path.name.replace('-', '_')}" for t in ("lines", "headers")]
    documents.store_documents(spark, raw, *names, str(tmp_path / "documents"), buckets=8)
    joined = documents.lines_with_header(spark, *names)
    assert exchanges(joined) == []
    wanted = postings.enrich(postings.journal_lines(raw["acdoca"]), raw, ["bkpf"])
    assert sorted(map(str, joined.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in spark.table(names[0]).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 300
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_rows_without_a_key_pass_no_exchange(spark, tmp_path):
    fact = spark.range(1000).selectExpr("id", "if(id % 3 = 0, NULL, id % 7) AS k")
    fact.write.parquet(str(tmp_path / "fact"))
    fact = spark.read.parquet(str(tmp_path / "fact"))
    dim = spark.range(5).selectExpr("id AS K", "concat('n', id) AS name")
    side = Side("d", {"k": "K"}, {"name": "name"})
    both = [join(fact, side.project(dim), side, "merge") for join in (attach_keyed, attach)]
    assert sorted(map(tuple, both[0].collect()), key=str) == sorted(map(tuple, both[1].collect()), key=str)
    tree = both[0]._jdf.queryExecution().executedPlan().toString()
    keyless = tree[tree.rindex("Project") :]
    assert "isnull(k" in keyless and "Exchange" not in keyless and "Union" in tree
