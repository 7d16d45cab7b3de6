"""The layered refresh: raw tables, conformed tables, mart, each saved under its own schema.

A saved table is a view of the files of one generation. A refresh writes new generations of all layers, or further
batches of the raw ones, and then publishes them together by one record of the job's log: until then, and if the
refresh fails, readers have the last complete one. Loads are in the log as well, each with its files. Generations
that no table shows any more stay until :func:`clean` removes them, as a reader may still be busy with them.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Collection, Iterable, Iterator, Mapping, Sequence
from contextlib import AbstractContextManager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.quality import enforce, observe, report
from ledgerloom.plans.clustered import read_clustered, write_clustered
from ledgerloom.plans.dimensions import CONFORMED_TS, DIMENSION_NAMES, dimension_rows
from ledgerloom.plans.documents import lines_with_header, store_documents
from ledgerloom.plans.keys import repeating
from ledgerloom.plans.pnl import MART, MART_TS, direct_lines, direct_sums_from_journal, mart_rows
from ledgerloom.plans.postings import FACT, SIDES, posting_portions, posting_report, posting_rows_with_header
from ledgerloom.plans.rules import RULES
from ledgerloom.plans.runs import BATCH, STORED, Run, State, published, publications, running, states_of
from ledgerloom.sources.commits import CommitLog, Record
from ledgerloom.sources.contracts import CONTRACTS, table_name
from ledgerloom.sources.landing import Misfits
from ledgerloom.streaming.append import LOAD_COLUMNS, landed_files, loading, start_load

#: The schema of each layer where the session's settings name no other.
SCHEMAS = {"raw": "bronze", "conformed": "silver", "mart": "gold"}
COUNTS = "rule_counts"
HISTORY = "rule_history"
LINES, HEADERS = "journal_lines", "document_headers"


@dataclass(frozen=True)
class Job:
    """One place's tables: where extracts land, where generations are stored, and how they are loaded.

    ``landing`` and ``storage`` are folders that all executors reach; nothing stands in for them.
    """

    landing: str
    storage: str
    catalog: str = "spark_catalog"
    schemas: Mapping[str, str] = field(default_factory=lambda: dict(SCHEMAS))
    misfits: Misfits = Misfits.STOP
    lineage: bool = True
    #: Values that don't convert become NULL and show in the rule counts, instead of stopping the refresh.
    lenient: bool = False
    partition_fact_by: Sequence[str] = ()
    #: The fact's files hold ranges of these columns, and filters on them skip files (see ``read_fact``).
    cluster_fact_by: Sequence[str] = ()
    #: Journal lines and headers are stored by document, and the fact is built where they lie.
    bucket_documents: bool = False
    #: Seconds after which a run that didn't end no longer keeps others out.
    stale_after: float = 24 * 3600.0

    def table(self, layer: str, name: str) -> str:
        return f"{self.catalog}.{self.schemas[layer]}.{name}"

    def folder(self, layer: str, name: str) -> str:
        return f"{self.storage.rstrip('/')}/{self.schemas[layer]}/{name}"


def schemas_of(spark: SparkSession) -> dict[str, str]:
    """Each layer's schema: the session setting ``ledgerloom.schema.<layer>``, where there is one."""
    return {layer: spark.conf.get(f"ledgerloom.schema.{layer}", "") or name for layer, name in SCHEMAS.items()}


def read_layer(spark: SparkSession, job: Job, layer: str, name: str) -> DataFrame:
    """A saved table; its name reaches SQL as a parameter."""
    return spark.sql("SELECT * FROM IDENTIFIER(:name)", args={"name": job.table(layer, name)})


def log_of(spark: SparkSession, job: Job) -> CommitLog:
    return CommitLog(spark, f"{job.storage.rstrip('/')}/_log")


def begun(spark: SparkSession, job: Job) -> AbstractContextManager[Run]:
    """A run of the job; only one at a time."""
    return running(spark, log_of(spark, job), lambda table: job.table(*table.split(".", 1)), job.stale_after)


def read_snapshot(spark: SparkSession, job: Job, layer: str, name: str, run: str | None = None) -> DataFrame:
    """A table as last published, or as ``run`` did; all tables of one run belong together."""
    return spark.sql(published(log_of(spark, job), run)[f"{layer}.{name}"].select())


def set_comment(spark: SparkSession, job: Job, layer: str, name: str, comment: str) -> None:
    """Give a saved table another comment. It is a view, so ``COMMENT ON TABLE`` doesn't take it."""
    with begun(spark, job) as run:
        run.staged[f"{layer}.{name}"] = replace(run.state(f"{layer}.{name}"), comment=comment)


def raw_tables(run: Run) -> dict[str, DataFrame]:
    return {table_name(s): run.read(f"raw.{table_name(s)}") for s in CONTRACTS}


def stage(
    run: Run,
    parts: Iterable[DataFrame],
    job: Job,
    layer: str,
    name: str,
    comment: str,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
) -> None:
    """Write a new generation of a table, one part after the other, to be published with the run."""
    folder = f"{job.folder(layer, name)}/{uuid.uuid4().hex}"
    # Clustering reads its input twice. What counts rule violations must see each row once, and the joins are to be made once.
    rows = f"{folder}/rows" if cluster_by else folder
    for df in parts:
        schema = df.schema
        if partition_by and not cluster_by:
            # Rows of a value meet, large values in several files; otherwise every task writes a file for each value.
            df.hint("rebalance", *partition_by).write.mode("append").options(**STORED).partitionBy(*partition_by).parquet(rows)
        else:
            df.write.mode("append").options(**STORED).parquet(rows)
    columns = tuple(schema.fieldNames())
    if cluster_by:
        write_clustered(run.spark.read.schema(schema).parquet(rows), folder, cluster_by)
        run.log.remove(rows)
        run.staged[f"{layer}.{name}"] = State(f"{folder}/data", columns, comment, clustered=tuple(cluster_by))
        return
    run.staged[f"{layer}.{name}"] = State(folder, columns, comment)


def save(df: DataFrame, job: Job, layer: str, name: str, comment: str, partition_by: Sequence[str] = ()) -> None:
    """Write a new generation of a table and show it."""
    with begun(df.sparkSession, job) as run:
        stage(run, [df], job, layer, name, comment, partition_by)


def stage_raw(run: Run, job: Job, sources: Collection[str], append: bool) -> None:
    """Load sources into their raw tables: all landed files, or with ``append`` those not loaded so far.

    Every load is noted with its generation, batch, rows and files as soon as it is written. Appending goes on from
    whatever generation is published, also one that a full load began, and a full load begins a new one.
    """
    begun_loads: list[tuple[str, str, State | None, tuple[str, ...]]] = []
    with loading(run.spark) as started:
        for source in sources:
            name = table_name(source)
            root, last = job.folder("raw", name), run.state(f"raw.{name}")
            folder = last.folder if append and last else f"{root}/{uuid.uuid4().hex}"
            generation = folder.rsplit("/", 1)[1]
            rows = landed_files(run.spark, source, job.landing, job.misfits, job.lineage)
            columns = tuple(c for c in rows.columns if c not in LOAD_COLUMNS)
            # Where nothing has landed yet, readers find the columns.
            run.spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{folder}/{BATCH}=-1")

            def note(batch: int, n: int, files: list[dict], table: str = name, generation: str = generation) -> None:
                run.note("load", table=table, generation=generation, batch=batch, rows=n, files=files)

            started.append(start_load(rows, folder, f"{root}/state-{generation}", note))
            begun_loads.append((source, folder, last, columns))
    for source, folder, last, columns in begun_loads:
        name, generation = table_name(source), folder.rsplit("/", 1)[1]
        batches = max((r["batch"] for r in loads(run.log, name) if r["generation"] == generation), default=-1)
        retracted = last.retracted if last and last.folder == folder else ()
        run.staged[f"raw.{name}"] = State(folder, columns, f"Raw extract of {source}.", batches, retracted)


def loads(log: CommitLog, table: str) -> list[Record]:
    """The loads of a raw table: ``generation, batch, rows, files``; of a load that was repeated, the last."""
    found = {(r["generation"], r["batch"]): r for r in log.records() if r["event"] == "load" and r["table"] == table}
    return list(found.values())


def refresh_raw(
    spark: SparkSession, job: Job, sources: Collection[str] = tuple(CONTRACTS), append: bool = False
) -> None:
    """Load sources and show their raw tables."""
    with begun(spark, job) as run:
        stage_raw(run, job, sources, append)


def retract(spark: SparkSession, job: Job, source: str, file: str) -> int:
    """Take the load with a landed file whose path ends in ``file`` out of its raw table; returns its batch.

    Its other files go as well. What is to replace them lands under other names and is appended.
    """
    name = table_name(source)
    with begun(spark, job) as run:
        state = run.state(f"raw.{name}")
        own = [r for r in loads(run.log, name) if state and r["generation"] == state.folder.rsplit("/", 1)[1]]
        batch = next((r["batch"] for r in own if any(f["file"].endswith(file) for f in r["files"])), None)
        if batch is None:
            raise KeyError(f"no load of {source} has a file {file}")
        run.staged[f"raw.{name}"] = replace(state, retracted=tuple(sorted({*state.retracted, batch})))
        return batch


def refresh_model(
    run: Run,
    parts: Iterable[DataFrame],
    job: Job,
    layer: str,
    table: str,
    stamp: str,
    comment: str,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
) -> dict[str, int]:
    """Save a model, part by part, and count its rule violations in the same pass over its rows."""
    # All parts have the same time.
    now = F.timestamp_micros(F.lit(run.spark.sql("SELECT unix_micros(current_timestamp())").first()[0]))
    observations = []

    def kept() -> Iterator[DataFrame]:
        for rows in parts:
            counted, observation = observe(rows, RULES[table], f"{job.table(layer, table)} rules {len(observations)}")
            observations.append(observation)
            yield enforce(counted, RULES[table]).withColumn(stamp, now)

    stage(run, kept(), job, layer, table, comment, partition_by, cluster_by)
    counts: Counter[str] = Counter()
    for observation in observations:
        counts.update(observation.get)
    return dict(counts)


def stage_conformed(run: Run, job: Job) -> dict[str, dict[str, int]]:
    raw = raw_tables(run)
    counts = {
        table: refresh_model(
            run, [dimension_rows(table, raw, lenient=job.lenient)], job, "conformed", table, CONFORMED_TS, f"Dimension {table}."
        )
        for table in DIMENSION_NAMES
    }
    counts[FACT] = refresh_model(
        run,
        _posting_parts(run, job, raw),
        job,
        "conformed",
        FACT,
        CONFORMED_TS,
        "Journal lines with document header and dimensions.",
        job.partition_fact_by,
        job.cluster_fact_by,
    )
    return counts


def _posting_parts(run: Run, job: Job, raw: Mapping[str, DataFrame]) -> Iterable[DataFrame]:
    if not job.bucket_documents:
        return posting_portions(raw, lenient=job.lenient)
    names = [job.table("conformed", f"{t}_{run.name}") for t in (LINES, HEADERS)]
    store_documents(run.spark, raw, *names, job.folder("conformed", "_documents"), lenient=job.lenient)
    run.note("documents", lines=names[0], headers=names[1])
    return [posting_rows_with_header(lines_with_header(run.spark, *names), raw, run.spark.table(names[0]))]


def stored_documents(spark: SparkSession, job: Job) -> DataFrame:
    """Journal lines with their document header, joined where the last refresh has stored both."""
    last = next(r for r in reversed(log_of(spark, job).records()) if r["event"] == "documents")
    return lines_with_header(spark, last["lines"], last["headers"])


def read_fact(spark: SparkSession, job: Job, wanted: Mapping[str, Collection]) -> DataFrame:
    """Postings with one of the wanted values in each of the columns named; of a clustered fact out of the files that may hold them."""
    state = published(log_of(spark, job))[f"conformed.{FACT}"]
    if state.clustered:
        return read_clustered(spark, state.folder.removesuffix("/data"), state.clustered, wanted).select(*state.columns)
    return reduce(lambda rows, c: rows.filter(F.col(c).isin(list(wanted[c]))), wanted, spark.sql(state.select()))


def rule_report(spark: SparkSession, job: Job) -> DataFrame:
    """Violations of all rules in the published tables; side tables are searched for repeated keys only if they changed."""
    with begun(spark, job) as run:
        raw = raw_tables(run)
        reports = [report(dimension_rows(name, raw), RULES[name], name) for name in DIMENSION_NAMES]
        reports.append(posting_report(raw, repeating(run, list(SIDES.values()))))
        reports.append(report(mart_rows(direct_sums_from_journal(raw)), RULES[MART], MART))
    return reduce(DataFrame.unionByName, reports)


def refresh_conformed(spark: SparkSession, job: Job) -> dict[str, dict[str, int]]:
    """Save the dimensions and the fact; returns rows and violations per table."""
    with begun(spark, job) as run:
        return stage_conformed(run, job)


def stage_mart(run: Run, job: Job, rows: DataFrame | None = None) -> dict[str, dict[str, int]]:
    if rows is None:
        rows = mart_rows(direct_lines(run.read(f"conformed.{FACT}")))
    comment = "P&L by company, period, version, channel, division and sales organisation."
    return {MART: refresh_model(run, [rows], job, "mart", MART, MART_TS, comment)}


def refresh_mart(spark: SparkSession, job: Job) -> dict[str, dict[str, int]]:
    """Save the P&L mart out of the saved fact."""
    with begun(spark, job) as run:
        return stage_mart(run, job)


def stage_counts(run: Run, job: Job, counts: Mapping[str, Mapping[str, int]]) -> None:
    """A refresh's rows and violations, a row for each table and rule, after those of the refreshes before."""
    rows = [(table, rule, n) for table, rules in counts.items() for rule, n in rules.items()]
    kept = run.spark.createDataFrame(rows, "table string, rule string, violations bigint")
    kept = kept.withColumns({"refreshed": F.current_timestamp(), "run": F.lit(run.name)})
    stage(run, [kept], job, "mart", COUNTS, "Rows and rule violations of the last refresh.")
    last = run.state(f"mart.{HISTORY}")
    folder = last.folder if last else f"{job.folder('mart', HISTORY)}/{uuid.uuid4().hex}"
    number = last.batches + 1 if last else 0
    kept.write.mode("overwrite").parquet(f"{folder}/{BATCH}={number}")
    run.staged[f"mart.{HISTORY}"] = State(folder, tuple(kept.columns), "Rows and rule violations of all refreshes.", number)


def refresh(spark: SparkSession, job: Job, append: bool = False) -> dict[str, dict[str, int]]:
    """Raw, then conformed, then mart, published together; what the rules counted is stored, too."""
    with begun(spark, job) as run:
        stage_raw(run, job, tuple(CONTRACTS), append)
        counts = {**stage_conformed(run, job), **stage_mart(run, job)}
        stage_counts(run, job, counts)
    return counts


def clean(spark: SparkSession, job: Job, keep: int = 2, older_than: float = 24 * 3600.0) -> list[str]:
    """Remove what no table of the last ``keep`` publications shows and that is ``older_than`` seconds old.

    Returns the folders removed: generations, with the state of their loads. Nothing else in the storage is touched.
    """
    removed = []
    with begun(spark, job) as run:
        shown = {s.folder.removesuffix("/data") for record in publications(run.log)[-keep:] for s in states_of(record).values()}
        known = {table for record in publications(run.log) for table in record["tables"]}
        for table in sorted(known):
            root = job.folder(*table.split(".", 1))
            for name, changed in run.log.folders(root).items():
                if f"{root}/{name.removeprefix('state-')}" not in shown and time.time() - changed >= older_than:
                    run.log.remove(f"{root}/{name}")
                    removed.append(f"{root}/{name}")
        kept = {record["run"] for record in publications(run.log)[-keep:]}
        for record in run.log.records():
            if record["event"] == "documents" and record["run"] not in kept and time.time() - record["time"] >= older_than:
                for table in (record["lines"], record["headers"]):
                    if spark.catalog.tableExists(table):
                        spark.sql(f"DROP TABLE {table}")
                        run.log.remove(f"{job.folder('conformed', '_documents')}/{table.rsplit('.', 1)[1]}")
                        removed.append(table)
    return removed
