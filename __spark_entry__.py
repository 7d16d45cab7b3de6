
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace
from functools import partial, reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries  # noqa: E402
from ledgerloom.operators.quality import enforce, observe, quarantine, report  # noqa: E402
from ledgerloom.operators.star import BROADCAST_KEY  # noqa: E402
from ledgerloom.plans import clustered, documents, increments, layers, pnl, postings, repairs, reports, runs  # noqa: E402
from ledgerloom.plans.dimensions import CONFORMED_TS, DIMENSION_NAMES, dimension, dimension_rows  # noqa: E402
from ledgerloom.plans.rules import RULES  # noqa: E402
from ledgerloom.sources import landing  # noqa: E402
from ledgerloom.sources.contracts import CONTRACTS, contract  # noqa: E402
from ledgerloom.sources.driver_tables import RawTables  # noqa: E402
from ledgerloom.sources.scratch import scratch_folder  # noqa: E402

try:
    from ledgerloom.llm import queries as llm  # noqa: E402
except ImportError:  # The library works without this subpackage.
    llm = None

FLAGSHIP_DIR = "/root/testdata/sf0.001"

HEADER = ("bkpf",)
ACCOUNT_LINE = ("ska1", "map_account_to_pnl_line", "dim_pnl_line")
COMMERCIAL = ("kna1", "mara")
ORG = ("t001", "t001w", "csks", "cepc", "tvko", "tvtw", "tspa")
MART_SIDES = (*ACCOUNT_LINE, "t001", "tvko", "tvtw", "tspa")


# Raw layer -----------------------------------------------------------------------------


def raw_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_folder(spark, "roundtrip")
    path = landing.land(RawTables(spark, sf_dir)["acdoca"], "ACDOCA", root)
    return landing.read_extract(spark, "ACDOCA", path, lineage=False)


def raw_text_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with blanks at their ends, quotes, separators and line breaks."""
    awkward = "concat('  ', c_name, ' ', chr(9), '\"q\", ', chr(10), ' ', c_comment, '  ')"
    cells = {**dict.fromkeys(contract("KNA1").fieldNames(), "CAST(NULL AS STRING)"), "KUNNR": "CAST(c_custkey AS STRING)", "NAME1": awkward}
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("c_comment", F.col("c_mktsegment"))
    rows = rows.selectExpr(*[f"{value} AS {cell}" for cell, value in cells.items()])
    path = landing.land(rows, "KNA1", scratch_folder(spark, "text"))
    return landing.read_extract(spark, "KNA1", path, lineage=False, line_breaks=True).select("KUNNR", "NAME1")


def raw_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_folder(spark, "tables")
    for name, table in RawTables(spark, sf_dir).items():
        landing.land(table, name.upper(), root)

    def size(source: str) -> DataFrame:
        cells = contract(source).fieldNames()
        filled = sum((F.count(c) for c in cells), F.lit(0))
        length = sum((F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in cells), F.lit(0))
        return landing.read_extract(spark, source, landing.source_path(root, source)).agg(
            F.lit(source).alias("source"),
            F.count(F.lit(1)).alias("row_count"),
            filled.cast("bigint").alias("filled_cells"),
            length.cast("bigint").alias("text_length"),
        )

    return reduce(DataFrame.unionByName, [size(source) for source in CONTRACTS])


def raw_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_folder(spark, "lineage")
    path = landing.land(RawTables(spark, sf_dir)["acdoca"], "ACDOCA", root)
    return landing.read_extract(spark, "ACDOCA", path).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(landing.INGESTION_TS).alias("rows_with_load_time"),
        F.count_if(F.col(landing.SOURCE_FILE).contains("/ACDOCA.csv/")).alias("rows_with_source_file"),
    )


def land_damaged(spark: SparkSession, sf_dir: str, root: str) -> str:
    """A journal extract some of whose rows have a cell too many."""
    cells = contract("ACDOCA").fieldNames()
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells])
    damaged = F.expr("BUZEI = '3' AND RACCT LIKE '%700'")
    text = F.when(damaged, F.concat(line, F.lit(",surplus"))).otherwise(line)
    path = landing.source_path(root, "ACDOCA")
    # One text column under the extract's header line; the separator occurs nowhere in it.
    extract = RawTables(spark, sf_dir)["acdoca"].select(text.alias(",".join(cells)))
    extract.write.option("header", True).option("sep", "\u0001").csv(path)
    return path


def raw_permissive_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = land_damaged(spark, sf_dir, scratch_folder(spark, "rescue"))
    return landing.read_extract(spark, "ACDOCA", path, landing.Misfits.RESCUE, lineage=False)


def raw_unregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing.source_path(scratch_folder(spark, "unregistered"), "CUSTOMERS")
    source = spark.read.parquet(f"{sf_dir}/customer.parquet")
    source.write.option("header", True).csv(path)
    return landing.read_extract(spark, "CUSTOMERS", path, lineage=False)


def new_job(spark: SparkSession, label: str, **options) -> layers.Job:
    """A job with folders and schemas of its own."""
    root = scratch_folder(spark, label)
    run = root.rsplit("-", 1)[1]
    schemas = {layer: f"{name}_{run}" for layer, name in layers.SCHEMAS.items()}
    for schema in schemas.values():
        spark.sql(f"CREATE SCHEMA spark_catalog.{schema}")
    return layers.Job(f"{root}/landed", f"{root}/tables", schemas=schemas, **options)


def raw_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full load, then one of what has landed since."""
    job = new_job(spark, "append", lineage=False)
    journal = RawTables(spark, sf_dir)["acdoca"]
    late = F.coalesce(F.col("MONAT") > "06", F.lit(False))
    for append, batch in ((False, journal.filter(~late)), (True, journal.filter(late)), (True, journal.limit(0))):
        landing.land(batch, "ACDOCA", job.landing, mode="append")
        layers.refresh_raw(spark, job, ["ACDOCA"], append)
    return layers.read_layer(spark, job, "raw", "acdoca")


def landed_job(spark: SparkSession, sf_dir: str, label: str) -> layers.Job:
    job = new_job(spark, label)
    for name, table in RawTables(spark, sf_dir).items():
        landing.land(table, name.upper(), job.landing)
    return job


def layer_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = landed_job(spark, sf_dir, "layers")
    layers.refresh(spark, job)
    return layers.read_layer(spark, job, "mart", pnl.MART).drop(pnl.MART_TS)


def layer_refresh_rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = new_job(spark, "rescued", misfits=landing.Misfits.RESCUE, lineage=False)
    land_damaged(spark, sf_dir, job.landing)
    layers.refresh_raw(spark, job, ["ACDOCA"])
    return layers.read_layer(spark, job, "raw", "acdoca")


def refresh_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart as the last complete refresh left it, after one that stopped at a malformed amount."""
    job = landed_job(spark, sf_dir, "failure")
    layers.refresh(spark, job)
    broken = RawTables(spark, sf_dir)["acdoca"].withColumn("KSL", F.lit("12,x"))
    landing.land(broken, "ACDOCA", job.landing, mode="append")
    try:
        layers.refresh(spark, job)
    except PySparkException:
        return layers.read_layer(spark, job, "mart", pnl.MART).drop(pnl.MART_TS)
    raise AssertionError("a malformed amount was loaded")


def raw_append_recommented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appending goes on after the table's comment was replaced, as loads are known from the job's log."""
    job = new_job(spark, "recommented", lineage=False)
    journal = RawTables(spark, sf_dir)["acdoca"]
    late = F.coalesce(F.col("MONAT") > "06", F.lit(False))
    for batch in (journal.filter(~late), journal.filter(late)):
        landing.land(batch, "ACDOCA", job.landing, mode="append")
        layers.refresh_raw(spark, job, ["ACDOCA"], append=True)
        layers.set_comment(spark, job, "raw", "acdoca", "The general ledger")
    return layers.read_layer(spark, job, "raw", "acdoca")


def raw_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the job's log says of two loads, and that a third one is refused while a run hasn't ended."""
    job = new_job(spark, "loads", lineage=False)
    journal = RawTables(spark, sf_dir)["acdoca"]
    late = F.coalesce(F.col("MONAT") > "06", F.lit(False))
    for batch in (journal.filter(~late), journal.filter(late)):
        landing.land(batch, "ACDOCA", job.landing, mode="append")
        layers.refresh_raw(spark, job, ["ACDOCA"], append=True)
    try:
        with layers.begun(spark, job):
            layers.refresh_raw(spark, job, ["ACDOCA"], append=True)
        refused = False
    except runs.ConcurrentRun:
        refused = True
    noted = layers.loads(layers.log_of(spark, job), "acdoca")
    rows = [(r["batch"], r["rows"], sum(f["rows"] for f in r["files"]), refused) for r in noted]
    return spark.createDataFrame(rows, "batch int, row_count long, rows_in_files long, next_refused boolean")


def raw_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of extracts of two orders of columns, one with a column that the contract doesn't have."""
    customers = RawTables(spark, sf_dir)["kna1"]
    path = landing.source_path(scratch_folder(spark, "reconciled"), "KNA1")
    other = F.expr("CAST(KUNNR AS BIGINT) % 3 = 0")
    first, second = customers.filter(~other), customers.filter(other)
    turned = second.select(*reversed(second.columns), F.col("KUNNR").alias("OLD_ID"))
    for part in (first, turned):
        part.write.mode("append").option("header", True).csv(path)
    return landing.read_reconciled(spark, "KNA1", path, lineage=False)


def layers_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each layer's published tables after a refresh that loaded more lines and then failed in the mart."""
    job = landed_job(spark, sf_dir, "snapshot")
    layers.refresh(spark, job)
    landing.land(RawTables(spark, sf_dir)["acdoca"], "ACDOCA", job.landing, mode="append")
    stage, layers.stage_mart = layers.stage_mart, lambda *_: (_ for _ in ()).throw(ArithmeticError("no mart"))
    try:
        layers.refresh(spark, job, append=True)
    except ArithmeticError:
        pass
    finally:
        layers.stage_mart = stage
    shown = (("raw", "acdoca"), ("conformed", postings.FACT), ("mart", pnl.MART))
    return reduce(DataFrame.unionAll, [layers.read_layer(spark, job, *table).agg(F.lit(".".join(table)).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for table in shown])


def mart_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart of two loads, of which the second is all that is read for it."""
    job = new_job(spark, "by_load", lineage=False)
    raw = RawTables(spark, sf_dir)
    late = F.coalesce(F.col("MONAT") > "06", F.lit(False))
    for name, table in raw.items():
        landing.land(table.filter(~late) if name == "acdoca" else table, name.upper(), job.landing)
    first = increments.refresh_by_load(spark, job)
    landing.land(raw["acdoca"].filter(late), "ACDOCA", job.landing, mode="append")
    second = increments.refresh_by_load(spark, job)
    assert (first, second) == ([0], [1])
    return layers.read_layer(spark, job, "mart", pnl.MART).drop(pnl.MART_TS)


def mart_after_retraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart after a load that had half of the journal twice was taken back."""
    job = landed_job(spark, sf_dir, "retracted")
    increments.refresh_by_load(spark, job)
    again = RawTables(spark, sf_dir)["acdoca"].filter("MONAT > '06'")
    landing.land(again, "ACDOCA", job.landing, mode="append")
    increments.refresh_by_load(spark, job)
    wrong = layers.loads(layers.log_of(spark, job), "acdoca")[-1]
    layers.retract(spark, job, "ACDOCA", wrong["files"][0]["file"])
    assert increments.refresh_merged(spark, job) == []
    return layers.read_layer(spark, job, "mart", pnl.MART).drop(pnl.MART_TS)


def quarantine_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal lines with those taken back that had no document, under a document of their company, sent twice."""
    job = new_job(spark, "replayed")
    rules = RULES[postings.FACT]
    lines = postings.journal_lines(RawTables(spark, sf_dir)["acdoca"])
    repairs.set_aside(spark, job, "journal", lines, rules, "first")
    broken = repairs.set_aside_rows(spark, job, "journal")
    fixed = broken.withColumns({"document_number": F.coalesce("document_number", F.lit("CORRECTED")), "fiscal_year": F.coalesce("fiscal_year", F.lit("2024"))})
    for _ in range(2):
        repairs.take_back(spark, job, "journal", fixed.select(*lines.columns, repairs.ID), rules)
    return repairs.repaired(spark, job, "journal", lines, rules)


def names_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw table under a schema that the session's settings name."""
    job = new_job(spark, "names", lineage=False)
    for layer, schema in job.schemas.items():
        spark.conf.set(f"ledgerloom.schema.{layer}", schema)
    try:
        job = replace(job, schemas=layers.schemas_of(spark))
    finally:
        for layer in job.schemas:
            spark.conf.unset(f"ledgerloom.schema.{layer}")
    landing.land(RawTables(spark, sf_dir)["kna1"], "KNA1", job.landing)
    layers.refresh_raw(spark, job, ["KNA1"])
    return spark.table(f"{job.schemas['raw']}.kna1")


def table_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored dimension's rows with its table's comment."""
    job = new_job(spark, "comment")
    layers.save(dim("customer", spark, sf_dir), job, "conformed", "customer", "Dimension customer.")
    comment = spark.catalog.getTable(job.table("conformed", "customer")).description
    return layers.read_layer(spark, job, "conformed", "customer").withColumn("table_comment", F.lit(comment))


# Conformed layer -----------------------------------------------------------------------


def dim(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension(name, RawTables(spark, sf_dir)).drop(CONFORMED_TS)


def posting(only: tuple[str, ...] | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.postings(RawTables(spark, sf_dir), only).drop(CONFORMED_TS)


def postings_header_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with their header, joined where both are stored."""
    root = scratch_folder(spark, "documents")
    tables = [f"spark_catalog.default.{t}_{root.rsplit('-', 1)[1]}" for t in ("lines", "headers")]
    documents.store_documents(spark, RawTables(spark, sf_dir), *tables, root)
    return postings.ordered(enforce(documents.lines_with_header(spark, *tables), RULES[postings.FACT]))


def postings_full_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole fact out of journal and headers that are stored side by side."""
    root = scratch_folder(spark, "fact")
    tables = [f"spark_catalog.default.{t}_{root.rsplit('-', 1)[1]}" for t in ("lines", "headers")]
    raw = RawTables(spark, sf_dir)
    documents.store_documents(spark, raw, *tables, root)
    lines = enforce(documents.lines_with_header(spark, *tables), RULES[postings.FACT])
    return postings.ordered(postings.enrich(lines, raw, [name for name in postings.SIDES if name not in HEADER], keys=spark.table(tables[0])))


def postings_commercial_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and materials joined by key, as if they were too large to broadcast; lines without one stay in place."""
    spark.conf.set(BROADCAST_KEY, "0")
    try:
        return posting(COMMERCIAL, spark, sf_dir)
    finally:
        spark.conf.unset(BROADCAST_KEY)


def postings_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stored postings have each of the three metadata columns, and a load time no later than that of the fact."""
    job = landed_job(spark, sf_dir, "metadata")
    layers.refresh_raw(spark, job)
    layers.refresh_conformed(spark, job)
    fact = layers.read_layer(spark, job, "conformed", postings.FACT)
    return fact.agg(
        F.count("bronze_ingestion_ts").alias("with_load_time"),
        F.count_if(F.col("bronze_source_file").contains("/ACDOCA.csv/")).alias("with_source_file"),
        F.count(CONFORMED_TS).alias("with_conformed_time"),
        F.count_if(F.col("bronze_ingestion_ts") <= F.col(CONFORMED_TS)).alias("in_order"),
    )


# Data quality --------------------------------------------------------------------------


def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = RawTables(spark, sf_dir)
    reports_ = [report(dimension_rows(name, raw), RULES[name], name) for name in DIMENSION_NAMES]
    reports_.append(postings.posting_report(raw))
    mart = pnl.mart_rows(pnl.direct_sums_from_journal(raw))
    reports_.append(report(mart, RULES[pnl.MART], pnl.MART))
    return reduce(DataFrame.unionByName, reports_)


def dq_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RULES[postings.FACT]
    lines = postings.journal_lines(RawTables(spark, sf_dir)["acdoca"])
    counted, observation = observe(lines, rules, "journal rules")
    enforce(counted, rules).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(list(observation.get.items()), "metric string, value bigint")


def dq_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = postings.journal_lines(RawTables(spark, sf_dir)["acdoca"])
    return enforce(lines, RULES[postings.FACT])


def dq_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = postings.journal_lines(RawTables(spark, sf_dir)["acdoca"])
    rows = quarantine(lines, RULES[postings.FACT])
    return rows.withColumn("failed_rules", F.array_join("failed_rules", ","))


# Mart and reports ----------------------------------------------------------------------


def direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.direct_lines_from_journal(RawTables(spark, sf_dir))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.wide_lines(direct(spark, sf_dir))


def mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.profit_and_loss_from_journal(RawTables(spark, sf_dir)).drop(pnl.MART_TS)


def mart_from_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = postings.postings(RawTables(spark, sf_dir), MART_SIDES)
    return pnl.profit_and_loss(facts).drop(pnl.MART_TS)


def over_mart(build: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(mart(spark, sf_dir))


def filtered(rows: DataFrame) -> DataFrame:
    return reports.select_filters(
        rows,
        year=[1999, 2000],
        period=[1, 2, 3, 4, 5, 6],
        version="ACT",
        company=["C1", "C2", "C3"],
        division="02",
        channel="10",
        sales_org=["S1", "S3"],
    )


def filtered_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered mart out of those files of the stored fact that may have rows for it."""
    folder, by = scratch_folder(spark, "clustered"), ["fiscal_year", "company_code"]
    clustered.write_postings(RawTables(spark, sf_dir), folder, by, MART_SIDES)
    facts = clustered.read_clustered(spark, folder, by, {"fiscal_year": ["1999", "2000"], "company_code": ["C1", "C2", "C3"]})
    return filtered(pnl.profit_and_loss(facts).drop(pnl.MART_TS))


def entry(spark: SparkSession) -> DataFrame:
    """The P&L by company, period, version, channel, division and sales organisation."""
    return mart(spark, FLAGSHIP_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "raw_roundtrip": raw_roundtrip,
        "raw_tables": raw_all_tables,
        "raw_lineage": raw_lineage,
        "raw_permissive_rescue": raw_permissive_rescue,
        "raw_unregistered": raw_unregistered,
        "raw_append": raw_append,
        "raw_text_kept": raw_text_kept,
        "layer_refresh": layer_refresh,
        "layer_refresh_rescued": layer_refresh_rescued,
        "refresh_after_failure": refresh_after_failure,
        "raw_append_recommented": raw_append_recommented,
        "raw_loads": raw_loads,
        "raw_reconciled": raw_reconciled,
        "layers_after_failure": layers_after_failure,
        "names_override": names_override,
        "table_comment": table_comment,
        **{f"dim_{name}": partial(dim, name) for name in DIMENSION_NAMES},
        "postings_header": partial(posting, HEADER),
        "postings_account_line": partial(posting, ACCOUNT_LINE),
        "postings_org": partial(posting, ORG),
        "postings_commercial": partial(posting, COMMERCIAL),
        "postings_full": partial(posting, None),
        "postings_header_stored": postings_header_stored,
        "postings_full_stored": postings_full_stored,
        "postings_commercial_shuffled": postings_commercial_shuffled,
        "postings_metadata": postings_metadata,
        "dq_report": dq_report,
        "dq_observed": dq_observed,
        "dq_drop": dq_drop,
        "dq_quarantine": dq_quarantine,
        "quarantine_replayed": quarantine_replayed,
        "mart_after_append": mart_after_append,
        "mart_after_retraction": mart_after_retraction,
        "pnl_direct": direct,
        "pnl_wide": wide,
        "pnl_mart": mart,
        "pnl_mart_from_postings": mart_from_postings,
        "pnl_kpis": partial(over_mart, reports.kpis),
        "pnl_margin": partial(over_mart, reports.margins),
        "pnl_variance": partial(over_mart, reports.variance),
        "pnl_trend": partial(over_mart, reports.trend),
        "pnl_mom": partial(over_mart, reports.month_over_month),
        "pnl_waterfall": partial(over_mart, reports.waterfall),
        "pnl_channel_share": partial(over_mart, reports.channel_share),
        "pnl_filtered": partial(over_mart, filtered),
        "pnl_filtered_stored": filtered_stored,
        **(llm.queries() if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    return oracle_queries.statements() | (llm.oracle_sql() if llm else {})
