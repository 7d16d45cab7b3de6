"""Rows that drop rules keep out, stored with the rules they break until corrected rows take their place.

A quarantined row has an id that it keeps. Corrected rows name the id they are for; each id is taken back once,
by the first correction that satisfies the rules, however often corrections are sent.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.quality import DROP, Rule, enforce, quarantine
from ledgerloom.plans.layers import Job, begun
from ledgerloom.plans.runs import BATCH, STORED, Run, State

ID, RULES_BROKEN, LOAD = "_quarantine_id", "_failed_rules", "_load"


def _stage_batch(run: Run, job: Job, table: str, rows: DataFrame, comment: str) -> None:
    """Further rows of a table of the conformed layer."""
    last = run.state(f"conformed.{table}")
    folder = last.folder if last else f"{job.folder('conformed', table)}/{uuid.uuid4().hex}"
    number = last.batches + 1 if last else 0
    rows.write.mode("overwrite").options(**STORED).parquet(f"{folder}/{BATCH}={number}")
    run.staged[f"conformed.{table}"] = State(folder, tuple(rows.columns), comment, number)


def dropped(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that break a drop rule, with the names of those they break."""
    return quarantine(rows, [rule for rule in rules if rule.action == DROP], RULES_BROKEN)


def set_aside(spark: SparkSession, job: Job, table: str, rows: DataFrame, rules: Sequence[Rule], load: str) -> None:
    """Store what the drop rules keep out of ``rows``, as rows of ``load``. A load is set aside once."""
    with begun(spark, job) as run:
        if any(r["event"] == "quarantine" and (r["table"], r["load"]) == (table, load) for r in run.log.records()):
            return
        kept = dropped(rows, rules).withColumns({ID: F.concat(F.lit(f"{load}/"), F.monotonically_increasing_id()), LOAD: F.lit(load)})
        _stage_batch(run, job, f"{table}_quarantine", kept, f"Rows kept out of {table}, by load and rule.")
        run.note("quarantine", table=table, load=load)


def set_aside_rows(spark: SparkSession, job: Job, table: str) -> DataFrame:
    """What is still kept out of ``table``."""
    with_rules = spark.table(job.table("conformed", f"{table}_quarantine"))
    taken = taken_back(spark, job, table)
    return with_rules if taken is None else with_rules.join(taken.select(ID), ID, "left_anti")


def taken_back(spark: SparkSession, job: Job, table: str) -> DataFrame | None:
    """The corrected rows of ``table`` with the ids they are for; none if nothing was corrected so far."""
    name = job.table("conformed", f"{table}_repaired")
    return spark.table(name) if spark.catalog.tableExists(name) else None


def take_back(spark: SparkSession, job: Job, table: str, corrected: DataFrame, rules: Sequence[Rule]) -> None:
    """Keep the corrected rows (the table's columns and ID) that satisfy the drop rules and are the first for their id."""
    with begun(spark, job) as run:
        waiting = run.read(f"conformed.{table}_quarantine").select(ID)
        if run.state(f"conformed.{table}_repaired"):
            waiting = waiting.join(run.read(f"conformed.{table}_repaired").select(ID), ID, "left_anti")
        fit = enforce(corrected, rules).join(waiting, ID, "left_semi")
        # Of several corrections for one id the first by all of its columns.
        order = Window.partitionBy(ID).orderBy(F.to_json(F.struct("*")))
        fit = fit.withColumn("_turn", F.row_number().over(order)).filter("_turn = 1").drop("_turn")
        _stage_batch(run, job, f"{table}_repaired", fit, f"Corrected rows of {table}.")


def repaired(spark: SparkSession, job: Job, table: str, rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rows`` that satisfy the drop rules, and the corrected ones."""
    kept, back = enforce(rows, rules), taken_back(spark, job, table)
    return kept if back is None else kept.unionByName(back.select(*kept.columns))
