"""The mart kept up to date load by load.

Amounts only ever add up, so every load of the journal leaves its own sums, by reporting key and account and without
names, lines or signs. The mart is those sums merged: a new load adds its rows, a retracted one takes its own away, and neither has
the journal of other loads read again. What accounts map to, and what things are called, is joined to the
merged sums, so a change there reaches all of the past.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.quality import enforce
from ledgerloom.operators.star import join_hints, star
from ledgerloom.plans.dimensions import Raw
from ledgerloom.plans.layers import Job, begun, loads, raw_tables, stage_mart, stage_raw
from ledgerloom.plans.pnl import AMOUNT_EUR, GROUP, KEYS, account_sides, line_keys, mart_rows, name_sides
from ledgerloom.plans.postings import FACT, journal_lines
from ledgerloom.plans.rules import RULES
from ledgerloom.plans.runs import BATCH, STORED, Run, State
from ledgerloom.sources.contracts import CONTRACTS

JOURNAL_TABLE = "acdoca"
AMOUNT = "amount_group_currency"
#: Wide enough for the sum of any number of lines.
SUM = "decimal(38,2)"


def load_sums(journal: DataFrame, lenient: bool = False) -> DataFrame:
    """Amounts of a load's lines by reporting key and account. A sum of nothing but missing amounts is missing."""
    lines = enforce(journal_lines(journal, lenient), RULES[FACT])
    return lines.groupBy(*KEYS, "account_id").agg(F.sum(AMOUNT).cast(SUM).alias(AMOUNT))


def merged_lines(sums: DataFrame, raw: Raw) -> DataFrame:
    """The mart's direct lines out of the sums of any number of loads."""
    merged = sums.groupBy(*KEYS, "account_id").agg(F.sum(AMOUNT).alias(AMOUNT))
    accounts, names = account_sides(raw), name_sides(raw)
    hints = join_hints(merged.sparkSession, [*accounts, *names])
    own = star(merged, accounts, ("fiscal_year", "fiscal_period"), hints)
    signed = F.sum(F.col(AMOUNT) * F.col("pnl_sign")).cast(SUM).alias(AMOUNT_EUR)
    own = own.groupBy(*KEYS, "pnl_line_id").agg(signed)
    return star(own, names, ("fiscal_year", "fiscal_period"), hints).select(*GROUP, *line_keys(), AMOUNT_EUR)


def _folder(job: Job, generation: str, batch: int) -> str:
    return f"{job.folder('mart', '_sums')}/{generation}/{BATCH}={batch}"


def stage_sums(run: Run, job: Job) -> list[int]:
    """Store the sums of the journal's loads that have none yet; returns their batches."""
    state = run.state(f"raw.{JOURNAL_TABLE}")
    generation = state.folder.rsplit("/", 1)[1]
    done = {r["batch"] for r in run.log.records() if r["event"] == "sums" and r["generation"] == generation}
    new = [n for n in active_batches(run, state) if n not in done]
    for batch in new:
        journal = run.spark.read.parquet(f"{state.folder}/{BATCH}={batch}")
        load_sums(journal, job.lenient).write.mode("overwrite").options(**STORED).parquet(_folder(job, generation, batch))
        run.note("sums", generation=generation, batch=batch)
    return new


def active_batches(run: Run, state: State) -> list[int]:
    """The loads that the journal shows."""
    generation = state.folder.rsplit("/", 1)[1]
    found = {r["batch"] for r in loads(run.log, JOURNAL_TABLE) if r["generation"] == generation}
    return sorted(n for n in found if n <= (state.batches or 0) and n not in state.retracted)


def stage_merged_mart(run: Run, job: Job) -> dict[str, dict[str, int]]:
    """The mart out of the sums of the loads that the journal shows."""
    state = run.state(f"raw.{JOURNAL_TABLE}")
    generation = state.folder.rsplit("/", 1)[1]
    batches = active_batches(run, state)
    schema = f"{', '.join(f'{k} {t}' for k, t in _key_types())}, {AMOUNT} {SUM}"
    sums = run.spark.read.schema(schema).parquet(*[_folder(job, generation, n) for n in batches]) if batches else run.spark.createDataFrame([], schema)
    return stage_mart(run, job, mart_rows(merged_lines(sums, raw_tables(run))))


def _key_types() -> list[tuple[str, str]]:
    return [(k, "int" if k == "fiscal_period" else "string") for k in (*KEYS, "account_id")]


def refresh_by_load(spark: SparkSession, job: Job, append: bool = True) -> list[int]:
    """Load what has landed, sum up the new loads of the journal and publish raw tables and mart together.

    Returns the journal's loads that were read.
    """
    with begun(spark, job) as run:
        stage_raw(run, job, tuple(CONTRACTS), append)
        read = stage_sums(run, job)
        stage_merged_mart(run, job)
    return read


def refresh_merged(spark: SparkSession, job: Job) -> list[int]:
    """The mart again, after loads were retracted; returns the loads that were read, none unless some had no sums."""
    with begun(spark, job) as run:
        read = stage_sums(run, job)
        stage_merged_mart(run, job)
    return read
