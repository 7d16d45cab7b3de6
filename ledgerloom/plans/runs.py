"""Runs: loads and refreshes that begin, stage tables and publish them in one step.

A job's log holds every run. A run that has begun and not ended keeps others out; its tables are staged, each as a
new folder or as further batches of one, and become the job's tables by a single record that names all of them. So
all layers of a refresh appear together, or none does. The catalog's views follow right after; should
that be cut short, the next run puts them right, and ``read`` goes by the log alone.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.commits import CommitLog, Conflict, Record

#: Every load's rows lie in a folder of their own; the name is no column of the table.
BATCH = "_batch"
#: Stored rows take about half the room that the session's default, snappy, leaves them, in the same time.
STORED = {"compression": "zstd"}
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class ConcurrentRun(RuntimeError):
    """Another run of the same job hasn't ended."""


@dataclass(frozen=True)
class State:
    """What a table shows: the columns of a folder, or of its batches up to a number but for the retracted ones."""

    folder: str
    columns: tuple[str, ...]
    comment: str
    batches: int | None = None
    retracted: tuple[int, ...] = ()
    #: The columns that the files hold ranges of.
    clustered: tuple[str, ...] = ()

    def select(self) -> str:
        columns = ", ".join(f"`{c}`" for c in self.columns)
        return f"SELECT {columns} FROM parquet.`{self.folder}`{self.where()}"

    def where(self) -> str:
        if self.batches is None:
            return ""
        without = "".join(f" AND {BATCH} <> {n}" for n in self.retracted)
        return f" WHERE {BATCH} <= {self.batches}{without}"

    @staticmethod
    def of(record: Record) -> State:
        return State(**{k: tuple(v) if isinstance(v, list) else v for k, v in record.items()})


class Run:
    """A run that has begun. Tables are named ``layer.table``."""

    def __init__(self, spark: SparkSession, log: CommitLog, name: str):
        self.spark, self.log, self.name = spark, log, name
        self.staged: dict[str, State] = {}

    def note(self, event: str, **details) -> None:
        self.log.append({"event": event, "run": self.name, **details})

    def state(self, table: str) -> State | None:
        """What this run has staged of a table, else what is published."""
        return self.staged.get(table) or published(self.log).get(table)

    def read(self, table: str) -> DataFrame:
        state = self.state(table)
        if state is None:
            raise KeyError(f"{table} was never published")
        return self.spark.sql(state.select())


def states_of(record: Record) -> dict[str, State]:
    return {table: State.of(state) for table, state in record["tables"].items()}


def publications(log: CommitLog) -> list[Record]:
    """The records that published tables, in order; each holds all of the job's tables at its time."""
    return [r for r in log.records() if r["event"] == "publish"]


def published(log: CommitLog, run: str | None = None) -> dict[str, State]:
    """The job's tables as last published, or as ``run`` published them."""
    for record in reversed(publications(log)):
        if run is None or record["run"] == run:
            return states_of(record)
    return {}


def open_run(log: CommitLog, stale_after: float) -> Record | None:
    """The run that has begun and not ended, unless it began ``stale_after`` seconds ago."""
    begun: dict[str, Record] = {}
    for record in log.records():
        if record["event"] == "begin":
            begun[record["run"]] = record
        elif record["event"] == "end":
            begun.pop(record["run"], None)
    return next((r for r in begun.values() if time.time() - r["time"] < stale_after), None)


def show(spark: SparkSession, names: Mapping[str, str], tables: Mapping[str, State]) -> None:
    """Point the catalog's views at ``tables``; ``names`` are the views' full names."""
    for table, state in tables.items():
        comment = state.comment.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE OR REPLACE VIEW {names[table]} COMMENT '{comment}' AS {state.select()}")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within the block, what a query shuffled is removed as soon as the query is done, not when the driver forgets about it."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def running(spark: SparkSession, log: CommitLog, name_of, stale_after: float) -> Iterator[Run]:
    """A run; what it staged is published when the block ends, and forgotten if it fails.

    ``name_of`` gives the full name of a table's view.
    """
    number = len(log.records())
    if other := open_run(log, stale_after):
        raise ConcurrentRun(f"run {other['run']} of {log.folder} hasn't ended")
    run = Run(spark, log, uuid.uuid4().hex)
    try:
        log.append({"event": "begin", "run": run.name}, number)
    except Conflict as error:
        raise ConcurrentRun(f"another run of {log.folder} has just begun") from error
    try:
        before = publications(log)
        if before and not any(r["event"] == "shown" and r["publication"] == before[-1]["publication"] for r in log.records()):
            tables = states_of(before[-1])
            show(spark, {t: name_of(t) for t in tables}, tables)
        with shuffles_removed(spark):
            yield run
        if run.staged:
            tables = {**published(log), **run.staged}
            mark = uuid.uuid4().hex
            run.note("publish", publication=mark, tables={t: asdict(s) for t, s in tables.items()})
            show(spark, {t: name_of(t) for t in run.staged}, run.staged)
            run.note("shown", publication=mark)
    finally:
        run.note("end")
