"""Which side tables repeat a key, kept in the job's log by the state of each table.

Nothing is counted where a table hasn't changed. After loads were appended to a table of unique keys, the new keys are
held against each other and against the keys that were there; the latter are read, and not grouped again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.star import Side, duplicated_sides
from ledgerloom.plans.runs import BATCH, Run, State
from ledgerloom.sources.commits import Record


def _last(run: Run, table: str) -> Record | None:
    return next((r for r in reversed(run.log.records()) if r["event"] == "keys" and r["table"] == table), None)


def _keys(run: Run, side: Side, state: State, after: int = -1) -> DataFrame:
    """The side's whole keys in the loads of ``state`` after a number."""
    columns = [F.col(c) for c in side.on.values()]
    rows = run.spark.read.parquet(state.folder)
    if state.batches is not None:
        rows = rows.filter((F.col(BATCH) > after) & (F.col(BATCH) <= state.batches) & ~F.col(BATCH).isin([-1, *state.retracted]))
    return rows.select(*columns).dropna()


def _unique(run: Run, side: Side, state: State, known: Record | None) -> bool:
    if known and known["folder"] == state.folder and known["retracted"] == list(state.retracted) and state.batches is not None:
        if known["batches"] == state.batches or not known["unique"]:
            return known["unique"]
        added = _keys(run, side, state, after=known["batches"])
        if duplicated_sides([(side, added)]):
            return False
        before = _keys(run, side, replace(state, batches=known["batches"]))
        return added.join(before, list(side.on.values()), "left_semi").isEmpty()
    return not duplicated_sides([(side, _keys(run, side, state))])


def repeating(run: Run, sides: Sequence[Side]) -> set[str]:
    """The names of the sides whose raw tables repeat a key, counting only what isn't known from the log."""
    found = set()
    for side in sides:
        state = run.state(f"raw.{side.name}")
        known = _last(run, side.name)
        unique = _unique(run, side, state, known)
        now = {"folder": state.folder, "batches": state.batches, "retracted": list(state.retracted), "unique": unique}
        if not known or {k: known[k] for k in now} != now:
            run.note("keys", table=side.name, **now)
        if not unique:
            found.add(side.name)
    return found
