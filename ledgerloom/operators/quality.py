"""Data-quality rules: named predicates that either drop a row or only count a violation.

A predicate that is neither true nor false (NULL) counts as violated.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

DROP = "drop"
WARN = "warn"
ROWS = "rows"


@dataclass(frozen=True)
class Rule:
    """``predicate`` is a Spark SQL condition over the columns of the model it belongs to."""

    name: str
    predicate: str
    action: str = WARN

    def holds(self) -> Column:
        return F.coalesce(F.expr(self.predicate), F.lit(False))

    def violated(self) -> Column:
        return ~self.holds()


def enforce(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Keep the rows that satisfy every drop rule."""
    for rule in rules:
        if rule.action == DROP:
            df = df.filter(rule.predicate)
    return df


def observe(df: DataFrame, rules: Sequence[Rule], name: str) -> tuple[DataFrame, Observation]:
    """Count rows and violations while the frame is computed for another purpose.

    Read the counts from the observation after an action; call before :func:`enforce`.
    """
    observation = Observation(name)
    counts = [F.count_if(rule.violated()).alias(rule.name) for rule in rules]
    return df.observe(observation, F.count(F.lit(1)).alias(ROWS), *counts), observation


def report(df: DataFrame, rules: Sequence[Rule], table: str) -> DataFrame:
    """One row per rule with its number of violations; a single aggregation over ``df``."""
    counts = df.agg(*[F.count_if(rule.violated()).alias(rule.name) for rule in rules])
    lines = F.array(
        *[
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(rule.name).alias("rule_name"),
                F.lit(rule.action).alias("action"),
                F.col(rule.name).alias("violations"),
            )
            for rule in rules
        ]
    )
    return counts.select(F.inline(lines))


def quarantine(df: DataFrame, rules: Sequence[Rule], column: str = "failed_rules") -> DataFrame:
    """The rows that violate any rule, with the names of the rules they violate."""
    failed = F.array_compact(F.array(*[F.when(rule.violated(), rule.name) for rule in rules]))
    return df.withColumn(column, failed).filter(F.size(column) > 0)
