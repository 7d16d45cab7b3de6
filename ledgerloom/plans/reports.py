"""The questions usually asked of the P&L mart.

Each starts with one aggregation of the mart, whose partial sums run before any shuffle.
The windows after it see a few rows per version: one per period, line or channel.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The lines behind the headline figures.
KPI_LINES: dict[str, str] = {
    "gross_sales": "PL01",
    "net_sales": "PL03",
    "gross_profit": "PL05",
    "ebitda": "PL14",
}

# Filter name and the mart column it acts on.
FILTERS: dict[str, str] = {
    "year": "fiscal_year",
    "period": "fiscal_period",
    "version": "version",
    "company": "company_code",
    "division": "division_id",
    "channel": "distribution_channel_id",
    "sales_org": "sales_org_id",
}

RATIO_DIGITS = 6


def amount_of(line: str) -> Column:
    return F.sum(F.when(F.col("pnl_line_id") == line, F.col("amount_eur")))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """A rounded quotient; NULL where the denominator is zero."""
    over = [F.col(c) if isinstance(c, str) else c for c in (part, whole)]
    quotient = F.try_divide(over[0].cast("double"), over[1].cast("double"))
    return F.round(quotient, RATIO_DIGITS)


def select_filters(mart: DataFrame, **values: Any) -> DataFrame:
    """Restrict the mart by any of the seven global filters; a list means any of its values."""
    for name, value in values.items():
        if value is None:
            continue
        many = isinstance(value, Iterable) and not isinstance(value, str)
        # All filtered columns but the period are text, including the year.
        convert = int if name == "period" else str
        mart = mart.filter(F.col(FILTERS[name]).isin(*[convert(v) for v in (value if many else [value])]))
    return mart


def kpis(mart: DataFrame, by: Sequence[str] = ("version",)) -> DataFrame:
    """Headline figures per version."""
    wanted = mart.filter(F.col("pnl_line_id").isin(*KPI_LINES.values()))
    return wanted.groupBy(*by).agg(*[amount_of(line).alias(name) for name, line in KPI_LINES.items()])


def margins(mart: DataFrame) -> DataFrame:
    """Gross profit and EBITDA as shares of net sales, per version."""
    return kpis(mart).select(
        "version",
        ratio("gross_profit", "net_sales").alias("gross_margin"),
        ratio("ebitda", "net_sales").alias("ebitda_margin"),
    )


def variance(mart: DataFrame, actual: str = "ACT", budget: str = "BUD") -> DataFrame:
    """Actual against budget per P&L line."""

    def total(version: str) -> Column:
        return F.coalesce(
            F.sum(F.when(F.col("version") == version, F.col("amount_eur"))),
            F.lit(0).cast("decimal(38,2)"),
        )

    lines = (
        mart.filter(F.col("version").isin(actual, budget))
        .groupBy("pnl_line_id", "pnl_line_name", "sort_order")
        .agg(total(actual).alias("actual_eur"), total(budget).alias("budget_eur"))
        .withColumn("variance_eur", F.col("actual_eur") - F.col("budget_eur"))
    )
    return lines.withColumn("variance_pct", ratio("variance_eur", F.abs("budget_eur")))


def trend(mart: DataFrame) -> DataFrame:
    """Net sales and EBITDA per period and version."""
    shown = {name: KPI_LINES[name] for name in ("net_sales", "ebitda")}
    return (
        mart.filter(F.col("pnl_line_id").isin(*shown.values()))
        .groupBy("fiscal_year", "fiscal_period", "version")
        .agg(*[amount_of(line).alias(name) for name, line in shown.items()])
    )


def month_over_month(mart: DataFrame) -> DataFrame:
    """Change of net sales and EBITDA against the previous period that has any."""
    year = F.expr("try_cast(fiscal_year AS INT)")
    earlier = Window.partitionBy("version").orderBy(year, "fiscal_period")
    changes = {
        f"{name}_change": F.col(name) - F.lag(name).over(earlier) for name in ("net_sales", "ebitda")
    }
    return trend(mart).withColumns(changes)


def waterfall(mart: DataFrame) -> DataFrame:
    """Direct lines in report order, each with the running total before and after it."""
    calculated = F.upper("line_type").startswith("CALC")
    steps = (
        mart.filter(~calculated)
        .groupBy("version", "pnl_line_id", "pnl_line_name", "sort_order")
        .agg(F.sum("amount_eur").alias("amount_eur"))
    )
    so_far = (
        Window.partitionBy("version")
        .orderBy("sort_order", "pnl_line_id", "pnl_line_name")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    amount = F.coalesce("amount_eur", F.lit(0))
    return steps.withColumn("end_eur", F.sum("amount_eur").over(so_far)).withColumn(
        "start_eur", F.col("end_eur") - amount
    )


def channel_share(mart: DataFrame) -> DataFrame:
    """Each channel's part of its version's net sales."""
    channels = (
        mart.filter(F.col("pnl_line_id") == KPI_LINES["net_sales"])
        .groupBy("version", "distribution_channel_id", "distribution_channel_name")
        .agg(F.sum("amount_eur").alias("net_sales"))
    )
    whole = F.sum("net_sales").over(Window.partitionBy("version"))
    return channels.withColumn("share", ratio(F.col("net_sales"), whole))
