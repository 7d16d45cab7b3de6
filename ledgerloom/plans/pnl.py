"""The profit-and-loss mart: signed amounts per reporting group and line, with subtotals."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.conform import account_type
from ledgerloom.operators.quality import enforce
from ledgerloom.operators.star import Side, join_hints, star
from ledgerloom.plans.dimensions import ACCOUNT_LINE, LINE, Raw
from ledgerloom.plans.postings import FACT, JOURNAL, SIDES, SPREAD_BY, journal_lines
from ledgerloom.plans.rules import RULES

MART = "profit_and_loss"
MART_TS = "gold_transformation_ts"

# The reporting group of the mart.
GROUP: tuple[str, ...] = (
    "company_code", "company_name", "company_country", "fiscal_year", "fiscal_period", "version",
    "distribution_channel_id", "distribution_channel_name", "division_id", "division_name", "sales_org_id",
    "sales_org_name",
)
KEYS = tuple(name for name in GROUP if name in JOURNAL)
LINE_COLUMNS = ("pnl_line_id", "pnl_line_name", "sort_order", "line_type")

# Which lines add up to the parts that subtotals are made of.
PARTS: dict[str, tuple[str, ...]] = {
    "pl01": ("PL01",),
    "pl02": ("PL02",),
    "pl04": ("PL04",),
    "opex_bundle": ("PL06", "PL07", "PL08", "PL09", "PL10", "PL11", "PL12"),
    "pl13": ("PL13",),
}

# Subtotal line, its name, its position and its parts.
SUBTOTALS: tuple[tuple[str, str, int, tuple[str, ...]], ...] = (
    ("PL03", "Net Sales", 30, ("pl01", "pl02")),
    ("PL05", "Gross Profit", 50, ("pl01", "pl02", "pl04")),
    ("PL14", "EBITDA", 140, ("pl01", "pl02", "pl04", "opex_bundle")),
    ("PL15", "EBIT", 150, ("pl01", "pl02", "pl04", "opex_bundle", "pl13")),
)
SUBTOTAL_TYPE = "calc"

AMOUNT_EUR = "amount_eur"


def line_keys() -> list[Column]:
    """The line columns under the names they have in the mart."""
    source = {"sort_order": "pnl_sort_order", "line_type": "pnl_line_type"}
    return [F.col(source.get(name, name)).alias(name) for name in LINE_COLUMNS]


def signed_amount() -> Column:
    return F.sum(F.col("amount_group_currency") * F.col("pnl_sign")).alias(AMOUNT_EUR)


def direct_lines(postings: DataFrame) -> DataFrame:
    """Signed amounts of mapped P&L postings per reporting group and line."""
    reported = postings.filter("account_type = 'P&L' AND pnl_line_id IS NOT NULL")
    return reported.groupBy(*GROUP, *line_keys()).agg(signed_amount())


def account_sides(raw: Raw) -> list[tuple[Side, DataFrame]]:
    """What leaves the lines of mapped P&L accounts, with their statement line and sign."""
    return [
        (SIDES["ska1"].only().required(), raw["ska1"].filter(account_type() == "P&L")),
        (ACCOUNT_LINE.required(), raw[ACCOUNT_LINE.name].filter(F.col("PNL_LINE_ID").isNotNull())),
    ]


def name_sides(raw: Raw) -> list[tuple[Side, DataFrame]]:
    """What gives names to sums."""
    return [
        (LINE, raw[LINE.name]),
        (SIDES["t001"].only("company_name", "company_country"), raw["t001"]),
        (SIDES["tvtw"], raw["tvtw"]),
        (SIDES["tspa"], raw["tspa"]),
        (SIDES["tvko"], raw["tvko"]),
    ]


def direct_sums_from_journal(raw: Raw, lenient: bool = False) -> DataFrame:
    """Signed amounts straight from the raw tables, summed by key before names are joined.

    Only sums are shuffled and named. Where a key has several names its sum appears under
    each of them, as its postings would; the rows are therefore still to be added up.
    """
    lines = enforce(journal_lines(raw["acdoca"], lenient), RULES[FACT])
    accounts, names = account_sides(raw), name_sides(raw)
    hints = join_hints(lines.sparkSession, [*accounts, *names])
    sums = star(lines, accounts, SPREAD_BY, hints).groupBy(*KEYS, "pnl_line_id").agg(signed_amount())
    named = star(sums, names, ("fiscal_year", "fiscal_period"), hints)
    return named.select(*GROUP, *line_keys(), AMOUNT_EUR)


def direct_lines_from_journal(raw: Raw) -> DataFrame:
    """The same rows as :func:`direct_lines`, without building the posting fact."""
    sums = direct_sums_from_journal(raw)
    return sums.groupBy(*GROUP, *LINE_COLUMNS).agg(F.sum(AMOUNT_EUR).alias(AMOUNT_EUR))


def part_sums() -> list[Column]:
    """The parts of the subtotals; a line that is absent counts as zero."""
    return [
        F.sum(F.when(F.col("pnl_line_id").isin(*lines), F.col(AMOUNT_EUR)).otherwise(0)).alias(part)
        for part, lines in PARTS.items()
    ]


def wide_lines(direct: DataFrame) -> DataFrame:
    """One row per reporting group with the parts of its subtotals."""
    return direct.groupBy(*GROUP).agg(*part_sums())


def line_struct(line: Column, name: Column, position: Column, kind: Column, amount: Column) -> Column:
    columns = zip((line, name, position, kind, amount), (*LINE_COLUMNS, AMOUNT_EUR), strict=True)
    return F.struct(*[column.alias(alias) for column, alias in columns])


def subtotal_lines() -> Column:
    """All subtotals of a row that holds their parts."""
    return F.array(
        *[
            line_struct(
                F.lit(line),
                F.lit(name),
                F.lit(position),
                F.lit(SUBTOTAL_TYPE),
                reduce(add, [F.col(part) for part in parts]),
            )
            for line, name, position, parts in SUBTOTALS
        ]
    )


def mart_rows(direct: DataFrame) -> DataFrame:
    """Direct lines and subtotals, before the mart's rules are applied.

    A reporting group gathers its own lines, of which there are as many as the statement has, and the sums
    its subtotals are made of; then all become rows. The input is read once, and filters on the
    group's columns pass down to it.
    """
    lines = direct.groupBy(*GROUP, *LINE_COLUMNS).agg(F.sum(AMOUNT_EUR).alias(AMOUNT_EUR))
    own_line = line_struct(*[F.col(c) for c in (*LINE_COLUMNS, AMOUNT_EUR)])
    groups = lines.groupBy(*GROUP).agg(F.collect_list(own_line).alias("own_lines"), *part_sums())
    return groups.select(*GROUP, F.inline(F.concat("own_lines", subtotal_lines())))


def finished(rows: DataFrame) -> DataFrame:
    """Mart rows with the drop rules applied and the load time appended."""
    return enforce(rows, RULES[MART]).select("*", F.current_timestamp().alias(MART_TS))


def profit_and_loss(postings: DataFrame) -> DataFrame:
    """The mart out of the stored posting fact."""
    return finished(mart_rows(direct_lines(postings)))


def profit_and_loss_from_journal(raw: Raw, lenient: bool = False) -> DataFrame:
    """The same mart straight from the raw tables, without building the fact."""
    return finished(mart_rows(direct_sums_from_journal(raw, lenient)))
