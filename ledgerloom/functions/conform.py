"""Typed projections from raw text columns to business columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A business column is either the name of a raw column, or that name with a type.
Source = str | tuple[str, str]

DATE_FORMAT = "yyyy-MM-dd"
AMOUNT = "decimal(18,2)"


def typed(source: Source, lenient: bool = False) -> Column:
    """A raw column as its business type.

    Strict conversion follows the session (under ANSI, malformed text stops the job);
    lenient conversion turns malformed text into NULL.
    """
    if isinstance(source, str):
        return F.col(source)
    name, kind = source
    column = F.col(name)
    if kind == "date":
        convert = F.try_to_date if lenient else F.to_date
        return convert(column, DATE_FORMAT)
    return column.try_cast(kind) if lenient else column.cast(kind)


def conform(df: DataFrame, columns: Mapping[str, Source], lenient: bool = False) -> DataFrame:
    """Project raw columns to business names and types; everything else is dropped."""
    return df.select(*[typed(source, lenient).alias(name) for name, source in columns.items()])


def account_type(profit_and_loss: str = "GVTYP", balance_sheet: str = "XBILK") -> Column:
    """Class of an account; the P&L mark wins, and an unknown account is ``OTHER``."""
    return (
        F.when(F.col(profit_and_loss) == "X", "P&L")
        .when(F.col(balance_sheet) == "X", "BS")
        .otherwise("OTHER")
    )
