"""The eleven conformed dimensions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.conform import Source, account_type, conform
from ledgerloom.operators.quality import enforce
from ledgerloom.operators.star import Side, join_hints, star
from ledgerloom.plans.rules import RULES

Raw = Mapping[str, DataFrame]

CONFORMED_TS = "silver_transformation_ts"


@dataclass(frozen=True)
class Dimension:
    source: str
    columns: Mapping[str, Source]


# Business column <- raw column, with a type where it is not text.
DIMENSIONS: dict[str, Dimension] = {
    "division": Dimension("tspa", {"division_id": "SPART", "division_name": "VTEXT"}),
    "channel": Dimension("tvtw", {"channel_id": "VTWEG", "channel_name": "VTEXT"}),
    "sales_org": Dimension(
        "tvko",
        {"sales_org_id": "VKORG", "sales_org_name": "VTEXT", "company_code": "BUKRS", "country": "LAND1"},
    ),
    "company": Dimension(
        "t001",
        {
            "company_code": "BUKRS",
            "company_name": "BUTXT",
            "country": "LAND1",
            "local_currency": "WAERS",
            "chart_of_accounts": "KTOPL",
            "fiscal_year_variant": "PERIV",
            "city": "ORT01",
        },
    ),
    "plant": Dimension(
        "t001w",
        {
            "plant_id": "WERKS",
            "plant_name": "NAME1",
            "city": "ORT01",
            "country": "LAND1",
            "company_code": "BUKRS",
            "sales_org_id": "VKORG",
            "plant_type": "PTYPE",
        },
    ),
    "customer": Dimension(
        "kna1",
        {
            "customer_id": "KUNNR",
            "customer_name": "NAME1",
            "country": "LAND1",
            "city": "ORT01",
            "account_group": "KTOKD",
            "customer_class": "KUKLA",
        },
    ),
    "material": Dimension(
        "mara",
        {
            "material_id": "MATNR",
            "material_name": "MAKTX",
            "material_type": "MTART",
            "material_group": "MATKL",
            "division_id": "SPART",
            "base_uom": "MEINS",
            "product_hierarchy": "PRDHA",
            "brand": "BRAND",
            "season": "SAISO",
            "color": "COLOR",
            "size": "SIZE",
            "style": "STYLE",
        },
    ),
    "cost_center": Dimension(
        "csks",
        {
            "cost_center_id": "KOSTL",
            "controlling_area": "KOKRS",
            "company_code": "BUKRS",
            "valid_from": ("DATAB", "date"),
            "valid_to": ("DATBI", "date"),
            "cost_center_name": "KTEXT",
            "cost_center_long_name": "LTEXT",
            "cost_center_function": "KOSAR",
            "country": "LAND1",
        },
    ),
    "profit_center": Dimension(
        "cepc",
        {
            "profit_center_id": "PRCTR",
            "controlling_area": "KOKRS",
            "company_code": "BUKRS",
            "valid_from": ("DATAB", "date"),
            "valid_to": ("DATBI", "date"),
            "profit_center_name": "KTEXT",
            "profit_center_long_name": "LTEXT",
            "business_area": "GSBER",
            "country": "LAND1",
        },
    ),
    "pnl_line": Dimension(
        "dim_pnl_line",
        {
            "pnl_line_id": "PNL_LINE_ID",
            "pnl_line_name": "PNL_LINE_NAME",
            "sort_order": ("SORT_ORDER", "int"),
            "line_type": "LINE_TYPE",
        },
    ),
}

DIMENSION_NAMES = (*DIMENSIONS, "account")


# Sides shared by the account dimension and the posting fact.
ACCOUNT_LINE = Side(
    "map_account_to_pnl_line",
    {"account_id": "SAKNR"},
    {"pnl_line_id": "PNL_LINE_ID", "pnl_sign": ("SIGN", "int")},
    bounded=True,
)
LINE = Side(
    "dim_pnl_line",
    {"pnl_line_id": "PNL_LINE_ID"},
    {
        "pnl_line_name": "PNL_LINE_NAME",
        "pnl_sort_order": ("SORT_ORDER", "int"),
        "pnl_line_type": "LINE_TYPE",
    },
    bounded=True,
)


def account(raw: Raw) -> DataFrame:
    """Account master with its class and the P&L line it rolls up to."""
    master = raw["ska1"].select(
        F.col("SAKNR").alias("account_id"),
        F.col("TXT50").alias("account_name"),
        F.col("TXT20").alias("account_short_name"),
        F.col("KTOKS").alias("account_group"),
        account_type().alias("account_type"),
    )
    mapping, lines = [(side, raw[side.name]) for side in (ACCOUNT_LINE, LINE)]
    hints = join_hints(master.sparkSession, [mapping, lines])
    mapped = star(master, [mapping], ["account_name"], hints)
    lined = star(mapped, [lines], ["account_id"], hints)
    return lined.select(
        *master.columns,
        "pnl_line_id",
        "pnl_line_name",
        "pnl_sort_order",
        "pnl_line_type",
        "pnl_sign",
    )


def dimension_rows(name: str, raw: Raw, lenient: bool = False) -> DataFrame:
    """A dimension before its rules are applied."""
    if name == "account":
        return account(raw)
    spec = DIMENSIONS[name]
    return conform(raw[spec.source], spec.columns, lenient)


def dimension(name: str, raw: Raw, lenient: bool = False) -> DataFrame:
    """A dimension with its drop rules applied and its load time appended."""
    rows = enforce(dimension_rows(name, raw, lenient), RULES[name])
    return rows.withColumn(CONFORMED_TS, F.current_timestamp())
