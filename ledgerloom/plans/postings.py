"""The posting fact: every journal line with its document header and dimensions."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.conform import AMOUNT, Source, account_type, conform
from ledgerloom.operators.quality import enforce, report
from ledgerloom.operators.star import Side, duplicated_sides, join_hints, star
from ledgerloom.plans.dimensions import ACCOUNT_LINE, CONFORMED_TS, LINE, Raw
from ledgerloom.plans.portions import portions
from ledgerloom.plans.rules import RULES
from ledgerloom.sources.landing import INGESTION_TS, SOURCE_FILE

FACT = "financial_postings"

# Business column <- journal column, with a type where it is not text.
JOURNAL: dict[str, Source] = {
    "ledger": "RLDNR",
    "company_code": "RBUKRS",
    "document_number": "BELNR",
    "fiscal_year": "GJAHR",
    "line_item_number": ("BUZEI", "int"),
    "posting_date": ("BUDAT", "date"),
    "fiscal_period": ("MONAT", "int"),
    "account_id": "RACCT",
    "transaction_currency": "RWCUR",
    "amount_transaction_currency": ("TSL", AMOUNT),
    "local_currency": "RHCUR",
    "amount_local_currency": ("HSL", AMOUNT),
    "group_currency": "KWAER",
    "amount_group_currency": ("KSL", AMOUNT),
    "quantity": ("MENGE", AMOUNT),
    "base_uom": "MEINS",
    "debit_credit_indicator": "DRCRK",
    "line_type": "LINETYPE",
    "version": "RVERS",
    "document_status": "BSTAT",
    "cost_center_id": "KOSTL",
    "profit_center_id": "PRCTR",
    "plant_id": "WERKS",
    "sales_org_id": "VKORG",
    "distribution_channel_id": "VTWEG",
    "division_id": "SPART",
    "material_id": "MATNR",
    "customer_id": "KUNNR",
}

# The other tables, their keys and the columns they add. Document headers,
# customers and materials grow with the business; the rest follows the organisation.
SIDES: dict[str, Side] = {
    side.name: side
    for side in (
        Side(
            "bkpf",
            {"document_number": "BELNR", "fiscal_year": "GJAHR", "company_code": "BUKRS"},
            {
                "document_type": "BLART",
                "document_header_text": "BKTXT",
                "reference_document_number": "XBLNR",
                "created_by_user": "USNAM",
                "transaction_code": "TCODE",
                "document_date": ("BLDAT", "date"),
            },
        ),
        Side(
            "kna1",
            {"customer_id": "KUNNR"},
            {
                "customer_name": "NAME1",
                "customer_country": "LAND1",
                "customer_city": "ORT01",
                "customer_account_group": "KTOKD",
            },
        ),
        Side(
            "mara",
            {"material_id": "MATNR"},
            {
                "material_name": "MAKTX",
                "material_type": "MTART",
                "material_group": "MATKL",
                "product_hierarchy": "PRDHA",
                "brand": "BRAND",
                "season": "SAISO",
                "color": "COLOR",
                "size": "SIZE",
                "style": "STYLE",
            },
        ),
        Side(
            "t001",
            {"company_code": "BUKRS"},
            {"company_name": "BUTXT", "company_country": "LAND1", "company_currency": "WAERS"},
            bounded=True,
        ),
        Side(
            "ska1",
            {"account_id": "SAKNR"},
            {"account_name": "TXT50", "account_group": "KTOKS", "account_type": account_type},
            bounded=True,
        ),
        ACCOUNT_LINE,
        LINE,
        Side(
            "t001w",
            {"plant_id": "WERKS"},
            {
                "plant_name": "NAME1",
                "plant_city": "ORT01",
                "plant_country": "LAND1",
                "plant_type": "PTYPE",
            },
            bounded=True,
        ),
        Side(
            "csks",
            {"cost_center_id": "KOSTL", "company_code": "BUKRS"},
            {
                "cost_center_name": "KTEXT",
                "cost_center_function": "KOSAR",
                "cost_center_country": "LAND1",
            },
            bounded=True,
        ),
        Side(
            "cepc",
            {"profit_center_id": "PRCTR", "company_code": "BUKRS"},
            {
                "profit_center_name": "KTEXT",
                "business_area": "GSBER",
                "profit_center_country": "LAND1",
            },
            bounded=True,
        ),
        Side("tvko", {"sales_org_id": "VKORG"}, {"sales_org_name": "VTEXT"}, bounded=True),
        Side("tvtw", {"distribution_channel_id": "VTWEG"}, {"distribution_channel_name": "VTEXT"}, bounded=True),
        Side("tspa", {"division_id": "SPART"}, {"division_name": "VTEXT"}, bounded=True),
    )
}

# The columns of the fact, in order.
COLUMNS: tuple[str, ...] = (
    "ledger", "company_code", "document_number", "fiscal_year", "line_item_number", "posting_date",
    "fiscal_period", "account_id", "account_name", "account_group", "account_type", "pnl_line_id",
    "pnl_line_name", "pnl_sort_order", "pnl_line_type", "pnl_sign", "transaction_currency",
    "amount_transaction_currency", "local_currency", "amount_local_currency", "group_currency",
    "amount_group_currency", "quantity", "base_uom", "debit_credit_indicator", "line_type", "version",
    "document_status", "company_name", "company_country", "company_currency", "cost_center_id",
    "cost_center_name", "cost_center_function", "cost_center_country", "profit_center_id",
    "profit_center_name", "business_area", "profit_center_country", "plant_id", "plant_name", "plant_city",
    "plant_country", "plant_type", "sales_org_id", "sales_org_name", "distribution_channel_id",
    "distribution_channel_name", "division_id", "division_name", "material_id", "material_name",
    "material_type", "material_group", "product_hierarchy", "brand", "season", "color", "size", "style",
    "customer_id", "customer_name", "customer_country", "customer_city", "customer_account_group",
    "document_type", "document_header_text", "reference_document_number", "created_by_user",
    "transaction_code", "document_date",
)

# The columns that differ from line to line, in the order in which lines travel. A shuffle's compression finds
# what rows share only where it lies together, so these come last, and numbers after texts.
VARYING = (
    "fiscal_year", "account_id", "document_number", "material_id", "plant_id", "cost_center_id", "profit_center_id",
    "division_id", "company_code", "sales_org_id", "line_item_number", "posting_date", "fiscal_period",
    "amount_transaction_currency", "amount_local_currency", "amount_group_currency", "quantity",
)

# What tells one journal line from another when the lines of one hot key are spread.
SPREAD_BY = ("document_number", "line_item_number")


def journal_lines(acdoca: DataFrame, lenient: bool = False) -> DataFrame:
    """Journal lines with business names and types, and their lineage where it was recorded."""
    columns: dict[str, Source] = dict(JOURNAL)
    for name, source in (("bronze_ingestion_ts", INGESTION_TS), ("bronze_source_file", SOURCE_FILE)):
        if source in acdoca.columns:
            columns[name] = source
    return conform(acdoca, columns, lenient)


def packed(lines: DataFrame) -> DataFrame:
    """The same lines with their columns in the order that takes least room in a shuffle."""
    varying = [c for c in VARYING if c in lines.columns]
    return lines.select(*[c for c in lines.columns if c not in varying], *varying)


def sides_of(raw: Raw, names: Collection[str] = tuple(SIDES)) -> list[tuple[Side, DataFrame]]:
    return [(side, raw[name]) for name, side in SIDES.items() if name in names]


def enrich(
    lines: DataFrame, raw: Raw, only: Collection[str] | None = None, hints: Mapping[str, str | None] | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """Journal lines with the columns of the other tables, or of ``only`` some of them.

    Leaving out tables whose columns are not needed saves their joins: Catalyst cannot, as
    it does not know that their keys are unique. Pass ``hints`` where :func:`join_hints` was already called,
    and as ``keys`` the lines before they were joined to anything.
    """
    names = tuple(SIDES) if only is None else only
    sides = sides_of(raw, names)
    if hints is None:
        hints = join_hints(lines.sparkSession, sides)
    lines = packed(lines)
    # P&L lines are found through the account, so they come after all the others.
    for stage in (
        [pair for pair in sides if pair[0] is not LINE],
        [pair for pair in sides if pair[0] is LINE],
    ):
        lines = star(lines, stage, SPREAD_BY, hints, None if LINE in [side for side, _ in stage] else keys)
    if "ska1" in names:
        lines = lines.withColumn("account_type", F.coalesce("account_type", F.lit("OTHER")))
    return lines


def ordered(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    present = set(rows.columns)
    return rows.select(*[c for c in (*COLUMNS, *extra) if c in present])


LINEAGE = ("bronze_ingestion_ts", "bronze_source_file")


def posting_rows(
    raw: Raw, only: Collection[str] | None = None, lenient: bool = False, hints: Mapping[str, str | None] | None = None
) -> DataFrame:
    """The fact before its rules are applied."""
    return ordered(enrich(journal_lines(raw["acdoca"], lenient), raw, only, hints), LINEAGE)


def posting_portions(raw: Raw, lenient: bool = False) -> Iterator[DataFrame]:
    """The same rows out of a stored journal, in as many frames as it has portions; each is made when it is asked for."""
    parts = portions(raw["acdoca"])
    hints = join_hints(raw["acdoca"].sparkSession, sides_of(raw))
    for part in parts:
        yield posting_rows({**raw, "acdoca": part}, lenient=lenient, hints=hints)


def posting_rows_with_header(lines: DataFrame, raw: Raw, keys: DataFrame | None = None) -> DataFrame:
    """The same out of journal lines that have their document header already."""
    return ordered(enrich(lines, raw, [name for name in SIDES if name != "bkpf"], keys=keys), LINEAGE)


def postings(raw: Raw, only: Collection[str] | None = None, lenient: bool = False) -> DataFrame:
    """The fact. Its drop rule reads journal columns only, so it is applied ahead of the joins."""
    lines = enforce(journal_lines(raw["acdoca"], lenient), RULES[FACT])
    rows = ordered(enrich(lines, raw, only), LINEAGE)
    return rows.withColumn(CONFORMED_TS, F.current_timestamp())


def posting_report(raw: Raw, repeating: Collection[str] | None = None) -> DataFrame:
    """Violations of the fact's rules.

    The rules read journal columns only, so a join matters just where it multiplies rows;
    tables with unique keys are left out. Those that repeat a key are counted unless named.
    """
    multiplying = duplicated_sides(sides_of(raw)) if repeating is None else set(repeating)
    if LINE.name in multiplying:
        multiplying.add(ACCOUNT_LINE.name)
    return report(posting_rows(raw, multiplying, lenient=True), RULES[FACT], FACT)
