"""Small hand-made ledgers."""

import pyarrow as pa

from ledgerloom.sources.contracts import CONTRACTS, contract

JOURNAL_DEFAULTS = {
    "RLDNR": "0L", "RBUKRS": "C1", "BELNR": "0000000001", "GJAHR": "2024", "BUZEI": "1",
    "BUDAT": "2024-03-15", "MONAT": "03", "RACCT": "400000", "RWCUR": "EUR", "TSL": "10.00",
    "RHCUR": "EUR", "HSL": "10.00", "KWAER": "EUR", "KSL": "-10.00", "KOSTL": "CC1", "PRCTR": "PC1",
    "MATNR": "M1", "KUNNR": "K1", "WERKS": "P1", "VKORG": "S1", "VTWEG": "10", "SPART": "01",
    "MENGE": "1", "MEINS": "PC", "DRCRK": "H", "LINETYPE": "L", "RVERS": "ACT",
}

# One account per direct line, plus a balance sheet, an unmarked and an unmapped P&L account.
ACCOUNTS = {
    "400000": "PL01", "410000": "PL02", "500000": "PL04", "610000": "PL06", "620000": "PL07",
    "690000": "PL13",
}

TABLES = {
    "bkpf": [{"BELNR": "0000000001", "BUKRS": "C1", "GJAHR": "2024", "BLDAT": "2024-03-14", "BLART": "RV"}],
    "t001": [{"BUKRS": "C1", "BUTXT": "Company 1", "LAND1": "NL"}],
    "t001w": [{"WERKS": "P1", "NAME1": "Plant 1"}],
    "ska1": [
        *[{"SAKNR": a, "TXT50": f"Account {a}", "GVTYP": "X"} for a in ACCOUNTS],
        {"SAKNR": "100000", "XBILK": "X"},
        {"SAKNR": "900000"},
        {"SAKNR": "699999", "GVTYP": "X", "XBILK": "X"},
    ],
    "skb1": [],
    "kna1": [{"KUNNR": "K1", "NAME1": "Customer 1"}],
    "mara": [{"MATNR": "M1", "MAKTX": "Material 1"}],
    "csks": [{"KOSTL": "CC1", "BUKRS": "C1", "KTEXT": "Cost center 1"}],
    "cepc": [{"PRCTR": "PC1", "BUKRS": "C1", "KTEXT": "Profit center 1"}],
    "tvko": [{"VKORG": "S1", "VTEXT": "Sales org 1"}],
    "tvtw": [{"VTWEG": "10", "VTEXT": "Channel 10"}],
    "tspa": [{"SPART": "01", "VTEXT": "Division 1"}],
    "dim_pnl_line": [
        {"PNL_LINE_ID": f"PL{n:02d}", "PNL_LINE_NAME": f"Line {n}", "SORT_ORDER": str(10 * n), "LINE_TYPE": "SUM"}
        for n in range(1, 16)
    ],
    "map_account_to_pnl_line": [
        {"SAKNR": a, "PNL_LINE_ID": line, "SIGN": "-1"} for a, line in ACCOUNTS.items()
    ],
}


def frame(spark, source, rows):
    cells = contract(source).fieldNames()
    columns = {c: pa.array([row.get(c) for row in rows], pa.string()) for c in cells}
    return spark.createDataFrame(pa.table(columns))


def line(**cells):
    return {**JOURNAL_DEFAULTS, **cells}


def ledger(spark, journal, **tables):
    """Raw tables with the given journal lines; further tables replace the defaults."""
    rows = {**TABLES, **tables, "acdoca": journal}
    return {source.lower(): frame(spark, source, rows[source.lower()]) for source in CONTRACTS}
