"""Source contracts: which columns every extract has, in file order, all nullable strings.

The raw layer keeps text exactly as delivered (leading zeros, date text); types come
with the conformed layer.
"""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# Source names and their columns, in file order.
COLUMNS: dict[str, tuple[str, ...]] = {
    "ACDOCA": (
        "RLDNR", "RBUKRS", "BELNR", "GJAHR", "BUZEI", "BUDAT", "MONAT", "RACCT", "RWCUR", "TSL", "RHCUR",
        "HSL", "KWAER", "KSL", "KOSTL", "PRCTR", "MATNR", "KUNNR", "WERKS", "VKORG", "VTWEG", "SPART", "MENGE",
        "MEINS", "DRCRK", "BSTAT", "LINETYPE", "RVERS",
    ),
    "BKPF": (
        "BELNR", "BUKRS", "GJAHR", "BLDAT", "BUDAT", "BLART", "WAERS", "BKTXT", "XBLNR", "USNAM", "CPUDT",
        "TCODE", "MONAT", "NUMPG",
    ),
    "T001": ("BUKRS", "BUTXT", "LAND1", "WAERS", "KTOPL", "PERIV", "SPRAS", "ORT01"),
    "T001W": ("WERKS", "NAME1", "ORT01", "LAND1", "BUKRS", "VKORG", "PTYPE"),
    "SKA1": ("SAKNR", "TXT20", "TXT50", "KTOKS", "XBILK", "GVTYP", "KTOPL"),
    "SKB1": ("BUKRS", "SAKNR", "TXT50", "KTOKS", "XBILK", "GVTYP", "WAERS"),
    "KNA1": ("KUNNR", "NAME1", "LAND1", "ORT01", "KTOKD", "KUKLA"),
    "MARA": (
        "MATNR", "MAKTX", "MTART", "MATKL", "SPART", "MEINS", "PRDHA", "BRAND", "SAISO", "COLOR", "SIZE",
        "STYLE",
    ),
    "CSKS": ("KOSTL", "KOKRS", "BUKRS", "DATAB", "DATBI", "KTEXT", "LTEXT", "KOSAR", "LAND1"),
    "CEPC": ("PRCTR", "KOKRS", "BUKRS", "DATAB", "DATBI", "KTEXT", "LTEXT", "GSBER", "LAND1"),
    "TVKO": ("VKORG", "VTEXT", "BUKRS", "LAND1"),
    "TVTW": ("VTWEG", "VTEXT"),
    "TSPA": ("SPART", "VTEXT"),
    "DIM_PNL_LINE": ("PNL_LINE_ID", "PNL_LINE_NAME", "SORT_ORDER", "LINE_TYPE"),
    "MAP_ACCOUNT_TO_PNL_LINE": ("SAKNR", "PNL_LINE_ID", "SIGN"),
}

CONTRACTS: dict[str, StructType] = {
    source: StructType([StructField(column, StringType(), True) for column in columns])
    for source, columns in COLUMNS.items()
}


def contract(source: str) -> StructType:
    """The schema of a registered source; its name is not case-sensitive."""
    return CONTRACTS[source.upper()]


def table_name(source: str) -> str:
    """Raw tables carry the source's name in lower case."""
    return source.lower()
