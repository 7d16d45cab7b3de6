"""DuckDB SQL for every registered query that SQL can express.

The raw tables are derived from the test tables with the shared expressions of the adapter;
everything after that is written here on its own: dimensions are renamed first and joined
with USING, subtotals come from a membership list, and rules are counted one by one.
"""

from __future__ import annotations

from ledgerloom.sources.contracts import COLUMNS, CONTRACTS
from ledgerloom.sources.driver_tables import derived_sql

# Business views over the raw tables: view name -> SELECT. Names of columns, and what they are derived from.
VIEWS: dict[str, str] = {
    "journal": """
        SELECT RLDNR AS ledger, RBUKRS AS company_code, BELNR AS document_number, GJAHR AS fiscal_year,
               BUZEI::INT AS line_item_number, BUDAT::DATE AS posting_date, MONAT::INT AS fiscal_period,
               RACCT AS account_id, RWCUR AS transaction_currency, RHCUR AS local_currency,
               KWAER AS group_currency, TSL::DECIMAL(18,2) AS amount_transaction_currency,
               HSL::DECIMAL(18,2) AS amount_local_currency, KSL::DECIMAL(18,2) AS amount_group_currency,
               MENGE::DECIMAL(18,2) AS quantity, MEINS AS base_uom, DRCRK AS debit_credit_indicator,
               LINETYPE AS line_type, RVERS AS version, BSTAT AS document_status, KOSTL AS cost_center_id,
               PRCTR AS profit_center_id, WERKS AS plant_id, VKORG AS sales_org_id,
               VTWEG AS distribution_channel_id, SPART AS division_id, MATNR AS material_id,
               KUNNR AS customer_id
        FROM acdoca""",
    "kept": "SELECT * FROM journal WHERE NOT (document_number IS NULL OR fiscal_year IS NULL)",
    "headers": """
        SELECT BELNR AS document_number, GJAHR AS fiscal_year, BUKRS AS company_code,
               BLART AS document_type, BKTXT AS document_header_text, XBLNR AS reference_document_number,
               USNAM AS created_by_user, TCODE AS transaction_code, BLDAT::DATE AS document_date
        FROM bkpf""",
    "companies": """
        SELECT BUKRS AS company_code, BUTXT AS company_name, LAND1 AS company_country, WAERS AS company_currency
        FROM t001""",
    "accounts": """
        SELECT SAKNR AS account_id, TXT50 AS account_name, KTOKS AS account_group,
               if(coalesce(GVTYP, '') = 'X', 'P&L', if(coalesce(XBILK, '') = 'X', 'BS', 'OTHER')) AS class
        FROM ska1""",
    "lines": """
        SELECT SAKNR AS account_id, PNL_LINE_ID AS pnl_line_id, SIGN::INT AS pnl_sign,
               PNL_LINE_NAME AS pnl_line_name, SORT_ORDER::INT AS pnl_sort_order, LINE_TYPE AS pnl_line_type
        FROM map_account_to_pnl_line LEFT JOIN dim_pnl_line USING (PNL_LINE_ID)""",
    "customers": """
        SELECT KUNNR AS customer_id, NAME1 AS customer_name, LAND1 AS customer_country,
               ORT01 AS customer_city, KTOKD AS customer_account_group
        FROM kna1""",
    "materials": """
        SELECT MATNR AS material_id, MAKTX AS material_name, MTART AS material_type, MATKL AS material_group,
               PRDHA AS product_hierarchy, BRAND AS brand, SAISO AS season, COLOR AS color, SIZE AS size,
               STYLE AS style
        FROM mara""",
    "plants": """
        SELECT WERKS AS plant_id, NAME1 AS plant_name, ORT01 AS plant_city, LAND1 AS plant_country,
               PTYPE AS plant_type
        FROM t001w""",
    "cost_centers": """
        SELECT KOSTL AS cost_center_id, BUKRS AS company_code, KTEXT AS cost_center_name,
               KOSAR AS cost_center_function, LAND1 AS cost_center_country
        FROM csks""",
    "profit_centers": """
        SELECT PRCTR AS profit_center_id, BUKRS AS company_code, KTEXT AS profit_center_name,
               GSBER AS business_area, LAND1 AS profit_center_country
        FROM cepc""",
    "sales_orgs": "SELECT VKORG AS sales_org_id, VTEXT AS sales_org_name FROM tvko",
    "channels": "SELECT VTWEG AS distribution_channel_id, VTEXT AS distribution_channel_name FROM tvtw",
    "divisions": "SELECT SPART AS division_id, VTEXT AS division_name FROM tspa",
}

HEADER = "LEFT JOIN headers USING (document_number, fiscal_year, company_code)"
ACCOUNT_LINE = "LEFT JOIN accounts USING (account_id) LEFT JOIN lines USING (account_id)"
COMMERCIAL = "LEFT JOIN customers USING (customer_id) LEFT JOIN materials USING (material_id)"
ORG = """
    LEFT JOIN companies USING (company_code) LEFT JOIN plants USING (plant_id)
    LEFT JOIN cost_centers USING (cost_center_id, company_code)
    LEFT JOIN profit_centers USING (profit_center_id, company_code)
    LEFT JOIN sales_orgs USING (sales_org_id) LEFT JOIN channels USING (distribution_channel_id)
    LEFT JOIN divisions USING (division_id)"""
CLASSED = "* EXCLUDE (class), coalesce(class, 'OTHER') AS account_type"

# The reporting group.
GROUP = (
    "company_code, company_name, company_country, fiscal_year, fiscal_period, version, "
    "distribution_channel_id, distribution_channel_name, division_id, division_name, "
    "sales_org_id, sales_org_name"
)

# Fixed values within: subtotals with their positions and members.
VIEWS |= {
    "direct": f"""
        SELECT {GROUP}, pnl_line_id, pnl_line_name, pnl_sort_order AS sort_order, pnl_line_type AS line_type,
               sum(amount_group_currency * pnl_sign)::DECIMAL(38,2) AS amount_eur
        FROM kept JOIN accounts USING (account_id) JOIN lines USING (account_id)
             LEFT JOIN companies USING (company_code) LEFT JOIN sales_orgs USING (sales_org_id)
             LEFT JOIN channels USING (distribution_channel_id) LEFT JOIN divisions USING (division_id)
        WHERE class = 'P&L' AND pnl_line_id IS NOT NULL
        GROUP BY ALL""",
    # The lines below each subtotal; a group has every subtotal, if only as a zero.
    "members": """
        SELECT * FROM (VALUES
            ('PL03', 'Net Sales', 30, ['PL01', 'PL02']),
            ('PL05', 'Gross Profit', 50, ['PL01', 'PL02', 'PL04']),
            ('PL14', 'EBITDA', 140, ['PL01', 'PL02', 'PL04', 'PL06', 'PL07', 'PL08', 'PL09', 'PL10',
                                     'PL11', 'PL12']),
            ('PL15', 'EBIT', 150, ['PL01', 'PL02', 'PL04', 'PL06', 'PL07', 'PL08', 'PL09', 'PL10',
                                   'PL11', 'PL12', 'PL13'])
        ) AS m(id, label, pos, below)""",
    "statement": f"""
        SELECT * FROM direct
        UNION ALL BY NAME
        SELECT {GROUP}, id AS pnl_line_id, label AS pnl_line_name, pos AS sort_order, 'calc' AS line_type,
               sum(if(list_contains(below, pnl_line_id), amount_eur, 0))::DECIMAL(38,2) AS amount_eur
        FROM direct, members GROUP BY {GROUP}, id, label, pos""",
    "mart": "SELECT * FROM statement WHERE company_code IS NOT NULL",
    "monthly": """
        SELECT fiscal_year, fiscal_period, version,
               (sum(amount_eur) FILTER (pnl_line_id = 'PL03'))::DECIMAL(38,2) AS net_sales,
               (sum(amount_eur) FILTER (pnl_line_id = 'PL14'))::DECIMAL(38,2) AS ebitda
        FROM mart WHERE pnl_line_id IN ('PL03', 'PL14') GROUP BY ALL""",
    "headline": """
        SELECT version, (sum(amount_eur) FILTER (pnl_line_id = 'PL01'))::DECIMAL(38,2) AS gross_sales,
               (sum(amount_eur) FILTER (pnl_line_id = 'PL03'))::DECIMAL(38,2) AS net_sales,
               (sum(amount_eur) FILTER (pnl_line_id = 'PL05'))::DECIMAL(38,2) AS gross_profit,
               (sum(amount_eur) FILTER (pnl_line_id = 'PL14'))::DECIMAL(38,2) AS ebitda
        FROM mart WHERE pnl_line_id IN ('PL01', 'PL03', 'PL05', 'PL14') GROUP BY ALL""",
}

# Columns of the dimensions.
DIMENSIONS: dict[str, str] = {
    "division": "SELECT SPART AS division_id, VTEXT AS division_name FROM tspa",
    "channel": "SELECT VTWEG AS channel_id, VTEXT AS channel_name FROM tvtw",
    "sales_org": """
        SELECT VKORG AS sales_org_id, VTEXT AS sales_org_name, BUKRS AS company_code, LAND1 AS country
        FROM tvko""",
    "company": """
        SELECT BUKRS AS company_code, BUTXT AS company_name, LAND1 AS country, WAERS AS local_currency,
               KTOPL AS chart_of_accounts, PERIV AS fiscal_year_variant, ORT01 AS city
        FROM t001""",
    "plant": """
        SELECT WERKS AS plant_id, NAME1 AS plant_name, ORT01 AS city, LAND1 AS country, BUKRS AS company_code,
               VKORG AS sales_org_id, PTYPE AS plant_type
        FROM t001w""",
    "customer": """
        SELECT KUNNR AS customer_id, NAME1 AS customer_name, LAND1 AS country, ORT01 AS city,
               KTOKD AS account_group, KUKLA AS customer_class
        FROM kna1""",
    "material": """
        SELECT MATNR AS material_id, MAKTX AS material_name, MTART AS material_type, MATKL AS material_group,
               SPART AS division_id, MEINS AS base_uom, PRDHA AS product_hierarchy, BRAND AS brand,
               SAISO AS season, COLOR AS color, SIZE AS size, STYLE AS style
        FROM mara""",
    "cost_center": """
        SELECT KOSTL AS cost_center_id, KOKRS AS controlling_area, BUKRS AS company_code,
               DATAB::DATE AS valid_from, DATBI::DATE AS valid_to, KTEXT AS cost_center_name,
               LTEXT AS cost_center_long_name, KOSAR AS cost_center_function, LAND1 AS country
        FROM csks""",
    "profit_center": """
        SELECT PRCTR AS profit_center_id, KOKRS AS controlling_area, BUKRS AS company_code,
               DATAB::DATE AS valid_from, DATBI::DATE AS valid_to, KTEXT AS profit_center_name,
               LTEXT AS profit_center_long_name, GSBER AS business_area, LAND1 AS country
        FROM cepc""",
    "pnl_line": """
        SELECT PNL_LINE_ID AS pnl_line_id, PNL_LINE_NAME AS pnl_line_name, SORT_ORDER::INT AS sort_order,
               LINE_TYPE AS line_type
        FROM dim_pnl_line""",
    "account": """
        SELECT account_id, account_name, TXT20 AS account_short_name, account_group, class AS account_type,
               pnl_line_id, pnl_line_name, pnl_sort_order, pnl_line_type, pnl_sign
        FROM accounts JOIN ska1 ON account_id = SAKNR LEFT JOIN lines USING (account_id)""",
}

# table, rule, action, rows, condition that must hold
CHECKS: tuple[tuple[str, str, str, str, str], ...] = (
    ("division", "division_id_not_null", "drop", "dim_division", "division_id IS NOT NULL"),
    ("cost_center", "cost_center_id_not_null", "drop", "dim_cost_center", "cost_center_id IS NOT NULL"),
    ("cost_center", "valid_period", "warn", "dim_cost_center", "valid_to >= valid_from"),
    ("sales_org", "sales_org_id_not_null", "drop", "dim_sales_org", "sales_org_id IS NOT NULL"),
    ("account", "account_id_not_null", "drop", "dim_account", "account_id IS NOT NULL"),
    ("account", "valid_account_type", "warn", "dim_account", "account_type IN ('OTHER', 'BS', 'P&L')"),
    ("material", "material_id_not_null", "drop", "dim_material", "material_id IS NOT NULL"),
    ("pnl_line", "pnl_line_id_not_null", "drop", "dim_pnl_line_", "pnl_line_id IS NOT NULL"),
    ("pnl_line", "valid_line_type", "warn", "dim_pnl_line_", "line_type = 'component' OR line_type = 'calc'"),
    ("profit_center", "profit_center_id_not_null", "drop", "dim_profit_center", "profit_center_id IS NOT NULL"),
    ("profit_center", "valid_period", "warn", "dim_profit_center", "valid_to >= valid_from"),
    ("channel", "channel_id_not_null", "drop", "dim_channel", "channel_id IS NOT NULL"),
    ("plant", "plant_id_not_null", "drop", "dim_plant", "plant_id IS NOT NULL"),
    ("company", "company_code_not_null", "drop", "dim_company", "company_code IS NOT NULL"),
    ("company", "country_is_iso", "warn", "dim_company", "length(country) = 2"),
    ("customer", "customer_id_not_null", "drop", "dim_customer", "customer_id IS NOT NULL"),
    ("financial_postings", "document_key_not_null", "drop", "journal",
     "document_number IS NOT NULL AND fiscal_year IS NOT NULL"),
    ("financial_postings", "valid_fiscal_year", "warn", "journal",
     "TRY_CAST(fiscal_year AS INT) >= 2000 AND TRY_CAST(fiscal_year AS INT) <= 2100"),
    ("financial_postings", "company_code_not_null", "warn", "journal", "company_code IS NOT NULL"),
    ("profit_and_loss", "company_code_not_null", "drop", "statement", "company_code IS NOT NULL"),
    ("profit_and_loss", "fiscal_year_valid", "warn", "statement",
     "TRY_CAST(fiscal_year AS INT) >= 2000 AND TRY_CAST(fiscal_year AS INT) <= 2100"),
    ("profit_and_loss", "amount_is_number", "warn", "statement", "amount_eur IS NOT NULL"),
)


def violations(table: str, rule: str, action: str, rows: str, condition: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{rule}' AS rule_name, '{action}' AS action, "
        f"count(*) FILTER (NOT coalesce({condition}, FALSE)) AS violations FROM {rows}"
    )


def raw_size(source: str) -> str:
    cells = COLUMNS[source]
    filled = " + ".join(f"count({c})" for c in cells)
    length = " + ".join(f"coalesce(sum(length({c})), 0)" for c in cells)
    return (
        f"SELECT '{source}' AS source, count(*) AS row_count, ({filled})::BIGINT AS filled_cells, "
        f"({length})::BIGINT AS text_length FROM {source.lower()}"
    )


def with_views(body: str) -> str:
    """A statement over the raw tables and the views above."""
    raw = {source.lower(): derived_sql(source) for source in CONTRACTS}
    dims = {("dim_pnl_line_" if name == "pnl_line" else f"dim_{name}"): sql for name, sql in DIMENSIONS.items()}
    views = {**raw, **VIEWS, **dims}
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in views.items()) + "\n" + body


_JOURNAL_TEXT = " || ',' || ".join(f"coalesce({c}, '')" for c in COLUMNS["ACDOCA"])
_DAMAGED = "BUZEI = '3' AND RACCT LIKE '%700'"
_FAILED = """
    list_filter([
        if(document_number IS NULL OR fiscal_year IS NULL, 'document_key_not_null', NULL),
        if(coalesce(TRY_CAST(fiscal_year AS INT) BETWEEN 2000 AND 2100, FALSE), NULL, 'valid_fiscal_year'),
        if(company_code IS NULL, 'company_code_not_null', NULL)
    ], lambda x: x IS NOT NULL)"""

BODIES: dict[str, str] = {
    "raw_roundtrip": "SELECT * FROM acdoca",
    "raw_tables": " UNION ALL ".join(raw_size(source) for source in CONTRACTS),
    "raw_lineage": """
        SELECT count(*) AS row_count, count(*) AS rows_with_load_time, count(*) AS rows_with_source_file
        FROM acdoca""",
    "raw_permissive_rescue": f"""
        SELECT *, if({_DAMAGED}, {_JOURNAL_TEXT} || ',surplus', NULL) AS _rescued_data FROM acdoca""",
    "raw_unregistered": """
        SELECT COLUMNS(*)::VARCHAR FROM customer""",
    "raw_append": "SELECT * FROM acdoca",
    "raw_append_recommented": "SELECT * FROM acdoca",
    "raw_loads": """
        SELECT (MONAT > '06' AND MONAT IS NOT NULL)::INT AS batch, count(*) AS row_count, count(*) AS rows_in_files, TRUE AS next_refused
        FROM acdoca GROUP BY ALL""",
    "raw_reconciled": """
        SELECT *, if(KUNNR::BIGINT % 3 = 0, '{"OLD_ID":"' || KUNNR || '"}', NULL) AS _rescued_data FROM kna1""",
    "layers_after_failure": """
        SELECT 'raw.acdoca' AS table_name, count(*) AS row_count FROM acdoca
        UNION ALL SELECT 'conformed.financial_postings', count(*) FROM kept
        UNION ALL SELECT 'mart.profit_and_loss', count(*) FROM mart""",
    "raw_text_kept": """
        SELECT c_custkey::VARCHAR AS KUNNR,
            '  ' || c_name || ' ' || chr(9) || '"q", ' || chr(10) || ' ' || c_mktsegment || '  ' AS NAME1
        FROM customer""",
    "layer_refresh": "SELECT * FROM mart",
    "layer_refresh_rescued": f"""
        SELECT *, if({_DAMAGED}, {_JOURNAL_TEXT} || ',surplus', NULL) AS _rescued_data FROM acdoca""",
    "refresh_after_failure": "SELECT * FROM mart",
    "names_override": "SELECT * FROM kna1",
    "table_comment": "SELECT *, 'Dimension customer.' AS table_comment FROM dim_customer",
    **{
        f"dim_{name}": f"SELECT * FROM {'dim_pnl_line_' if name == 'pnl_line' else 'dim_' + name}"
        for name in DIMENSIONS
    },
    "postings_header": f"SELECT * FROM kept {HEADER}",
    "postings_account_line": f"SELECT {CLASSED} FROM kept {ACCOUNT_LINE}",
    "postings_org": f"SELECT * FROM kept {ORG}",
    "postings_commercial": f"SELECT * FROM kept {COMMERCIAL}",
    "postings_full": f"SELECT {CLASSED} FROM kept {HEADER} {ACCOUNT_LINE} {COMMERCIAL} {ORG}",
    "postings_header_stored": f"SELECT * FROM kept {HEADER}",
    "postings_full_stored": f"SELECT {CLASSED} FROM kept {HEADER} {ACCOUNT_LINE} {COMMERCIAL} {ORG}",
    "postings_commercial_shuffled": f"SELECT * FROM kept {COMMERCIAL}",
    "postings_metadata": """
        SELECT count(*) AS with_load_time, count(*) AS with_source_file, count(*) AS with_conformed_time, count(*) AS in_order FROM kept""",
    "dq_report": " UNION ALL ".join(violations(*check) for check in CHECKS),
    "dq_observed": " UNION ALL ".join(
        [
            "SELECT 'rows' AS metric, count(*) AS value FROM journal",
            *[
                f"SELECT rule_name AS metric, violations AS value FROM ({violations(*check)})"
                for check in CHECKS
                if check[0] == "financial_postings"
            ],
        ]
    ),
    "dq_drop": "SELECT * FROM kept",
    "dq_quarantine": f"""
        SELECT * EXCLUDE (failed), array_to_string(failed, ',') AS failed_rules
        FROM (SELECT *, {_FAILED} AS failed FROM journal) WHERE len(failed) > 0""",
    "quarantine_replayed": """
        SELECT * REPLACE (coalesce(document_number, if(fiscal_year IS NULL OR document_number IS NULL, 'CORRECTED', NULL)) AS document_number,
                          coalesce(fiscal_year, '2024') AS fiscal_year)
        FROM journal""",
    "mart_after_append": "SELECT * FROM mart",
    "mart_after_retraction": "SELECT * FROM mart",
    "pnl_direct": "SELECT * FROM direct",
    "pnl_wide": f"""
        SELECT {GROUP},
               sum(if(pnl_line_id = 'PL01', amount_eur, 0))::DECIMAL(38,2) AS pl01,
               sum(if(pnl_line_id = 'PL02', amount_eur, 0))::DECIMAL(38,2) AS pl02,
               sum(if(pnl_line_id = 'PL04', amount_eur, 0))::DECIMAL(38,2) AS pl04,
               sum(if(pnl_line_id BETWEEN 'PL06' AND 'PL12', amount_eur, 0))::DECIMAL(38,2) AS opex_bundle,
               sum(if(pnl_line_id = 'PL13', amount_eur, 0))::DECIMAL(38,2) AS pl13
        FROM direct GROUP BY ALL""",
    "pnl_mart": "SELECT * FROM mart",
    "pnl_mart_from_postings": "SELECT * FROM mart",
    "pnl_kpis": "SELECT * FROM headline",
    "pnl_margin": """
        SELECT version, round(gross_profit::DOUBLE / nullif(net_sales::DOUBLE, 0), 6) AS gross_margin,
               round(ebitda::DOUBLE / nullif(net_sales::DOUBLE, 0), 6) AS ebitda_margin
        FROM headline""",
    "pnl_variance": """
        SELECT *, round(variance_eur::DOUBLE / nullif(abs(budget_eur)::DOUBLE, 0), 6) AS variance_pct
        FROM (
            SELECT *, (actual_eur - budget_eur)::DECIMAL(38,2) AS variance_eur FROM (
                SELECT pnl_line_id, pnl_line_name, sort_order,
                       coalesce(sum(amount_eur) FILTER (version = 'ACT'), 0)::DECIMAL(38,2) AS actual_eur,
                       coalesce(sum(amount_eur) FILTER (version = 'BUD'), 0)::DECIMAL(38,2) AS budget_eur
                FROM mart WHERE version IN ('ACT', 'BUD') GROUP BY ALL))""",
    "pnl_trend": "SELECT * FROM monthly",
    "pnl_mom": """
        SELECT *, (net_sales - lag(net_sales) OVER w)::DECIMAL(38,2) AS net_sales_change,
               (ebitda - lag(ebitda) OVER w)::DECIMAL(38,2) AS ebitda_change
        FROM monthly WINDOW w AS (PARTITION BY version ORDER BY fiscal_year::INT, fiscal_period)""",
    "pnl_waterfall": """
        SELECT version, pnl_line_id, pnl_line_name, sort_order, amount_eur,
               (end_eur - amount_eur)::DECIMAL(38,2) AS start_eur, end_eur
        FROM (
            SELECT *, (sum(amount_eur) OVER (PARTITION BY version ORDER BY sort_order
                       ROWS UNBOUNDED PRECEDING))::DECIMAL(38,2) AS end_eur
            FROM (SELECT version, pnl_line_id, pnl_line_name, sort_order,
                         sum(amount_eur)::DECIMAL(38,2) AS amount_eur
                  FROM mart WHERE line_type = 'SUM' GROUP BY ALL))""",
    "pnl_channel_share": """
        SELECT *, round(net_sales::DOUBLE / nullif((sum(net_sales) OVER (PARTITION BY version))::DOUBLE, 0), 6)
                  AS share
        FROM (SELECT version, distribution_channel_id, distribution_channel_name,
                     sum(amount_eur)::DECIMAL(38,2) AS net_sales
              FROM mart WHERE pnl_line_id = 'PL03' GROUP BY ALL)""",
    "pnl_filtered": """
        SELECT * FROM mart
        WHERE fiscal_year IN ('1999', '2000') AND fiscal_period <= 6 AND version = 'ACT'
          AND company_code IN ('C1', 'C2', 'C3') AND division_id = '02'
          AND distribution_channel_id = '10' AND sales_org_id IN ('S1', 'S3')""",
    "pnl_filtered_stored": """
        SELECT * FROM mart
        WHERE fiscal_year IN ('1999', '2000') AND fiscal_period <= 6 AND version = 'ACT'
          AND company_code IN ('C1', 'C2', 'C3') AND division_id = '02'
          AND distribution_channel_id = '10' AND sales_org_id IN ('S1', 'S3')""",
}


def statements() -> dict[str, str]:
    return {name: with_views(body) for name, body in BODIES.items()}
