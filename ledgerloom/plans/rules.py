"""The data-quality rules of every model, by table."""

from __future__ import annotations

from ledgerloom.operators.quality import DROP, Rule

# Rule names, conditions and actions.
RULES: dict[str, tuple[Rule, ...]] = {
    "division": (Rule("division_id_not_null", "division_id IS NOT NULL", DROP),),
    "cost_center": (
        Rule("cost_center_id_not_null", "cost_center_id IS NOT NULL", DROP),
        Rule("valid_period", "valid_from <= valid_to"),
    ),
    "sales_org": (Rule("sales_org_id_not_null", "sales_org_id IS NOT NULL", DROP),),
    "account": (
        Rule("account_id_not_null", "account_id IS NOT NULL", DROP),
        Rule("valid_account_type", "account_type IN ('P&L', 'BS', 'OTHER')"),
    ),
    "material": (Rule("material_id_not_null", "material_id IS NOT NULL", DROP),),
    "pnl_line": (
        Rule("pnl_line_id_not_null", "pnl_line_id IS NOT NULL", DROP),
        Rule("valid_line_type", "line_type IN ('component', 'calc')"),
    ),
    "profit_center": (
        Rule("profit_center_id_not_null", "profit_center_id IS NOT NULL", DROP),
        Rule("valid_period", "valid_from <= valid_to"),
    ),
    "channel": (Rule("channel_id_not_null", "channel_id IS NOT NULL", DROP),),
    "plant": (Rule("plant_id_not_null", "plant_id IS NOT NULL", DROP),),
    "company": (
        Rule("company_code_not_null", "company_code IS NOT NULL", DROP),
        Rule("country_is_iso", "length(country) = 2"),
    ),
    "customer": (Rule("customer_id_not_null", "customer_id IS NOT NULL", DROP),),
    "financial_postings": (
        Rule("document_key_not_null", "document_number IS NOT NULL AND fiscal_year IS NOT NULL", DROP),
        Rule("valid_fiscal_year", "try_cast(fiscal_year AS INT) BETWEEN 2000 AND 2100"),
        Rule("company_code_not_null", "company_code IS NOT NULL"),
    ),
    "profit_and_loss": (
        Rule("company_code_not_null", "company_code IS NOT NULL", DROP),
        Rule("fiscal_year_valid", "try_cast(fiscal_year AS INT) BETWEEN 2000 AND 2100"),
        Rule("amount_is_number", "amount_eur IS NOT NULL"),
    ),
}
