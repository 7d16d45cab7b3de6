from decimal import Decimal

import pytest

from ledger import ledger, line
from ledgerloom.plans import pnl, reports


@pytest.fixture(scope="module")
def mart(spark):
    journal = [
        line(KSL="-100.00"),
        line(KSL="-80.00", RVERS="BUD"),
        line(KSL="-60.00", MONAT="04", VTWEG=None),
        line(KSL="30.00", RACCT="500000"),
        line(KSL="-5.00", GJAHR="2025", MONAT="01", RACCT="410000"),
        line(KSL="9.00", RACCT="690000", RVERS="FCT"),
    ]
    return pnl.profit_and_loss_from_journal(ledger(spark, journal)).drop(pnl.MART_TS)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_kpis(mart):
    kpis = by(reports.kpis(mart), "version")
    assert tuple(kpis[("ACT",)])[1:] == (Decimal("160.00"), Decimal("165.00"), Decimal("135.00"), Decimal("135.00"))
    assert kpis[("FCT",)]["gross_sales"] is None and kpis[("FCT",)]["net_sales"] == 0


def test_margin_of_nothing_is_unknown(mart):
    margins = by(reports.margins(mart), "version")
    assert margins[("ACT",)]["gross_margin"] == round(135 / 165, 6)
    assert margins[("FCT",)]["gross_margin"] is None


def test_variance(mart):
    lines = by(reports.variance(mart), "pnl_line_id")
    assert lines[("PL01",)]["variance_eur"] == Decimal("80.00") and lines[("PL01",)]["variance_pct"] == 1.0
    assert lines[("PL04",)]["budget_eur"] == 0 and lines[("PL04",)]["variance_pct"] is None
    assert ("PL13",) not in lines


def test_trend_and_change(mart):
    months = by(reports.month_over_month(mart), "version", "fiscal_year", "fiscal_period")
    assert months[("ACT", "2024", 3)]["net_sales_change"] is None
    assert months[("ACT", "2024", 4)]["net_sales_change"] == Decimal("-40.00")
    assert months[("ACT", "2025", 1)]["net_sales_change"] == Decimal("-55.00")
    assert reports.trend(mart).count() == len(months) == 5


def test_waterfall(mart):
    steps = by(reports.waterfall(mart), "version", "pnl_line_id")
    assert [(k[1], str(r["start_eur"]), str(r["end_eur"])) for k, r in sorted(steps.items()) if k[0] == "ACT"] == [
        ("PL01", "0.00", "160.00"),
        ("PL02", "160.00", "165.00"),
        ("PL04", "165.00", "135.00"),
    ]


def test_channel_share(mart):
    shares = by(reports.channel_share(mart), "version", "distribution_channel_id")
    assert shares[("ACT", "10")]["share"] == round(105 / 165, 6)
    assert shares[("ACT", None)]["share"] == round(60 / 165, 6)


def test_filters(mart):
    assert reports.select_filters(mart).count() == mart.count()
    assert reports.select_filters(mart, year=2025).count() == 5
    assert reports.select_filters(mart, version=["ACT", "BUD"], period=[3], channel=None).count() == 11
    assert reports.select_filters(mart, company="C1", sales_org=("S1",), division="01", channel="10").count() > 0
    with pytest.raises(KeyError):
        reports.select_filters(mart, colour="red")
