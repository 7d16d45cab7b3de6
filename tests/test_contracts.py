"""Contracts against what reads them."""

import pytest

from ledgerloom.plans import postings
from ledgerloom.sources.contracts import CONTRACTS, contract, table_name
from ledgerloom.sources.driver_tables import DERIVED


@pytest.mark.parametrize("side", postings.SIDES.values(), ids=lambda side: side.name)
def test_joined_columns_are_in_their_contract(side):
    cells = set(contract(side.name).fieldNames()) if side.name.upper() in CONTRACTS else None
    if cells is not None:
        assert set(side.on.values()) <= cells


@pytest.mark.parametrize("source", CONTRACTS)
def test_order_survives_a_round_trip_through_json(source):
    schema = contract(source)
    assert type(schema).fromJson(schema.jsonValue()) == schema


def test_the_test_ledger_fills_every_contract():
    assert {source: list(spec.columns) for source, spec in DERIVED.items()}.keys() == CONTRACTS.keys()
    for source, spec in DERIVED.items():
        assert set(spec.columns) == set(contract(source).fieldNames())


def test_names_ignore_case():
    assert contract("tspa") is contract("TSPA")
    assert table_name("TSPA") == "tspa"
