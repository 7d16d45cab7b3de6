"""Every registered query against DuckDB on the same tables: names, types and rows."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as driver
import oracle_queries

TABLES = "region nation customer supplier part orders lineitem".split()
ORACLE = oracle_queries.statements()
QUERIES = {name: query for name, query in driver.queries().items() if name in ORACLE}

SPARK_TYPES = {
    "VARCHAR": "string",
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "DATE": "date",
}


def spark_type(duck_type: str) -> str:
    return SPARK_TYPES.get(duck_type, duck_type.lower())


def canonical(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, Decimal):
        return str(value)
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    own = {name for name, query in driver.queries().items() if "llm" not in getattr(query, "__module__", "")}
    assert own == set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    described = duck.execute(f"DESCRIBE {ORACLE[name]}").fetchall()
    expected_types = {row[0]: spark_type(row[1]) for row in described}
    assert dict(result.dtypes) == {k: v.replace(", ", ",") for k, v in expected_types.items()}

    columns = sorted(result.columns)
    order = [[row[0] for row in described].index(c) for c in columns]
    actual = Counter(tuple(canonical(v) for v in row) for row in result.select(*columns).collect())
    expected = Counter(
        tuple(canonical(row[i]) for i in order) for row in duck.execute(ORACLE[name]).fetchall()
    )
    assert sum(actual.values()) > 0
    assert actual == expected
