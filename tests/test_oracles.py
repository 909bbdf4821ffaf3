"""Every registered query against its DuckDB SQL, row for row."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_points
from merchantlens.checks.oracles import FINAL, ORACLES
from merchantlens.checks.queries import QUERIES
from merchantlens.fixtures import BronzeFixture

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def by_column_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), [tuple(row[i] for i in order) for row in rows]


def check(spark, oracle, name):
    result = entry_points.queries()[name](spark, FOLDER)
    cursor = oracle.execute(entry_points.oracle_sql()[name])
    expected_columns, expected = by_column_name([c[0] for c in cursor.description], cursor.fetchall())
    columns, found = by_column_name(result.columns, result.collect())
    assert columns == expected_columns
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert found, "a query that finds nothing checks nothing"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, oracle, name):
    check(spark, oracle, name)


@pytest.mark.parametrize("name", ["silver_sellers", "seller_reviews", "gold_supplier_performance"])
def test_query_equals_oracle_with_hot_orders(spark, oracle, name, monkeypatch):
    monkeypatch.setattr(BronzeFixture, "hot_orders", [1, 2, 7, 100, 1200])
    check(spark, oracle, name)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(FINAL) == set(ORACLES)


def test_entry_returns_the_risk_scorecard(spark):
    result = entry_points.entry(spark)
    assert result.columns[-1] == "risk_tier"
    assert result.count() > 0


# Display order is part of these results, which the comparison above ignores.
@pytest.mark.parametrize(
    ("name", "order"),
    [
        ("top_suppliers", "avg_review_score DESC NULLS LAST, seller_id"),
        (
            "risk_view",
            "CASE risk_tier WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, late_rate_pct DESC, seller_id",
        ),
        ("concentration_view", "pct DESC, seller_state"),
        ("gold_concentration_risk", "total_orders DESC, seller_state"),
        ("read_only_sql", "late_delivery_rate DESC, seller_id"),
    ],
)
def test_display_order(spark, oracle, name, order):
    result = entry_points.queries()[name](spark, FOLDER)
    columns = ", ".join(result.columns)
    expected = oracle.execute(f"SELECT {columns} FROM ({ORACLES[name]}) ORDER BY {order}").fetchall()
    assert [tuple(row) for row in result.collect()] == expected
