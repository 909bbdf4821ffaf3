"""Edge rows of the silver and gold models."""

from __future__ import annotations

import pytest
from bronze import SILVER, Bronze, item, order

from merchantlens.plans import gold, silver


def by_seller(df):
    return {row["seller_id"]: row for row in df.collect()}


def sellers_of(bronze):
    return by_seller(silver.silver_sellers(bronze.sellers, bronze.orders, bronze.items, bronze.reviews))


def performance_of(bronze):
    typed = silver.silver_orders(bronze.orders)
    return by_seller(
        gold.gold_supplier_performance(bronze.sellers, bronze.items, typed, bronze.reviews)
    )


def silver_row(seller_id, state="SP", orders=1, late=0.0, days=3.0, score=4.0):
    return (seller_id, "city", state, orders, late, days, score)


def test_day_difference_counts_midnights(spark):
    bronze = Bronze(spark, [], [order("o1", "2023-01-01 23:00", "2023-01-02 01:00")], [], [])
    row = silver.silver_orders(bronze.orders).first()
    assert (row["actual_delivery_days"], row["promised_delivery_days"]) == (1, 9)


def test_silver_orders_drops_missing_keys_and_keeps_lineage(spark):
    orders = Bronze(spark, [], [order("o1"), order(None)], [], []).orders
    stamped = orders.selectExpr("*", "'orders.csv' AS _source_file", "current_timestamp() AS _loaded_at")
    result = silver.silver_orders(stamped)
    assert result.count() == 1
    assert result.columns[-4:] == [
        "actual_delivery_days", "promised_delivery_days", "_source_file", "_loaded_at",
    ]


def test_silver_orders_reads_text_timestamps(spark):
    orders = Bronze(spark, [], [order("o1")], [], []).orders
    as_text = orders.select(*[orders[c].cast("string").alias(c) for c in orders.columns])
    assert silver.silver_orders(as_text).collect() == silver.silver_orders(orders).collect()


def test_late_flag(spark):
    bronze = Bronze(
        spark,
        [("s", "c", "SP")],
        [
            order("late", delivered="2023-01-10 00:01"),
            order("on_time", delivered="2023-01-10 00:00"),
            order("undelivered", delivered=None),
            order("early"),
        ],
        [item(o, "s") for o in ("late", "on_time", "undelivered", "early")],
        [],
    )
    row = sellers_of(bronze)["s"]
    assert row["late_delivery_rate"] == 0.25
    assert row["avg_delivery_days"] == (9 + 9 + 3) / 3
    assert row["avg_review_score"] is None


def test_late_flag_compares_text_as_timestamps(spark):
    bronze = Bronze(
        spark, [("s", "c", "SP")], [order("o", delivered="2023-01-09", estimated="2023-01-10")],
        [item("o", "s")], [],
    )
    text = bronze.orders.selectExpr(
        "order_id", "string(order_purchase_timestamp) AS order_purchase_timestamp",
        "'2023-1-9' AS order_delivered_customer_date", "'2023-01-10' AS order_estimated_delivery_date",
    )
    row = silver.silver_sellers(bronze.sellers, text, bronze.items, bronze.reviews).first()
    assert row["late_delivery_rate"] == 0.0


def test_rates_weigh_items_and_orders_count_once(spark):
    bronze = Bronze(
        spark,
        [("s", "c", "SP")],
        [order("a", delivered="2023-01-12"), order("b", delivered="2023-01-02")],
        [item("a", "s"), item("a", "s"), item("b", "s")],
        [("a", 1), ("a", 2), ("b", 5)],
    )
    row = sellers_of(bronze)["s"]
    assert row["total_orders"] == 2
    assert row["late_delivery_rate"] == 2 / 3
    assert row["avg_delivery_days"] == (11 + 11 + 1) / 3
    assert row["avg_review_score"] == (1 + 2 + 1 + 2 + 5) / 5


def test_seller_without_orders_stays_in_silver_only(spark):
    bronze = Bronze(
        spark, [("busy", "c", "SP"), ("idle", "c", "SP")], [order("o")], [item("o", "busy")], []
    )
    rows = sellers_of(bronze)
    assert rows["idle"]["total_orders"] == 0
    assert rows["idle"]["late_delivery_rate"] is None
    stored = silver.silver_sellers(bronze.sellers, bronze.orders, bronze.items, bronze.reviews)
    assert set(by_seller(gold.gold_supplier_risk(stored))) == {"busy"}
    assert gold.gold_executive_summary(stored).first()["total_sellers"] == 1
    assert set(performance_of(bronze)) == {"busy"}


def test_null_keys_never_join(spark):
    bronze = Bronze(
        spark,
        [("s", "c", "SP"), (None, "c", "SP")],
        [order("o"), order(None)],
        [item("o", "s"), item("o", None), item(None, "s")],
        [(None, 1), ("o", 5)],
    )
    rows = sellers_of(bronze)
    assert (rows["s"]["total_orders"], rows["s"]["avg_review_score"]) == (1, 5.0)
    assert rows[None]["total_orders"] == 0
    assert set(performance_of(bronze)) == {"s"}


def test_repeated_sellers_and_orders(spark):
    """Repeated rows weigh as a row-by-row join weighs them; silver merges repeated sellers."""
    bronze = Bronze(
        spark,
        [("s", "c", "SP"), ("s", "c", "SP"), ("s", "other", "SP")],
        [order("a", delivered="2023-01-12"), order("a", delivered="2023-01-02"), order("b")],
        [item("a", "s", price=10.0), item("b", "s", "p2", price=1.0)],
        [("a", 4)],
    )
    silver_rows = silver.silver_sellers(
        bronze.sellers, bronze.orders, bronze.items, bronze.reviews
    ).collect()
    assert sorted(row["seller_city"] for row in silver_rows) == ["c", "other"]
    assert {row["total_orders"] for row in silver_rows} == {2}
    assert {row["late_delivery_rate"] for row in silver_rows} == {1 / 3}
    typed = silver.silver_orders(bronze.orders)
    rows = gold.gold_supplier_performance(bronze.sellers, bronze.items, typed, bronze.reviews).collect()
    assert {(r["seller_city"], r["total_revenue"]) for r in rows} == {("c", 42.0), ("other", 21.0)}
    assert {(r["total_orders"], r["unique_products"]) for r in rows} == {(2, 2)}
    assert {r["avg_delivery_days"] for r in rows} == {5.0}


def test_reviews_fan_out_in_performance(spark):
    bronze = Bronze(
        spark,
        [("s", "c", "SP")],
        [order("two"), order("none")],
        [item("two", "s", "p1", 10.0, 2.0), item("none", "s", "p1", 5.0, 1.0)],
        [("two", 4), ("two", 1)],
    )
    row = performance_of(bronze)["s"]
    assert (row["total_orders"], row["unique_products"]) == (2, 1)
    assert (row["total_revenue"], row["total_freight_cost"]) == (25.0, 5.0)
    assert row["avg_review_score"] == 2.5
    assert row["freight_pct_of_revenue"] == 20.0


def test_missing_products_and_scores(spark):
    bronze = Bronze(
        spark, [("s", "c", "SP")], [order("o", delivered=None)],
        [item("o", "s", None, 0.0, 1.0), item("o", "s", None, 0.0, 1.0)], [("o", None)],
    )
    row = performance_of(bronze)["s"]
    assert (row["total_orders"], row["unique_products"]) == (1, 0)
    assert row["avg_review_score"] is None
    assert row["avg_delivery_days"] is None
    assert row["freight_pct_of_revenue"] is None
    assert sellers_of(bronze)["s"]["avg_review_score"] is None


def test_items_of_unknown_orders_count_for_reviews_only(spark):
    bronze = Bronze(spark, [("s", "c", "SP")], [], [item("gone", "s")], [("gone", 3)])
    row = sellers_of(bronze)["s"]
    assert (row["total_orders"], row["avg_review_score"]) == (0, 3.0)
    assert performance_of(bronze) == {}


@pytest.mark.parametrize(
    ("late", "tier"),
    [(0.3, "MEDIUM"), (0.30001, "HIGH"), (0.15, "LOW"), (0.150001, "MEDIUM"), (None, "LOW")],
)
def test_tiers_are_strict_and_unrounded(spark, late, tier):
    stored = spark.createDataFrame([silver_row("s", late=late)], SILVER)
    assert gold.gold_supplier_risk(stored).first()["risk_tier"] == tier


def test_state_share_of_exactly_a_fifth_is_normal(spark):
    rows = [silver_row("a", "A", 20), silver_row("b", "B", 80), silver_row("idle", "C", 0)]
    result = gold.gold_concentration_risk(spark.createDataFrame(rows, SILVER)).collect()
    assert [(r["seller_state"], r["concentration_flag"]) for r in result] == [("B", "HIGH"), ("A", "NORMAL")]
    assert sum(r["pct_of_total_orders"] for r in result) == pytest.approx(1)


def test_missing_state_is_a_group_of_its_own(spark):
    rows = [silver_row("a", None, 1), silver_row("b", None, 1), silver_row("c", "C", 2)]
    result = gold.gold_concentration_risk(spark.createDataFrame(rows, SILVER)).collect()
    assert [(r["seller_state"], r["total_sellers"], r["total_orders"]) for r in result] == [
        ("C", 1, 2), (None, 2, 2),
    ]


def test_summary_counts_a_seller_once(spark):
    rows = [
        silver_row("a", orders=1, late=0.4, score=2.0),
        silver_row("a", orders=3, late=0.2, score=4.0),
        silver_row("b", orders=4, late=0.0, score=None),
        silver_row("idle", orders=0, late=None),
    ]
    row = gold.gold_executive_summary(spark.createDataFrame(rows, SILVER)).first()
    assert row.asDict() == {
        "total_orders": 8,
        "total_sellers": 2,
        "overall_late_rate": 0.125,
        "pct_high_risk_sellers": 0.5,
        "avg_review_score": 3.0,
    }


def test_models_on_no_sellers(spark):
    empty = spark.createDataFrame([], SILVER)
    row = gold.gold_executive_summary(empty).first()
    assert (row["total_sellers"], row["total_orders"], row["avg_review_score"]) == (0, None, None)
    assert gold.gold_concentration_risk(empty).collect() == []
    assert gold.gold_supplier_risk(empty).collect() == []
