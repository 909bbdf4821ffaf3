"""Silver models: typed orders and per-seller metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantlens.functions import as_timestamp, calendar_days
from merchantlens.operators.sellers import seller_metrics

LINEAGE_COLUMNS = ("_source_file", "_source_part", "_loaded_at")


def silver_orders(orders: DataFrame) -> DataFrame:
    """Orders with a key, their five timestamps typed and renamed, and actual and promised days.

    Lineage columns pass through where the input has them. Narrow: one map over the scan.
    """
    typed = orders.where(F.col("order_id").isNotNull()).select(
        "order_id",
        "customer_id",
        "order_status",
        as_timestamp(F.col("order_purchase_timestamp")).alias("purchased_at"),
        as_timestamp(F.col("order_approved_at")).alias("approved_at"),
        as_timestamp(F.col("order_delivered_carrier_date")).alias("carrier_pickup_at"),
        as_timestamp(F.col("order_delivered_customer_date")).alias("delivered_at"),
        as_timestamp(F.col("order_estimated_delivery_date")).alias("estimated_delivery_at"),
        *[name for name in LINEAGE_COLUMNS if name in orders.columns],
    )
    return typed.select(
        *typed.columns[:8],
        calendar_days(F.col("purchased_at"), F.col("delivered_at")).alias("actual_delivery_days"),
        calendar_days(F.col("purchased_at"), F.col("estimated_delivery_at")).alias("promised_delivery_days"),
        *typed.columns[8:],
    )


def silver_sellers(
    sellers: DataFrame, orders: DataFrame, items: DataFrame, reviews: DataFrame, hot_orders: Sequence = ()
) -> DataFrame:
    """Every seller with its orders, late rate, delivery days and review score.

    Repeated seller rows merge; sellers without orders stay, with 0 orders and NULL rates.
    """
    known = sellers.select("seller_id", "seller_city", "seller_state").distinct()
    metrics = seller_metrics(items, orders, reviews, hot_orders)
    return known.join(metrics, "seller_id", "left").select(
        "seller_id",
        "seller_city",
        "seller_state",
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        "late_delivery_rate",
        "avg_delivery_days",
        "avg_review_score",
    )
