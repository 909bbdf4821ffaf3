"""Everything the scorecards need to know about an order, as one row per order id.

Order ids are not declared unique, and an order may carry several reviews. Collapsing both tables
to sums and counts per order before they meet the item rows keeps the weights of a row-by-row join
(every item row times every order row times every review row) without producing those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantlens.functions import as_timestamp, calendar_days


def order_deliveries(orders: DataFrame) -> DataFrame:
    """Bronze orders to (order_id, delivery_days, is_late), row by row.

    Timestamps are cast before they are compared. A missing delivery counts as not late and has no
    delivery days; delivery exactly at the estimate is not late.
    """
    purchased = as_timestamp(F.col("order_purchase_timestamp"))
    delivered = as_timestamp(F.col("order_delivered_customer_date"))
    estimated = as_timestamp(F.col("order_estimated_delivery_date"))
    return orders.select(
        "order_id",
        calendar_days(purchased, delivered).alias("delivery_days"),
        F.when(delivered > estimated, 1).otherwise(0).alias("is_late"),
    )


def deliveries_per_order(deliveries: DataFrame) -> DataFrame:
    """Sum (order_id, delivery_days, is_late) rows up to one row per order id."""
    return (
        deliveries.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("order_rows"),
            F.sum(F.col("is_late").cast("bigint")).alias("late_rows"),
            F.coalesce(F.sum("delivery_days"), F.lit(0)).alias("days_sum"),
            F.count("delivery_days").alias("days_rows"),
        )
    )


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    """Number of reviews and sum of their scores, one row per order id."""
    return (
        reviews.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("review_rows"),
            F.sum(F.col("review_score").cast("double")).alias("score_sum"),
            F.count("review_score").alias("score_rows"),
        )
    )
