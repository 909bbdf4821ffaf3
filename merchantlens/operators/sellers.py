"""Item rows joined to their orders, and their sums per seller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantlens.functions import ratio
from merchantlens.operators.orders import deliveries_per_order, order_deliveries, reviews_per_order
from merchantlens.operators.skew import LookupSide, is_first, lookup_join, split_join, union_all


def seller_order_rows(items: DataFrame, orders: DataFrame, hot_orders: Sequence = ()) -> DataFrame:
    """One row per item of a known seller and row of its order, with that row's delivery days and late flag.

    Items of hot orders stay where they are, as in the models, while the order id is one row of ``orders``;
    a hot id with more rows is split over tasks on both sides. ``hot_orders`` should name the ids that
    are hot in either table.
    """
    known = items.where(F.col("seller_id").isNotNull())
    return split_join(known, order_deliveries(orders), "order_id", "inner", hot_orders)


def seller_order_sums(items: DataFrame, orders: DataFrame, hot_orders: Sequence = ()) -> DataFrame:
    """Per seller the rows, delivery days and late rows of ``seller_order_rows``, without producing these.

    Every item meets one row of sums of its order, so an order id with many rows on both sides costs the rows of
    both sides, not the pairs. Sellers without a joined row are absent; days are NULL where no row has any.
    """
    keys = items.where(F.col("seller_id").isNotNull()).select("order_id", "seller_id")
    sides = [LookupSide(deliveries_per_order(order_deliveries(orders)))]
    joined = union_all(lookup_join(keys, "order_id", sides, hot_orders))
    return joined.groupBy("seller_id").agg(
        F.sum("order_rows").alias("n_rows"),
        F.sum(F.when(F.col("days_rows") > 0, F.col("days_sum"))).alias("days"),
        F.sum("late_rows").alias("late"),
    )


def seller_review_scores(items: DataFrame, reviews: DataFrame, hot_orders: Sequence = ()) -> DataFrame:
    """Average review score per seller, weighted by item rows; sellers without a review are absent."""
    keys = items.where(F.col("seller_id").isNotNull()).select("order_id", "seller_id")
    parts = lookup_join(keys, "order_id", [LookupSide(reviews_per_order(reviews))], hot_orders)
    return (
        union_all(parts)
        .groupBy("seller_id")
        .agg(
            F.sum("score_sum").alias("score_sum"),
            F.sum(F.col("score_rows").cast("double")).alias("score_rows"),
        )
        .select("seller_id", ratio(F.col("score_sum"), F.col("score_rows")).alias("avg_review_score"))
    )


def seller_metrics(
    items: DataFrame, orders: DataFrame, reviews: DataFrame, hot_orders: Sequence = ()
) -> DataFrame:
    """Orders, late rate, delivery days and review score per seller.

    Rates and averages weigh item rows; ``total_orders`` counts an order once per seller. The items
    are moved once, by order id: one row of each order and seller is marked in the order the join sorts
    them, and only sums per seller and task move on. Rows of hot orders are grouped instead. The sums are doubles: exact up to 2^53, and
    where repeated orders meet very many items they cannot overflow.
    """
    keys = items.where(F.col("seller_id").isNotNull()).select("order_id", "seller_id")
    marked = keys.withColumn("is_first", is_first("order_id", "seller_id", within="order_id"))
    sides = [
        LookupSide(deliveries_per_order(order_deliveries(orders)), "left"),
        LookupSide(reviews_per_order(reviews), "left"),
    ]
    sums = ["order_rows", "late_rows", "days_sum", "days_rows", "score_sum", "score_rows"]
    has_order = F.when(F.col("order_rows") > 0, 1).otherwise(0)
    weights = [F.col(name).cast("double").alias(name) for name in sums]
    # The parts with hot orders do not read the mark, so it is not made there.
    cold, *stay = lookup_join(marked, "order_id", sides, hot_orders)
    per_item = cold.select("seller_id", F.when(F.col("is_first"), has_order).otherwise(0).alias("orders"), *weights)
    per_order = [
        part.groupBy("seller_id", "order_id")
        .agg(F.max(has_order).alias("orders"), *[F.sum(F.col(name).cast("double")).alias(name) for name in sums])
        .drop("order_id")
        for part in stay
    ]
    per_seller = (
        union_all([per_item, *per_order])
        .groupBy("seller_id")
        .agg(F.sum("orders").alias("orders"), *[F.sum(name).alias(name) for name in sums])
    )
    return per_seller.select(
        "seller_id",
        F.col("orders").alias("total_orders"),
        ratio(F.col("late_rows"), F.col("order_rows")).alias("late_delivery_rate"),
        ratio(F.col("days_sum"), F.col("days_rows")).alias("avg_delivery_days"),
        ratio(F.col("score_sum"), F.col("score_rows")).alias("avg_review_score"),
    )
