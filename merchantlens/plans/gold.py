"""Gold models: the four scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantlens.functions import ratio, round_to
from merchantlens.operators.orders import deliveries_per_order, reviews_per_order
from merchantlens.operators.skew import LookupSide, is_first, lookup_join, union_all

# Tier and flag thresholds, all strict and applied before rounding.
HIGH_LATE_RATE = 0.3
MEDIUM_LATE_RATE = 0.15
HIGH_STATE_SHARE = 0.2


def gold_supplier_performance(
    sellers: DataFrame,
    items: DataFrame,
    silver_orders: DataFrame,
    reviews: DataFrame,
    hot_orders: Sequence = (),
) -> DataFrame:
    """Orders, products, delivery, reviews, revenue and freight of every seller with orders.

    An order with several reviews counts its items once per review, in revenue and freight too, and
    a repeated seller row counts them again; only the two distinct counts are free of that.

    Every joined item row is taken twice, once for its order with the sums and once for its product
    id, so both distinct counts come out of one pass: orders are marked where the join left them, by
    order id, and products counted after a shuffle of distinct (seller, product) pairs. No single
    seller's rows ever meet in one task, and no task holds a table of its (seller, order) pairs.
    """
    deliveries = silver_orders.select(
        "order_id", F.col("actual_delivery_days").alias("delivery_days"), F.lit(0).alias("is_late")
    )
    sides = [
        LookupSide(deliveries_per_order(deliveries), "inner"),
        LookupSide(reviews_per_order(reviews), "left"),
    ]
    sold = items.where(F.col("seller_id").isNotNull()).select(
        "order_id", "seller_id", "product_id", "price", "freight_value"
    )
    cold, *stay = lookup_join(sold, "order_id", sides, hot_orders)
    parts = [_marked_orders_and_products(cold), *[_orders_and_products(part) for part in stay]]
    per_product = (
        union_all(parts)
        .groupBy("seller_id", "for_order", "product_id")
        .agg(F.sum("orders").alias("orders"), *[F.sum(name).alias(name) for name in _SUMS])
    )
    per_seller = per_product.groupBy("seller_id").agg(
        F.sum(F.when(F.col("for_order"), F.col("orders"))).alias("total_orders"),
        F.count(F.when(~F.col("for_order"), F.col("product_id"))).alias("unique_products"),
        *[F.sum(name).alias(name) for name in _SUMS],
    )
    known = sellers.groupBy("seller_id", "seller_city", "seller_state").agg(
        F.count(F.lit(1)).alias("seller_rows")
    )
    return known.join(per_seller, "seller_id").select(
        "seller_id",
        "seller_city",
        "seller_state",
        "total_orders",
        "unique_products",
        round_to(ratio(F.col("days"), F.col("days_weight")), 2).alias("avg_delivery_days"),
        round_to(ratio(F.col("scores"), F.col("scores_weight")), 2).alias("avg_review_score"),
        (F.col("revenue") * F.col("seller_rows")).alias("total_revenue"),
        (F.col("freight") * F.col("seller_rows")).alias("total_freight_cost"),
        round_to(ratio(F.col("freight"), F.col("revenue")) * 100, 2).alias("freight_pct_of_revenue"),
    )


_SUMS = ["revenue", "freight", "days", "days_weight", "scores", "scores_weight"]


def _weighted(joined: DataFrame) -> DataFrame:
    """The sums every joined item row adds.

    Weights are doubles: exact up to 2^53, and item, order and review counts that multiply to more
    than a BIGINT holds do not overflow.
    """
    orders = F.col("order_rows").cast("double")
    reviews = F.greatest(F.coalesce("review_rows", F.lit(0)), F.lit(1)).cast("double")
    sums = {
        "revenue": F.col("price") * (orders * reviews),
        "freight": F.col("freight_value") * (orders * reviews),
        "days": F.col("days_sum") * reviews,
        "days_weight": F.col("days_rows") * reviews,
        "scores": F.col("score_sum") * orders,
        "scores_weight": F.col("score_rows") * orders,
    }
    return joined.select("seller_id", "order_id", "product_id", *[value.alias(name) for name, value in sums.items()])


def _marked_orders_and_products(joined: DataFrame) -> DataFrame:
    """Two rows per item: one with the sums and, on one item of each (seller, order), the order; one for the product."""
    for_order = F.col("for_order")
    marked = _weighted(joined).withColumn("is_first", is_first("order_id", "seller_id"))
    return marked.withColumn("for_order", F.explode(F.array(F.lit(True), F.lit(False)))).select(
        "seller_id",
        "for_order",
        F.when(~for_order, F.col("product_id")).alias("product_id"),
        F.when(for_order, F.col("is_first").cast("bigint")).alias("orders"),
        *[F.when(for_order, F.col(name)).alias(name) for name in _SUMS],
    )


def _orders_and_products(joined: DataFrame) -> DataFrame:
    """(seller, order) rows with the sums, and (seller, order, product) rows without."""
    for_order = F.col("for_order")
    return (
        _weighted(joined)
        .withColumn("for_order", F.explode(F.array(F.lit(True), F.lit(False))))
        .groupBy(
            "seller_id",
            "order_id",
            "for_order",
            F.when(~for_order, F.col("product_id")).alias("product_id"),
        )
        .agg(*[F.sum(F.when(for_order, F.col(name))).alias(name) for name in _SUMS])
        .select("seller_id", "for_order", "product_id", for_order.cast("bigint").alias("orders"), *_SUMS)
    )


def gold_supplier_risk(silver_sellers: DataFrame) -> DataFrame:
    """Active sellers with rounded metrics and a tier taken from the unrounded late rate."""
    late = F.col("late_delivery_rate")
    return _active(silver_sellers).select(
        "seller_id",
        "seller_city",
        "seller_state",
        "total_orders",
        round_to(late, 4).alias("late_delivery_rate"),
        round_to(F.col("avg_review_score"), 4).alias("avg_review_score"),
        round_to(F.col("avg_delivery_days"), 2).alias("avg_delivery_days"),
        F.when(late > HIGH_LATE_RATE, "HIGH")
        .when(late > MEDIUM_LATE_RATE, "MEDIUM")
        .otherwise("LOW")
        .alias("risk_tier"),
    )


def gold_concentration_risk(silver_sellers: DataFrame) -> DataFrame:
    """Each state's share of all orders (an order counts once per seller), largest first.

    The grand total is a scalar subquery on the per-seller sums. Both readers of those sums need
    all their columns, so the subquery reuses their shuffle: no cross join, no second computation.
    """
    per_seller = (
        _active(silver_sellers)
        .groupBy("seller_state", "seller_id")
        .agg(F.sum("total_orders").alias("orders"))
    )
    by_state = per_seller.groupBy("seller_state").agg(
        F.count("seller_id").alias("total_sellers"), F.sum("orders").alias("total_orders")
    )
    all_orders = per_seller.agg(F.sum("orders").alias("all_orders")).scalar()
    share = ratio(F.col("total_orders"), all_orders)
    return by_state.select(
        "seller_state",
        "total_sellers",
        "total_orders",
        round_to(share, 4).alias("pct_of_total_orders"),
        F.when(share > HIGH_STATE_SHARE, "HIGH").otherwise("NORMAL").alias("concentration_flag"),
    ).orderBy(F.desc("total_orders"), F.asc_nulls_last("seller_state"))


def gold_executive_summary(silver_sellers: DataFrame) -> DataFrame:
    """One row of KPIs over the active sellers; on no sellers, counts 0 and the rest NULL.

    Sellers are first collapsed to one row per id, so the two distinct counts become plain sums of
    partial results.
    """
    orders, late = F.col("total_orders"), F.col("late_delivery_rate")
    per_seller = (
        _active(silver_sellers)
        .groupBy("seller_id")
        .agg(
            F.max((late > HIGH_LATE_RATE).cast("bigint")).alias("is_high_risk"),
            F.sum(orders).alias("orders"),
            F.sum(orders * late).alias("late_orders"),
            F.sum("avg_review_score").alias("scores"),
            F.count("avg_review_score").alias("scored"),
        )
    )
    high_risk = F.sum(F.when(F.col("seller_id").isNotNull(), F.col("is_high_risk")))
    totals = per_seller.agg(
        F.sum("orders").alias("total_orders"),
        F.count("seller_id").alias("total_sellers"),
        F.coalesce(high_risk, F.lit(0)).alias("high_risk_sellers"),
        F.sum("late_orders").alias("late_orders"),
        F.sum("scores").alias("scores"),
        F.sum("scored").alias("scored"),
    )
    return totals.select(
        "total_orders",
        "total_sellers",
        round_to(ratio(F.col("late_orders"), F.col("total_orders")), 4).alias("overall_late_rate"),
        round_to(ratio(F.col("high_risk_sellers"), F.col("total_sellers")), 4).alias("pct_high_risk_sellers"),
        round_to(ratio(F.col("scores"), F.col("scored")), 4).alias("avg_review_score"),
    )


def _active(silver_sellers: DataFrame) -> DataFrame:
    return silver_sellers.where(F.col("total_orders") > 0)
