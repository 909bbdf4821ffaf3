"""Small hand-written bronze tables."""

from __future__ import annotations

from datetime import datetime

ORDERS = (
    "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz,"
    " order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz,"
    " order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz"
)
ITEMS = "order_id string, seller_id string, product_id string, price double, freight_value double"
SELLERS = "seller_id string, seller_city string, seller_state string"
REVIEWS = "order_id string, review_score int"
SILVER = (
    "seller_id string, seller_city string, seller_state string, total_orders bigint,"
    " late_delivery_rate double, avg_delivery_days double, avg_review_score double"
)


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def order(order_id, purchased="2023-01-01 10:00", delivered="2023-01-04 09:00", estimated="2023-01-10"):
    return (
        order_id, "c", "delivered", at(purchased), at(purchased), at(purchased), at(delivered), at(estimated)
    )


def item(order_id, seller_id, product_id="p1", price=10.0, freight=1.0):
    return (order_id, seller_id, product_id, price, freight)


class Bronze:
    def __init__(self, spark, sellers, orders, items, reviews):
        self.sellers = spark.createDataFrame(sellers, SELLERS)
        self.orders = spark.createDataFrame(orders, ORDERS)
        self.items = spark.createDataFrame(items, ITEMS)
        self.reviews = spark.createDataFrame(reviews, REVIEWS)
