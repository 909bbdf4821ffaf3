"""Column types of the landed CSV tables, matched to a file's header by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_STRING, _INT, _DOUBLE, _TIMESTAMP = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()


@dataclass(frozen=True)
class CsvTable:
    """A manifest entry: where the file lands, the table it fills and the types of known columns.

    ``free_text`` marks files whose quoted values may hold line breaks, so that a line end need not
    end a record. All files are split by size.
    """

    file_name: str
    table: str
    types: dict[str, T.DataType] = field(default_factory=dict)
    free_text: bool = False


# File names, table names and column names of the public order data set.
MANIFEST = (
    CsvTable(
        "olist_customers_dataset.csv",
        "customers",
        {
            "customer_id": _STRING,
            "customer_unique_id": _STRING,
            "customer_zip_code_prefix": _STRING,
            "customer_city": _STRING,
            "customer_state": _STRING,
        },
    ),
    CsvTable(
        "olist_geolocation_dataset.csv",
        "geolocation",
        {
            "geolocation_zip_code_prefix": _STRING,
            "geolocation_lat": _DOUBLE,
            "geolocation_lng": _DOUBLE,
            "geolocation_city": _STRING,
            "geolocation_state": _STRING,
        },
    ),
    CsvTable(
        "olist_order_items_dataset.csv",
        "order_items",
        {
            "order_id": _STRING,
            "order_item_id": _INT,
            "product_id": _STRING,
            "seller_id": _STRING,
            "shipping_limit_date": _TIMESTAMP,
            "price": _DOUBLE,
            "freight_value": _DOUBLE,
        },
    ),
    CsvTable(
        "olist_order_payments_dataset.csv",
        "order_payments",
        {
            "order_id": _STRING,
            "payment_sequential": _INT,
            "payment_type": _STRING,
            "payment_installments": _INT,
            "payment_value": _DOUBLE,
        },
    ),
    CsvTable(
        "olist_order_reviews_dataset.csv",
        "order_reviews",
        {
            "review_id": _STRING,
            "order_id": _STRING,
            "review_score": _INT,
            "review_comment_title": _STRING,
            "review_comment_message": _STRING,
            "review_creation_date": _TIMESTAMP,
            "review_answer_timestamp": _TIMESTAMP,
        },
        free_text=True,
    ),
    CsvTable(
        "olist_orders_dataset.csv",
        "orders",
        {
            "order_id": _STRING,
            "customer_id": _STRING,
            "order_status": _STRING,
            "order_purchase_timestamp": _TIMESTAMP,
            "order_approved_at": _TIMESTAMP,
            "order_delivered_carrier_date": _TIMESTAMP,
            "order_delivered_customer_date": _TIMESTAMP,
            "order_estimated_delivery_date": _TIMESTAMP,
        },
    ),
    CsvTable(
        "olist_products_dataset.csv",
        "products",
        {
            "product_id": _STRING,
            "product_category_name": _STRING,
            "product_name_lenght": _INT,
            "product_description_lenght": _INT,
            "product_photos_qty": _INT,
            "product_weight_g": _INT,
            "product_length_cm": _INT,
            "product_height_cm": _INT,
            "product_width_cm": _INT,
        },
    ),
    CsvTable(
        "olist_sellers_dataset.csv",
        "sellers",
        {
            "seller_id": _STRING,
            "seller_zip_code_prefix": _STRING,
            "seller_city": _STRING,
            "seller_state": _STRING,
        },
    ),
    CsvTable(
        "product_category_name_translation.csv",
        "product_category_name_translation",
        {"product_category_name": _STRING, "product_category_name_english": _STRING},
    ),
)

# The tables declared as sources of the models.
DECLARED_SOURCES = (
    "customers",
    "geolocation",
    "order_items",
    "order_payments",
    "order_reviews",
    "orders",
    "products",
    "sellers",
    "product_category_name_translation",
    "comtrade_trade_flows",
    "world_bank_lpi",
)
