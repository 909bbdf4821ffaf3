"""The TPC-H-like test tables seen as bronze tables, as ``FIXTURES.md`` part B maps them.

Every frame is a plain transformation of the given parquet tables, so work on it grows with them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantlens.operators.skew import LookupSide, hot_keys, lookup_join, union_all
from merchantlens.sources.indicator_pages import INDICATORS

# Columns of the test tables that are used; a declared schema spares a file footer read per table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_acctbal double",
    "part": "p_partkey bigint, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_extendedprice double,"
    " l_discount double",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
PAGE_SIZE = 100
FIRST_YEAR, LAST_YEAR = 2018, 2023


@dataclass(frozen=True)
class BronzeFixture:
    spark: SparkSession
    folder: str

    def given(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    @property
    def sellers(self) -> DataFrame:
        placed = self.given("customer").join(self.given("nation"), F.expr("c_nationkey = n_nationkey"))
        return placed.join(self.given("region"), F.expr("n_regionkey = r_regionkey")).selectExpr(
            "c_custkey AS seller_id", "n_name AS seller_city", "r_name AS seller_state"
        )

    @property
    def orders(self) -> DataFrame:
        purchased = "o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24)"
        approved = f"{purchased} + INTERVAL '1' HOUR * (1 + o_orderkey % 8)"
        delivered = (
            "o_orderdate + INTERVAL '1' DAY * (3 + o_orderkey % 23) + INTERVAL '1' HOUR * (o_orderkey * 7 % 24)"
        )
        return self.given("orders").selectExpr(
            "o_orderkey AS order_id",
            "o_custkey AS customer_id",
            "o_orderstatus AS order_status",
            f"{purchased} AS order_purchase_timestamp",
            f"{approved} AS order_approved_at",
            f"{approved} + INTERVAL '1' DAY * (1 + o_orderkey % 3) AS order_delivered_carrier_date",
            f"CASE WHEN NOT (o_orderstatus = 'O' AND o_orderkey % 4 = 0) THEN {delivered} END"
            " AS order_delivered_customer_date",
            "o_orderdate + INTERVAL '1' DAY * (10 + o_custkey % 14) AS order_estimated_delivery_date",
        )

    @property
    def items(self) -> DataFrame:
        """Order items with money in hundredths of a cent: whole doubles, exact in any summing order.

        ``o_orderkey`` is a key of the orders, as a lookup side requires.
        """
        buyers = self.given("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey")
        bought = lookup_join(self.given("lineitem"), "l_orderkey", [LookupSide(buyers)], self.hot_orders)
        return (
            union_all(bought)
            .selectExpr(
                "l_orderkey AS order_id",
                "l_linenumber AS order_item_id",
                "l_partkey AS product_id",
                "o_custkey + l_linenumber % 2 AS seller_id",
                "rint(l_extendedprice * 100) * 100 AS price",
                "rint(l_extendedprice * 100) * rint(l_discount * 100) AS freight_value",
            )
            .where("seller_id % 50 <> 0")
        )

    @property
    def items_with_hot_order(self) -> DataFrame:
        """The items, those of every third order moved to order 3."""
        return self.items.withColumn("order_id", F.expr("CASE WHEN order_id % 3 = 0 THEN 3 ELSE order_id END"))

    @property
    def orders_with_repeats(self) -> DataFrame:
        """The orders, every 1500th one carrying the id 3 as well, and every 7th one twice."""
        moved = self.orders.withColumn("order_id", F.expr("CASE WHEN order_id % 1500 = 0 THEN 3 ELSE order_id END"))
        return moved.unionByName(self.orders.where("order_id % 7 = 0"))

    @property
    def reviews(self) -> DataFrame:
        first = "CASE WHEN o_orderkey % 6 <> 0 THEN 1 + o_orderkey % 5 END"
        second = "CASE WHEN o_orderkey % 7 = 0 THEN 1 + (o_orderkey + 2) % 5 END"
        scores = f"explode(array({first}, {second})) AS review_score"
        return (
            self.given("orders").selectExpr("o_orderkey AS order_id", scores).where("review_score IS NOT NULL")
        )

    @cached_property
    def hot_orders(self) -> list:
        return hot_keys(self.given("lineitem"), "l_orderkey")

    @property
    def indicator_pages(self) -> DataFrame:
        """Indicator payloads as text, one row per page of at most 100 observations.

        Countries are the customers, so pages grow with the data; a page holds one indicator and a
        run of customer keys. Beside them there are pages without rows.
        """
        codes = ", ".join(f"'{code}'" for code in INDICATORS)
        years = ", ".join(f"'{year}'" for year in range(FIRST_YEAR, LAST_YEAR + 1))
        customers_per_page = PAGE_SIZE // (LAST_YEAR - FIRST_YEAR + 1)
        # A country's observations of an indicator differ in the year alone, so their text is that of one joined with
        # itself between the years.
        head = (
            """concat('{"countryiso3code":', coalesce(concat('"N', c.c_custkey, '"'), 'null'), ',"country":', c.country,"""
            """ ',"indicator":{"id":"', code, '","value":"Logistics ', code, '"},"date":"')"""
        )
        value = "CASE WHEN c.c_custkey % 11 <> 0 THEN 1 + (c.c_custkey * 3 + position) % 40 / 10 END"
        tail = f"""concat('","value":', coalesce(string({value}), 'null'), '}}')"""
        rows = f"concat({head}, array_join(array({years}), concat({tail}, ',', {head})), {tail})"
        country = "to_json(struct(n_name AS value), map('ignoreNullFields', 'false')) AS country"
        # Only customers are grouped. The pages, 42 observations for each of them, are written out after they are
        # dealt to tasks, however few files the customers come from.
        pages = (
            self.given("customer")
            .join(self.given("nation").selectExpr("n_nationkey", country), F.expr("c_nationkey = n_nationkey"))
            .groupBy(F.expr(f"c_custkey div {customers_per_page}").alias("page"))
            .agg(F.collect_list(F.struct("c_custkey", "country")).alias("customers"))
            .selectExpr("page", "customers", f"posexplode(array({codes})) AS (position, code)")
            .repartition("page", "code")
            .selectExpr(f"array_join(transform(customers, c -> {rows}), ',') AS rows")
            .selectExpr("""concat('[{"page":1,"pages":1},[', rows, ']]') AS payload""")
        )
        return pages.unionByName(
            self.given("nation").selectExpr("""'[{"page":1,"pages":1},null]' AS payload""")
        )

    @property
    def trade_records(self) -> DataFrame:
        """Trade per nation, year, direction, market segment and six more dimensions derived from order keys.

        Orders are summed per customer before they meet the customers, so a customer with many orders
        joins as a few rows.
        """
        dimensions = {
            "partnerCode": "CASE WHEN o_orderkey % 3 = 0 THEN '36' ELSE '0' END",
            "cmdCode": "CASE WHEN o_orderkey % 5 = 0 THEN '85' ELSE 'TOTAL' END",
            "period": "string(year(o_orderdate))",
            "flowCode": "CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE 'X' END",
            "partner2Code": "CASE WHEN o_orderkey % 7 = 0 THEN '36' ELSE '0' END",
            "typeCode": "CASE WHEN o_orderkey % 11 = 0 THEN 'S' ELSE 'C' END",
            "freqCode": "CASE WHEN o_orderkey % 13 = 0 THEN 'M' ELSE 'A' END",
            "clCode": "CASE WHEN o_orderkey % 17 = 0 THEN 'S4' ELSE 'HS' END",
        }
        per_customer = (
            self.given("orders")
            .selectExpr("o_custkey", "o_totalprice", *[f"{sql} AS {name}" for name, sql in dimensions.items()])
            .groupBy("o_custkey", *dimensions)
            .agg(F.expr("sum(cast(o_totalprice AS decimal(14,2))) AS traded"))
        )
        return (
            per_customer.join(self.given("customer"), F.expr("o_custkey = c_custkey"))
            .join(self.given("nation"), F.expr("c_nationkey = n_nationkey"))
            .withColumns({"reporterCode": F.expr("string(n_nationkey)"), "customsCode": F.col("c_mktsegment")})
            .groupBy("reporterCode", *dimensions, "customsCode")
            .agg(F.expr("double(sum(traded)) AS primaryValue"))
        )

    @property
    def answers(self) -> DataFrame:
        prefix = "CASE WHEN turn % 2 = 1 THEN 'ACTION: ' ELSE '' END"
        suffix = "CASE WHEN conv_id % 3 = 0 THEN '\\n  action: follow up \\n• ACTION: bulleted' ELSE '' END"
        return self.given("conversations").selectExpr(
            "conv_id", "turn", f"concat({prefix}, text, {suffix}) AS answer", "text"
        )
