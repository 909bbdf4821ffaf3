"""Hot keys: results stay whole, and hot rows take the broadcast way."""

from __future__ import annotations

import random

import pytest
from bronze import Bronze, item, order
from pyspark.sql import functions as F

from merchantlens.operators import skew
from merchantlens.operators.sellers import seller_order_rows, seller_order_sums, seller_review_scores
from merchantlens.plans import gold, silver
from merchantlens.sources.tables import Bucketing, refresh_table


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all items on one order, a third of one seller's, repeated orders and reviews."""
    draw = random.Random(3)
    days = [f"2023-01-{d:02d} 12:00" for d in range(1, 29)]
    orders = [
        order(f"o{n}", "2023-01-01 08:00", draw.choice([*days, None]), draw.choice(days)) for n in range(300)
    ]
    orders += [order("hot", "2023-01-01 08:00", d, "2023-01-09 00:00") for d in days[:6]]
    orders += orders[:20]

    def seller():
        return "big" if draw.random() < 0.33 else f"s{draw.randint(0, 40)}"

    def row(order_id):
        return item(order_id, seller(), f"p{draw.randint(0, 60)}", float(draw.randint(1, 900)), float(draw.randint(0, 99)))

    items = [row(f"o{draw.randint(0, 310)}") for _ in range(2000)] + [row("hot") for _ in range(1000)]
    reviews = [(f"o{draw.randint(0, 310)}", draw.choice([1, 2, 3, 4, 5, None])) for _ in range(250)]
    reviews += [("hot", n % 5 + 1) for n in range(7)]
    sellers = [("big", "c", "SP"), *[(f"s{n}", "c", draw.choice(["SP", "MG", None])) for n in range(45)]]
    return Bronze(spark, sellers, orders, items, reviews)


HOT = ["hot", "o1", "unknown"]


def rows(df):
    return sorted(map(repr, df.collect()))


def joined_row_by_row(bronze):
    typed = silver.silver_orders(bronze.orders)
    return bronze.items.join(typed, "order_id").join(bronze.reviews, "order_id", "left")


def test_sketch_finds_every_hot_key_and_only_those(skewed):
    items = skewed.items
    counts = {r["order_id"]: r["count"] for r in items.groupBy("order_id").count().collect()}
    threshold = items.count() * skew.HOT_SHARE
    found = skew.hot_keys(items, "order_id")
    assert set(found) == {key for key, n in counts.items() if n >= threshold}
    assert "hot" in found


def test_null_keys_go_the_ordinary_way(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, n int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, v int")
    for how, expected in (("left", {("a", 1, 10), (None, 2, None), ("b", 3, None)}), ("inner", {("a", 1, 10)})):
        for hot in ([], ["a"]):
            parts = skew.lookup_join(left, "k", [skew.LookupSide(right, how)], hot)
            assert {tuple(r) for r in skew.union_all(parts).collect()} == expected


@pytest.mark.parametrize("hot", [[], HOT], ids=["cold", "hot"])
def test_silver_sellers_on_skew(skewed, hot):
    plain = silver.silver_sellers(skewed.sellers, skewed.orders, skewed.items, skewed.reviews, hot)
    late = F.when(
        F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"), 1.0
    ).otherwise(0.0)
    rates = (
        skewed.items.join(skewed.orders, "order_id")
        .groupBy("seller_id")
        .agg(
            F.count_distinct("order_id").alias("n"),
            F.avg(late).alias("late"),
            F.avg(F.datediff("order_delivered_customer_date", "order_purchase_timestamp")).alias("days"),
        )
    )
    scores = (
        skewed.items.join(skewed.reviews, "order_id").groupBy("seller_id").agg(F.avg("review_score").alias("score"))
    )
    expected = (
        skewed.sellers.join(rates, "seller_id", "left")
        .join(scores, "seller_id", "left")
        .select("seller_id", F.coalesce("n", F.lit(0)).alias("n"), "late", "days", "score")
    )
    found = plain.select(
        "seller_id",
        F.col("total_orders").alias("n"),
        F.col("late_delivery_rate").alias("late"),
        F.col("avg_delivery_days").alias("days"),
        F.col("avg_review_score").alias("score"),
    )
    assert rows(found) == rows(expected)
    assert rows(seller_review_scores(skewed.items, skewed.reviews, hot).where("avg_review_score IS NOT NULL")) == rows(
        scores.select("seller_id", F.col("score").alias("avg_review_score")).where("avg_review_score IS NOT NULL")
    )


@pytest.mark.parametrize("hot", [[], HOT], ids=["cold", "hot"])
def test_performance_on_skew(skewed, hot):
    typed = silver.silver_orders(skewed.orders)
    found = gold.gold_supplier_performance(skewed.sellers, skewed.items, typed, skewed.reviews, hot)
    expected = (
        joined_row_by_row(skewed)
        .groupBy("seller_id")
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            F.count_distinct("product_id").alias("unique_products"),
            F.avg("actual_delivery_days").alias("days"),
            F.avg("review_score").alias("score"),
            F.sum("price").alias("revenue"),
            F.sum("freight_value").alias("freight"),
        )
        .join(skewed.sellers, "seller_id")
        .select(
            "seller_id",
            "seller_city",
            "seller_state",
            "total_orders",
            "unique_products",
            (F.round(F.col("days") * 100) / 100).alias("avg_delivery_days"),
            (F.round(F.col("score") * 100) / 100).alias("avg_review_score"),
            F.col("revenue").alias("total_revenue"),
            F.col("freight").alias("total_freight_cost"),
            (F.round(F.col("freight") / F.col("revenue") * 100 * 100) / 100).alias("freight_pct_of_revenue"),
        )
    )
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_parts_of_a_lookup_join_are_the_join(spark, skewed, how):
    facts = skewed.reviews.groupBy("order_id").agg(F.count("*").alias("n"))
    parts = skew.lookup_join(skewed.items, "order_id", [skew.LookupSide(facts, how)], HOT)
    whole = skewed.items.join(facts, "order_id", how)
    assert sorted(r for p in parts for r in rows(p)) == rows(whole)
    assert len(parts) == 2


def test_sketch_of_nothing(spark):
    empty = spark.createDataFrame([], "k string")
    assert skew.hot_keys(empty, "k") == []
    nulls = spark.createDataFrame([(None,)], "k string")
    assert skew.hot_keys(nulls, "k") == []


def test_sketch_on_many_partitions_and_keys(spark):
    """More distinct keys than counters: the hot ones are still found, with their share."""
    key = F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 100 == 1, -2).otherwise(F.col("id"))
    df = spark.range(0, 300_000, numPartitions=40).select(key.alias("k"))
    assert skew.hot_keys(df, "k") == [-1, -2]


def test_sketch_with_more_partitions_than_rows(spark, set_conf):
    set_conf(**{"spark__sql__adaptive__enabled": "false", "spark__sql__shuffle__partitions": "64"})
    df = spark.range(0, 3, numPartitions=20).selectExpr("'x' AS k")
    assert skew.hot_keys(df, "k") == ["x"]


def test_weights_beyond_bigint_do_not_overflow(spark):
    """Counts per order as a hot key at scale has them: their products exceed a BIGINT."""
    many = 4 * 10**9
    joined = spark.createDataFrame(
        [("s", "o", "p", 2.0, 1.0, many, 3 * many, many, many, 5.0 * many, many)] * 2,
        "seller_id string, order_id string, product_id string, price double, freight_value double,"
        " order_rows bigint, days_sum bigint, days_rows bigint, review_rows bigint, score_sum double,"
        " score_rows bigint",
    )
    row = gold._orders_and_products(joined).where("for_order").first()
    assert row["revenue"] == 4.0 * many * many
    assert row["days"] / row["days_weight"] == 3.0
    assert row["scores"] / row["scores_weight"] == 5.0


def test_a_hot_key_with_two_rows_on_a_lookup_side_fails(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, m int")
    parts = skew.lookup_join(left, "k", [skew.LookupSide(right)], ["a"])
    with pytest.raises(Exception, match="several rows for one k: a"):
        skew.union_all(parts).collect()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("cell_rows", [1, 7, 8192])
def test_split_join_is_the_join(spark, skewed, how, cell_rows, monkeypatch):
    """Hot keys repeated on both sides, on one, on none, and null keys; the grid has one cell or many."""
    monkeypatch.setattr(skew, "CELL_ROWS", cell_rows)
    left = skewed.items.limit(400).unionByName(skewed.items.where("order_id = 'hot'").limit(60))
    left = left.unionByName(spark.createDataFrame([item(None, "s1")] * 3 + [item("o1", "s1")] * 5 + [item("left only", "s")] * 4, left.schema))
    right = skewed.reviews.unionByName(spark.createDataFrame([(None, 1), ("right only", 2), ("right only", 3)], skewed.reviews.schema))
    expected = rows(left.join(right, "order_id", how))
    for hot in ([], ["hot"], ["hot", "o1", "left only", "right only", "nowhere"], ["left only"]):
        found = skew.split_join(left, right, "order_id", how, hot)
        assert found.columns == left.join(right, "order_id", how).columns
        assert rows(found) == expected


def test_a_hot_repeated_order_is_joined_by_many_tasks(spark, set_conf, monkeypatch):
    """No refusal, no broadcast of repeated rows, and no task makes the output of the hot key alone."""
    set_conf(**{"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__enabled": "false"})
    monkeypatch.setattr(skew, "CELL_ROWS", 100)
    left = spark.range(0, 4000, 1, 4).selectExpr("if(id % 2 = 0, 7, id) AS k", "id AS n")
    right = spark.range(0, 1000, 1, 4).selectExpr("if(id % 2 = 0, 7, id) AS k", "id AS m")
    joined = skew.split_join(left, right, "k", "inner", [7])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "hashpartitioning(k" in plan and "__left_part" in plan and "__right_part" in plan
    per_task = joined.where("k = 7").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 2001 * 501  # id 7 is one of them
    assert len(per_task) >= 6 and max(r["count"] for r in per_task) < 400_000


def test_equal_rows_of_a_hot_key_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(skew, "CELL_ROWS", 10)
    left = spark.range(0, 800, 1, 16).selectExpr("1 AS k", "0 AS n")
    dealt = skew._dealt(left, "k", {1: (80, 1)}, ("own", "other"), 0)
    assert dealt.select("own").distinct().count() > 8


def test_bucketed_tables_keep_all_rows_and_split_hot_keys(spark, layers):
    rows = spark.range(0, 4000, 1, 8).selectExpr("if(id % 3 = 0, NULL, if(id % 3 = 1, 'hot', string(id))) AS k", "id")
    table = layers.table("bronze", "split")
    assert refresh_table(rows, table, Bucketing("k", 4)) == 4000
    stored = spark.table(table)
    assert rows.exceptAll(stored).isEmpty() and stored.exceptAll(rows).isEmpty()
    assert stored.where("k = 'hot'").select(F.input_file_name()).distinct().count() > 1


@pytest.mark.parametrize("hot", [[], HOT])
def test_order_sums_are_those_of_the_joined_rows(skewed, hot):
    joined = seller_order_rows(skewed.items, skewed.orders, hot)
    expected = joined.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("delivery_days").alias("days"), F.sum("is_late").alias("late")
    )
    found = seller_order_sums(skewed.items, skewed.orders, hot)
    assert found.dtypes == expected.dtypes
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("hot", [[], [3]])
def test_repeated_hot_orders_are_summed_without_their_pairs(spark, hot):
    """300,000 items and 300,000 rows of one order: 9 x 10^10 pairs, which row by row would not end."""
    items = spark.range(300_000).selectExpr("3L AS order_id", "id % 2 AS seller_id")
    day = "timestamp_ntz'2023-01-01' + INTERVAL '1' DAY"
    orders = spark.range(300_000).selectExpr(
        "3L AS order_id",
        f"{day} AS order_purchase_timestamp",
        f"{day} * (1 + id % 3) AS order_delivered_customer_date",
        f"{day} * 2 AS order_estimated_delivery_date",
    )
    found = seller_order_sums(items, orders, hot)
    assert rows(found) == rows(
        spark.createDataFrame([(n, 45_000_000_000, 45_000_000_000, 15_000_000_000) for n in (0, 1)], found.schema)
    )


def test_order_sums_of_undelivered_and_null_orders(spark):
    items = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (None, 7), (1, None)], "order_id int, seller_id int")
    stamp = "string"
    orders = spark.createDataFrame(
        [(1, "2023-01-01", None, "2023-01-05"), (1, "2023-01-01", None, None), (None, "2023-01-01", None, None)],
        f"order_id int, order_purchase_timestamp {stamp}, order_delivered_customer_date {stamp},"
        f" order_estimated_delivery_date {stamp}",
    )
    assert [tuple(r) for r in seller_order_sums(items, orders).collect()] == [(5, 4, None, 0)]


@pytest.mark.parametrize("within", [None, "k"])
def test_one_row_of_each_combination_is_first(spark, within):
    pairs = [(k, s) for k in (None, 1, 2) for s in (None, "a", "b")] * 3
    df = spark.createDataFrame(pairs, "k int, s string").repartition(4)
    marked = df.withColumn("first", skew.is_first("k", "s", within=within))
    assert marked.count() == len(pairs)
    assert rows(marked.where("first").select("k", "s")) == rows(df.distinct())
