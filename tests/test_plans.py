"""Physical plans: what is shuffled, pruned and kept out."""

from __future__ import annotations

import json
import re
from collections import Counter

import pytest

from merchantlens.checks.queries import QUERIES
from merchantlens.fixtures import BronzeFixture
from merchantlens.plans import gold, silver
from merchantlens.sources.indicator_pages import INDICATORS
from merchantlens.sources.tables import Bucketing, refresh_table

FOLDER = "/root/testdata/sf0.001"
NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1"}


def plan_of(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text


def exchanges(plan: str) -> list[str]:
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]


@pytest.fixture()
def bronze_tables(spark, layers):
    source = BronzeFixture(spark, FOLDER)

    def store(bucketing=None):
        frames = {
            "sellers": source.sellers, "orders": source.orders,
            "order_items": source.items, "order_reviews": source.reviews,
        }
        for name, df in frames.items():
            layout = bucketing if name != "sellers" else None
            refresh_table(df, layers.table("bronze", name), layout)
        return {name: spark.table(layers.table("bronze", name)) for name in frames}

    return store


def silver_plan(t):
    return plan_of(silver.silver_sellers(t["sellers"], t["orders"], t["order_items"], t["order_reviews"]))


def performance_plan(t):
    typed = silver.silver_orders(t["orders"])
    return plan_of(gold.gold_supplier_performance(t["sellers"], t["order_items"], typed, t["order_reviews"]))


@pytest.mark.parametrize(
    ("plan", "by_order", "after"),
    [
        (silver_plan, 3, {"seller_id"}),
        (performance_plan, 3, {"seller_id", "seller_id, for_order, product_id"}),
    ],
)
def test_each_large_table_is_shuffled_once_by_order(bronze_tables, set_conf, plan, by_order, after):
    """Items, orders and reviews move once each, by order id; later shuffles carry partial sums."""
    set_conf(**NO_BROADCAST)
    keys = exchanges(plan(bronze_tables()))
    assert keys.count("order_id") == by_order
    assert {k for k in keys if not k.startswith(("order_id", "seller_id, seller_city"))} == after
    assert not any("seller_id, order_id" in k for k in keys)


@pytest.mark.parametrize("plan", [silver_plan, performance_plan])
def test_bucketed_bronze_needs_no_shuffle_by_order(bronze_tables, set_conf, plan):
    set_conf(**NO_BROADCAST)
    keys = exchanges(plan(bronze_tables(Bucketing("order_id", 8))))
    assert not any("order_id" in k for k in keys)


@pytest.mark.parametrize("plan", [silver_plan, performance_plan])
def test_no_task_holds_a_table_of_its_sellers_and_orders(bronze_tables, set_conf, plan):
    """Orders of a seller are marked in sorted rows, where a hash table would take most of a task's memory."""
    set_conf(**NO_BROADCAST)
    text = plan(bronze_tables())
    grouped = [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Aggregate\(keys=\[([^\]]*)\]", text)]
    assert grouped and not any("order_id" in keys and "seller_id" in keys for keys in grouped)


def test_scans_read_only_needed_columns(bronze_tables):
    tables = bronze_tables()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", silver_plan(tables))
    items = [s for s in schemas if "seller_id" in s and "order_id" in s]
    assert items == ["order_id:bigint,seller_id:bigint"]
    assert all("order_approved_at" not in s for s in schemas)


def test_lookup_filter_reaches_the_scan(bronze_tables):
    tables = bronze_tables()
    typed = silver.silver_orders(tables["orders"])
    card = gold.gold_supplier_performance(
        tables["sellers"], tables["order_items"], typed, tables["order_reviews"]
    ).where("seller_id = 101")
    assert plan_of(card).count("EqualTo(seller_id,101)") == 2


def test_hot_orders_are_broadcast_and_not_shuffled_by_order(bronze_tables, set_conf):
    set_conf(**NO_BROADCAST)
    t = bronze_tables()
    plan = plan_of(
        silver.silver_sellers(t["sellers"], t["orders"], t["order_items"], t["order_reviews"], [1, 2])
    )
    assert plan.count("BroadcastHashJoin") == 2
    assert exchanges(plan).count("seller_id, order_id") == 1


def test_concentration_total_reuses_the_state_shuffle(spark, layers, bronze_tables):
    t = bronze_tables()
    table = layers.table("silver", "silver_sellers")
    refresh_table(silver.silver_sellers(t["sellers"], t["orders"], t["order_items"], t["order_reviews"]), table)
    result = gold.gold_concentration_risk(spark.table(table))
    result.collect()
    assert "ReusedExchange" in plan_of(result)


# Their results are counts the driver has; the plan that made them is gone.
COUNTED = ("layer_row_counts", "build_if_absent", "bronze_manifest_counts", "one_layer_counts", "declared_sources")


@pytest.mark.parametrize(
    "name",
    [n for n in QUERIES if n not in COUNTED],
)
def test_no_cross_join_expand_or_python(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Expand", "Python", "MapInPandas"):
        assert operator not in plan


def test_top_suppliers_is_a_bounded_top_k(spark):
    assert "TakeOrderedAndProject(limit=50" in plan_of(QUERIES["top_suppliers"](spark, FOLDER))


def test_pages_group_customers_and_not_their_observations(spark):
    """42 observations of each customer are written out after the last shuffle."""
    plan = plan_of(BronzeFixture(spark, FOLDER).indicator_pages)
    assert exchanges(plan) == ["page, code", "_groupingexpression"]
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "2023" not in below and "countryiso3code" not in below


def test_pages_are_written_without_a_structure_per_observation(spark):
    """Only country names, which need escaping, go through JSON, once per nation and before the last shuffle."""
    plan = plan_of(BronzeFixture(spark, FOLDER).indicator_pages)
    top = plan[: plan.index("Exchange hashpartitioning")]
    assert "countryiso3code" in top and "to_json" not in top and "flatten(" not in top


def test_pages_hold_every_observation_of_every_customer(spark, tmp_path):
    names = ['Côte "d\'Ivoire"', "a\\b\n,]}", None]
    customers = [(k, k % 3) for k in (1, 7, 11, 16, 17, 22, 40)] + [(7, 2), (5, 9)]
    spark.createDataFrame(list(enumerate(names)), "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    pages = [json.loads(r["payload"]) for r in BronzeFixture(spark, str(tmp_path)).indicator_pages.collect()]
    assert sum(rows is None for _, rows in pages) == len(names) and all(m == {"page": 1, "pages": 1} for m, _ in pages)
    found = Counter(json.dumps(row, sort_keys=True) for _, rows in pages for row in rows or ())
    expected = Counter(
        json.dumps(
            {
                "countryiso3code": f"N{key}", "country": {"value": names[nation]}, "date": str(year),
                "indicator": {"id": code, "value": f"Logistics {code}"},
                "value": 1 + (key * 3 + position) % 40 / 10 if key % 11 else None,
            },
            sort_keys=True,
        )
        for key, nation in customers if nation < 3
        for position, code in enumerate(INDICATORS)
        for year in range(2018, 2024)
    )
    assert found == expected and all(len(rows) <= 100 for _, rows in pages if rows)
