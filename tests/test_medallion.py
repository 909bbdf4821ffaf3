"""Building the layers into tables."""

from __future__ import annotations

import threading
from graphlib import CycleError

import pytest

from merchantlens.fixtures import BronzeFixture
from merchantlens.operators import skew
from merchantlens.plans import medallion, views
from merchantlens.session import run_when_ready
from merchantlens.sources.tables import Bucketing, refresh_table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def stored_bronze(spark, layers):
    source = BronzeFixture(spark, FOLDER)
    for name, df in {
        "sellers": source.sellers, "orders": source.orders,
        "order_items": source.items, "order_reviews": source.reviews,
    }.items():
        refresh_table(df, layers.table("bronze", name))
    return layers


def content(spark, layers):
    tables = {n: spark.table(layers.table(m.layer, n)) for n, m in medallion.MODELS.items()}
    return {name: sorted(map(repr, df.collect())) for name, df in tables.items()}


def test_models_come_after_their_inputs():
    built: set[str] = set()
    for name, model in medallion.MODELS.items():
        assert {table for layer, table in model.inputs if layer != "bronze"} <= built
        assert all(layer != model.layer for layer, _ in model.inputs)
        built.add(name)


def test_build_is_repeatable_and_independent_of_layout(spark, stored_bronze, monkeypatch):
    first = medallion.build_models(spark, stored_bronze)
    assert list(first) == list(medallion.MODELS)
    before = content(spark, stored_bronze)
    assert {name: len(rows) for name, rows in before.items()} == first
    monkeypatch.setattr(medallion, "hot_keys", lambda df, key: [])
    again = medallion.build_models(spark, stored_bronze, bucketing={"silver_orders": Bucketing("order_id", 4)})
    assert again == first
    assert content(spark, stored_bronze) == before


def test_one_layer_or_model(spark, stored_bronze):
    assert medallion.selected_models("silver") == ["silver_orders", "silver_sellers"]
    with pytest.raises(ValueError):
        medallion.selected_models("platinum")
    with pytest.raises(LookupError, match="silver_sellers"):
        medallion.build_models(spark, stored_bronze, only="gold")
    assert list(medallion.build_models(spark, stored_bronze, only="silver")) == ["silver_orders", "silver_sellers"]
    assert list(medallion.build_models(spark, stored_bronze, only="gold_supplier_risk")) == ["gold_supplier_risk"]


def test_missing_bronze_stops_the_build_before_it_writes(spark, layers):
    with pytest.raises(LookupError, match="order_items"):
        medallion.build_models(spark, layers)
    assert not spark.catalog.tableExists(layers.table("silver", "silver_orders"))


def test_missing_sources(spark, stored_bronze):
    assert set(medallion.missing_sources(spark, stored_bronze)) == {
        "customers", "geolocation", "order_payments", "products",
        "product_category_name_translation", "comtrade_trade_flows", "world_bank_lpi",
    }


def test_build_if_absent(spark, stored_bronze):
    assert set(medallion.build_models_if_absent(spark, stored_bronze)) == set(medallion.MODELS)
    assert medallion.build_models_if_absent(spark, stored_bronze) == {}


def test_invariants_across_the_layers(spark, stored_bronze):
    medallion.build_models(spark, stored_bronze)
    table = {n: spark.table(stored_bronze.table(m.layer, n)) for n, m in medallion.MODELS.items()}
    active = [r for r in table["silver_sellers"].collect() if r["total_orders"] > 0]
    risk, states = table["gold_supplier_risk"].collect(), table["gold_concentration_risk"].collect()
    summary = table["gold_executive_summary"].first()
    cards = {r["seller_id"]: r for r in table["gold_supplier_performance"].collect()}
    assert len(risk) == len(active) == summary["total_sellers"] == sum(r["total_sellers"] for r in states)
    assert sum(r["pct_of_total_orders"] for r in states) == pytest.approx(1, abs=1e-3)
    assert sum(r["total_orders"] for r in states) == summary["total_orders"]
    rates = [r["late_delivery_rate"] for r in active]
    assert min(rates) <= summary["overall_late_rate"] <= max(rates)
    assert {r["seller_id"]: r["total_orders"] for r in active} == {s: r["total_orders"] for s, r in cards.items()}


def test_a_broken_build_is_run_again_and_a_whole_one_is_not(spark, stored_bronze, monkeypatch):
    """Every model exists from a first build; a second one breaks off between two models."""
    medallion.build_models(spark, stored_bronze)
    before = content(spark, stored_bronze)
    failing = medallion.MODELS["gold_concentration_risk"]

    def broken(*args, **kwargs):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        patched.setitem(medallion.MODELS, "gold_concentration_risk", medallion.Model(failing.layer, failing.inputs, broken))
        with pytest.raises(RuntimeError, match="stopped"):
            medallion.build_models(spark, stored_bronze)
    assert not medallion.is_built(spark, stored_bronze)
    assert set(medallion.build_models_if_absent(spark, stored_bronze)) == set(medallion.MODELS)
    assert medallion.is_built(spark, stored_bronze)
    assert medallion.build_models_if_absent(spark, stored_bronze) == {}
    assert content(spark, stored_bronze) == before


def test_a_build_without_its_record_is_not_whole(spark, stored_bronze, monkeypatch):
    with monkeypatch.context() as patched:
        patched.setattr(medallion, "_record_build", lambda spark, layers: None)
        medallion.build_models(spark, stored_bronze)
    assert not medallion.is_built(spark, stored_bronze)
    assert medallion.build_models_if_absent(spark, stored_bronze) != {}


def test_new_input_versions_make_a_build_stale(spark, stored_bronze):
    medallion.build_models(spark, stored_bronze)
    reviews = stored_bronze.table("bronze", "order_reviews")
    refresh_table(spark.table(reviews), reviews)
    assert not medallion.is_built(spark, stored_bronze)
    medallion.build_models_if_absent(spark, stored_bronze)
    assert medallion.is_built(spark, stored_bronze)
    # Silver built anew on its own leaves gold behind.
    medallion.build_models(spark, stored_bronze, only="silver_sellers")
    assert not medallion.is_built(spark, stored_bronze)
    spark.sql(f"DROP VIEW {stored_bronze.table('gold', 'gold_supplier_risk')}")
    assert not medallion.is_built(spark, stored_bronze)


def test_models_start_when_their_inputs_are_stored(spark, stored_bronze, monkeypatch):
    """The scorecard is stored while silver_sellers still waits; the models on silver_sellers come after it."""
    order, scorecard = [], threading.Event()
    refresh = medallion.refresh_table

    def noted(df, table, *rest):
        name = table.partition(".")[2]
        if name == "silver_sellers":
            assert scorecard.wait(120)
        rows = refresh(df, table, *rest)
        order.append(name)
        if name == "gold_supplier_performance":
            scorecard.set()
        return rows

    monkeypatch.setattr(medallion, "refresh_table", noted)
    medallion.build_models(spark, stored_bronze)
    assert order[:3] == ["silver_orders", "gold_supplier_performance", "silver_sellers"]
    assert set(order[3:]) == {"gold_supplier_risk", "gold_concentration_risk", "gold_executive_summary"}


def test_cycles_are_refused_and_failures_stop_what_waits(spark):
    with pytest.raises(CycleError):
        run_when_ready(spark, {"a": ["b"], "b": ["a"], "c": []}, lambda name: pytest.fail("nothing may run"))
    started = []

    def job(name):
        started.append(name)
        if name == "b":
            raise RuntimeError("b failed")
        return name.upper()

    assert run_when_ready(spark, {"z": ["a"], "a": []}, job) == {"z": "Z", "a": "A"}
    with pytest.raises(RuntimeError, match="b failed"):
        run_when_ready(spark, {"c": ["b"], "b": [], "d": ["c"]}, job)
    assert "c" not in started and "d" not in started
    assert run_when_ready(spark, {}, job) == {}


def test_scorecards_are_stored_for_lookups(spark, stored_bronze):
    medallion.build_models(spark, stored_bronze, only="silver")
    medallion.build_models(spark, stored_bronze, only="gold_supplier_performance")
    table = spark.table(stored_bronze.table("gold", "gold_supplier_performance"))
    ids = sorted(r["seller_id"] for r in table.collect())
    found = views.supplier_lookup(table, ids[3])
    assert [r["seller_id"] for r in found.collect()] == [ids[3]]
    assert "PushedFilters: [IsNotNull(seller_id), EqualTo(seller_id" in found._jdf.queryExecution().executedPlan().toString()
    assert views.supplier_lookup(table, -5).count() == 0
