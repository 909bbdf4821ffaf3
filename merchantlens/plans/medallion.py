"""The models in dependency order, and building them into tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from merchantlens.operators.skew import hot_keys
from merchantlens.plans import gold, silver
from merchantlens.session import run_when_ready
from merchantlens.sources.schemas import DECLARED_SOURCES
from merchantlens.sources.tables import Clustering, Layers, Layout, current_version, made_from, refresh_table


@dataclass(frozen=True)
class Model:
    """A stored model: its layer, the (layer, table) inputs in argument order, and its function."""

    layer: str
    inputs: tuple[tuple[str, str], ...]
    build: Callable[..., DataFrame]
    joins_items: bool = False


_BRONZE_SELLERS, _BRONZE_ORDERS = ("bronze", "sellers"), ("bronze", "orders")
_BRONZE_ITEMS, _BRONZE_REVIEWS = ("bronze", "order_items"), ("bronze", "order_reviews")
_SILVER_SELLERS, _SILVER_ORDERS = ("silver", "silver_sellers"), ("silver", "silver_orders")

# Every model comes after the models it reads.
MODELS: dict[str, Model] = {
    "silver_orders": Model("silver", (_BRONZE_ORDERS,), silver.silver_orders),
    "silver_sellers": Model(
        "silver",
        (_BRONZE_SELLERS, _BRONZE_ORDERS, _BRONZE_ITEMS, _BRONZE_REVIEWS),
        silver.silver_sellers,
        joins_items=True,
    ),
    "gold_supplier_performance": Model(
        "gold",
        (_BRONZE_SELLERS, _BRONZE_ITEMS, _SILVER_ORDERS, _BRONZE_REVIEWS),
        gold.gold_supplier_performance,
        joins_items=True,
    ),
    "gold_supplier_risk": Model("gold", (_SILVER_SELLERS,), gold.gold_supplier_risk),
    "gold_concentration_risk": Model("gold", (_SILVER_SELLERS,), gold.gold_concentration_risk),
    "gold_executive_summary": Model("gold", (_SILVER_SELLERS,), gold.gold_executive_summary),
}


# How models are laid out where the caller does not say: the scorecards are looked up by seller.
LAYOUTS: dict[str, Layout] = {"gold_supplier_performance": Clustering("seller_id")}

# Property of the gold database, per model: the version the last whole build left.
BUILT = "merchantlens.built."
UNVERSIONED = "unversioned"


def selected_models(only: str | None = None) -> list[str]:
    """Model names in build order: all of them, one layer's, or a single model."""
    names = [n for n, model in MODELS.items() if only in (None, n, model.layer)]
    if not names:
        raise ValueError(f"no layer or model named {only!r}")
    return names


def missing_sources(spark: SparkSession, layers: Layers, tables: Sequence[str] = DECLARED_SOURCES) -> list[str]:
    """Declared bronze tables that do not exist."""
    return [name for name in tables if not spark.catalog.tableExists(layers.table("bronze", name))]


def needed_models(names: Sequence[str]) -> dict[str, set[str]]:
    """For each of the models, which of them it reads."""
    return {name: {table for _, table in MODELS[name].inputs if table in names} for name in names}


def build_models(
    spark: SparkSession,
    layers: Layers,
    only: str | None = None,
    bucketing: Mapping[str, Layout] | None = None,
) -> dict[str, int]:
    """Build models into tables, full refresh; returns the rows stored per model.

    A model starts as soon as the models it reads are stored, so the supplier scorecard does not wait for
    ``silver_sellers``, and the three models on that one do not compute it again. All inputs that are not
    built here must exist before anything runs. Each model is built from one version of each input and
    keeps their names; the record of what was built is written last. ``bucketing`` says how models are laid out.
    """
    layers.create(spark)
    names = selected_models(only)
    needed = {source for n in names for source in MODELS[n].inputs if source[1] not in names}
    absent = sorted(t for t in (layers.table(*s) for s in needed) if not spark.catalog.tableExists(t))
    if absent:
        raise LookupError(f"missing input tables: {', '.join(absent)}")
    hot_orders: list = []
    if any(MODELS[n].joins_items for n in names):
        hot_orders = hot_keys(spark.table(layers.table(*_BRONZE_ITEMS)), "order_id")
    layouts = {**LAYOUTS, **(bucketing or {})}

    def build(name: str) -> int:
        model = MODELS[name]
        tables = [layers.table(*source) for source in model.inputs]
        shown = {table: current_version(spark, table) for table in tables}
        inputs = [spark.table(shown[table] or table) for table in tables]
        extra = {"hot_orders": hot_orders} if model.joins_items else {}
        return refresh_table(
            model.build(*inputs, **extra),
            layers.table(model.layer, name),
            layouts.get(name),
            {table: version or UNVERSIONED for table, version in shown.items()},
        )

    stored = run_when_ready(spark, needed_models(names), build)
    _record_build(spark, layers)
    return stored


def _record_build(spark: SparkSession, layers: Layers) -> None:
    """Note the version of every model there is, in one change of the catalog."""
    shown = {name: current_version(spark, layers.table(model.layer, name)) for name, model in MODELS.items()}
    pairs = ", ".join(f"'{BUILT}{name}' = '{version}'" for name, version in shown.items())
    spark.sql(f"ALTER DATABASE {layers.gold} SET DBPROPERTIES ({pairs})")


def recorded_build(spark: SparkSession, layers: Layers) -> dict[str, str]:
    """The version of each model by the record of the last build that came to its end."""
    rows = spark.sql(f"DESCRIBE DATABASE EXTENDED {layers.gold}").collect()
    properties = next((r["info_value"] for r in rows if r["info_name"] == "Properties"), "")
    return dict(re.findall(rf"\({re.escape(BUILT)}(\w+),([^)]*)\)", properties))


def is_built(spark: SparkSession, layers: Layers) -> bool:
    """Whether every model is stored as the last whole build left it, from its inputs' present versions."""
    if not spark.catalog.databaseExists(layers.gold):
        return False
    record = recorded_build(spark, layers)
    tables = {layers.table(model.layer, name) for name, model in MODELS.items()}
    tables |= {layers.table(*source) for model in MODELS.values() for source in model.inputs}
    shown = {table: current_version(spark, table) for table in tables}
    for name, model in MODELS.items():
        table = layers.table(model.layer, name)
        present = {t: shown[t] or UNVERSIONED for t in (layers.table(*source) for source in model.inputs)}
        if not shown[table] or record.get(name) != shown[table] or made_from(spark, table) != present:
            return False
    return True


def build_models_if_absent(spark: SparkSession, layers: Layers) -> dict[str, int]:
    """Build everything unless a whole build of the present inputs is stored; returns the rows built, {} if none.

    A build that broke off, a model that was built apart from the others since, and an input that was loaded
    again all make the layers be built anew. Inputs that are not stored by ``refresh_table`` have no
    version and count as unchanged.
    """
    return {} if is_built(spark, layers) else build_models(spark, layers)
