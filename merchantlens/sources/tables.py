"""Layer namespaces and full-refresh tables.

A table is a view of the version it was last loaded as, and each load writes a version of its own:
``orders`` shows ``orders__v_<time>_<tag>``. Altering the view is one change of the catalog, so readers meet the
old rows or the new ones, never none and never some of both, whenever a load stops and whoever loads beside it.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantlens.operators.skew import hot_keys

# Tasks that share the rows of one hot bucket key while a table is written.
HOT_SPLITS = 64


@dataclass(frozen=True)
class Layers:
    """Names of the three databases, used verbatim, and optionally the folder they live in."""

    bronze: str = "bronze"
    silver: str = "silver"
    gold: str = "gold"
    location: str | None = None

    def table(self, layer: str, name: str) -> str:
        return f"{getattr(self, layer)}.{name}"

    def create(self, spark: SparkSession) -> None:
        for database in (self.bronze, self.silver, self.gold):
            where = f" LOCATION '{self.location}/{database}'" if self.location else ""
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")


@dataclass(frozen=True)
class Bucketing:
    """Optional layout of a large table: hash buckets of one column, one file per bucket.

    Tables bucketed alike join and group on that column without a shuffle. Rows of hot keys are
    written by up to ``HOT_SPLITS`` tasks, as further files of their bucket: ``lookup_join`` reads them
    apart from the cold keys, by files and not by buckets.
    """

    column: str
    buckets: int


@dataclass(frozen=True)
class Clustering:
    """Optional layout for lookups: files hold ranges of one column, sorted, with Bloom filters on it.

    A lookup by that column reads the row groups whose range and filter admit the value; the others
    are skipped by their footers.
    """

    column: str


Layout = Bucketing | Clustering

VERSION = "__v_"
# Versions that were never switched to, and are older than this, belong to loads that were killed.
ABANDONED_AFTER_HOURS = 48
# Table properties: set once a version has been the table's content, and what it was made from.
SWITCHED, MADE_FROM = "merchantlens.switched", "merchantlens.made_from"


def refresh_table(
    df: DataFrame, table: str, layout: Layout | None = None, made_from: Mapping[str, str] | None = None
) -> int:
    """Replace a table by the rows of ``df``; returns the row count of the stored table.

    The rows are written as a new version and counted there; then the table is switched to it. A load
    that fails before leaves the table as it was and takes its version away, and ``df`` may read the
    table. Of two loads at once the later switch counts. Counting what is stored matters: a CSV scan that
    drops bad rows only sees them when it parses every column. ``made_from`` is kept with the version.
    """
    return _load(df, table, layout, made_from or {}, keep_empty=True)


def refresh_table_unless_empty(df: DataFrame, table: str) -> int:
    """Replace a table, but leave it as it is and return 0 when there is nothing to store."""
    return _load(df, table, None, {}, keep_empty=False)


def _load(df: DataFrame, table: str, layout: Layout | None, made_from: Mapping[str, str], keep_empty: bool) -> int:
    spark = df.sparkSession
    version = f"{table}{VERSION}{int(time.time())}_{uuid.uuid4().hex[:12]}"
    try:
        _write(df, version, layout)
        n_rows = spark.table(version).count()
        if n_rows or keep_empty:
            if made_from:
                pairs = ", ".join(f"'{MADE_FROM}.{name}' = '{of}'" for name, of in made_from.items())
                spark.sql(f"ALTER TABLE {version} SET TBLPROPERTIES ({pairs})")
            switch_table(spark, table, version)
    finally:
        # Also after a failure: a version that did not become the table is of no use to anybody.
        if current_version(spark, table) != version:
            spark.sql(f"DROP TABLE IF EXISTS {version}")
    drop_old_versions(spark, table)
    return n_rows


def switch_table(spark: SparkSession, table: str, version: str) -> None:
    """Make a stored version the table's content: one change of the catalog, whatever was there before."""
    if current_version(spark, table) == "":
        if spark.catalog.tableExists(table):
            spark.sql(f"DROP TABLE {table}")  # a table that was stored without versions
        spark.sql(f"CREATE VIEW IF NOT EXISTS {table} AS SELECT * FROM {version}")
    if current_version(spark, table) != version:
        # Altering is one change; CREATE OR REPLACE drops the view and creates it again.
        spark.sql(f"ALTER VIEW {table} AS SELECT * FROM {version}")
    spark.sql(f"ALTER TABLE {version} SET TBLPROPERTIES ('{SWITCHED}' = 'true')")


def current_version(spark: SparkSession, table: str) -> str:
    """The version a table shows; the empty string where there is none."""
    if not spark.catalog.tableExists(table):
        return ""
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    shown = re.search(rf"FROM (\S*{VERSION}\w+)", described.get("View Original Text") or "")
    return shown[1] if shown else ""


def made_from(spark: SparkSession, table: str) -> dict[str, str]:
    """What the table's current version was made from, by input table."""
    version = current_version(spark, table)
    if not version:
        return {}
    rows = spark.sql(f"SHOW TBLPROPERTIES {version}").collect()
    return {r["key"].removeprefix(f"{MADE_FROM}."): r["value"] for r in rows if r["key"].startswith(f"{MADE_FROM}.")}


def versions(spark: SparkSession, table: str) -> list[str]:
    """All stored versions of a table."""
    database, _, name = table.rpartition(".")
    found = spark.sql(f"SHOW TABLES IN {database or 'default'} LIKE '{name}{VERSION}*'").collect()
    return [f"{database}.{r['tableName']}" if database else r["tableName"] for r in found]


def drop_old_versions(spark: SparkSession, table: str) -> None:
    """Drop versions that had their time, and those of loads that were killed long ago.

    A version another load is still writing, or has not switched to yet, is neither and stays.
    """
    oldest = time.time() - 3600 * ABANDONED_AFTER_HOURS
    past = [v for v in versions(spark, table) if _started(v) < oldest or _was_switched(spark, v)]
    # Read last: a version is switched to once, so one of these that is not shown now never will be again.
    shown = current_version(spark, table)
    for version in past:
        if version != shown:
            spark.sql(f"DROP TABLE IF EXISTS {version}")


def _started(version: str) -> int:
    return int(version.rpartition(VERSION)[2].split("_")[0])


def _was_switched(spark: SparkSession, version: str) -> bool:
    try:
        return any(r["key"] == SWITCHED for r in spark.sql(f"SHOW TBLPROPERTIES {version}").collect())
    except AnalysisException:  # dropped by another load since it was listed
        return False


def _write(df: DataFrame, version: str, layout: Layout | None) -> None:
    writer = df.write.format("parquet")
    if isinstance(layout, Bucketing):
        writer = _placed(df, layout).write.format("parquet").bucketBy(layout.buckets, layout.column)
    elif isinstance(layout, Clustering):
        ranged = df.repartitionByRange(F.col(layout.column)).sortWithinPartitions(layout.column)
        writer = ranged.write.format("parquet").option(f"parquet.bloom.filter.enabled#{layout.column}", "true")
    writer.saveAsTable(version)


def _placed(df: DataFrame, bucketing: Bucketing) -> DataFrame:
    """Rows of a cold key in the task of its bucket, rows of hot keys spread over tasks."""
    hot = hot_keys(df, bucketing.column)
    if not hot:
        return df.repartition(bucketing.buckets, bucketing.column)
    is_hot = F.coalesce(F.col(bucketing.column).isin(hot), F.lit(False))
    cold = df.where(~is_hot).repartition(bucketing.buckets, bucketing.column)
    dealt = df.where(is_hot).withColumn("_split", F.spark_partition_id() % HOT_SPLITS)
    return cold.unionByName(dealt.repartition(HOT_SPLITS, "_split").drop("_split"))
