"""Landed pages of a country indicator service to a flat bronze table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantlens.sources.tables import Layers, refresh_table_unless_empty

# The logistics indicators that are loaded, and the fields of a page's rows.
INDICATORS = (
    "LP.LPI.OVRL.XQ",
    "LP.LPI.CUST.XQ",
    "LP.LPI.INFR.XQ",
    "LP.LPI.ITRN.XQ",
    "LP.LPI.LOGS.XQ",
    "LP.LPI.TRAC.XQ",
    "LP.LPI.TIME.XQ",
)
PAGE_ROWS = (
    "array<struct<countryiso3code string, country struct<value string>,"
    " indicator struct<id string, value string>, date string, value string>>"
)
TABLE = "world_bank_lpi"


def read_pages(spark: SparkSession, path: str, page_per_line: bool = False) -> DataFrame:
    """Landed payloads, one per file; with ``page_per_line`` one per line, which suits many pages."""
    return spark.read.text(path, wholetext=not page_per_line).select(F.col("value").alias("payload"))


def _parsed(pages: DataFrame, payload: str) -> DataFrame:
    """``pages`` with ``_rows``, null where there are none, and ``_unreadable``.

    Unreadable are text that is no JSON array, rows that are no array of objects, and values that are
    no numbers. No payload, a blank one, and null, empty or no rows are a page without observations.
    """
    parts = pages.withColumn("_parts", F.from_json(payload, "array<string>"))
    text = F.get("_parts", F.lit(1))
    rows = parts.withColumns({"_text": text, "_rows": F.from_json(text, PAGE_ROWS)})
    wrong = F.exists("_rows", lambda r: r.isNull() | (r["value"].isNotNull() & r["value"].try_cast("double").isNull()))
    given = F.col(payload).isNotNull() & (F.trim(payload) != "")
    unreadable = given & (F.col("_parts").isNull() | (F.col("_text").isNotNull() & F.col("_rows").isNull()) | wrong)
    return rows.withColumn("_unreadable", F.coalesce(unreadable, F.lit(False))).drop("_parts", "_text")


def unreadable_pages(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """The pages ``flatten_pages`` fails on, or leaves out if told so.

    They are picked by a generator: a filter would be moved below the columns it reads, and parse every page once
    for each mention of them.
    """
    picked = F.explode(F.when(F.col("_unreadable"), F.array(F.struct(*pages.columns))))
    return _parsed(pages, payload).select(picked.alias("page")).select("page.*")


def flatten_pages(pages: DataFrame, payload: str = "payload", skip_unreadable: bool = False) -> DataFrame:
    """``[metadata, rows]`` payloads to one flat row per observation.

    A payload without rows (missing, null or empty) contributes nothing; an unreadable one fails the
    query, unless those are to be skipped. The year stays text.
    """
    refused = F.lit(None) if skip_unreadable else F.raise_error(
        F.concat(F.lit("unreadable indicator page: "), F.substring(payload, 1, 200))
    )
    rows = F.when(F.col("_unreadable"), refused).otherwise(F.col("_rows"))
    row: Column = F.col("row")
    return _parsed(pages, payload).select(F.explode(rows).alias("row")).select(
        row["countryiso3code"].alias("country_code"),
        row["country"]["value"].alias("country_name"),
        row["indicator"]["id"].alias("indicator_code"),
        row["indicator"]["value"].alias("indicator_name"),
        row["date"].alias("year"),
        row["value"].cast("double").alias("value"),
    )


def load_indicators(
    spark: SparkSession,
    path: str,
    layers: Layers,
    indicators: Sequence[str] = INDICATORS,
    page_per_line: bool = False,
    skip_unreadable: bool = False,
) -> int:
    """Replace the indicator table by all landed pages of the wanted indicators, in one read.

    Without a single observation the table is left as it is and 0 is returned. An unreadable page fails
    the load and leaves the table, unless such pages are to be skipped (``unreadable_pages`` lists them).
    """
    layers.create(spark)
    flat = flatten_pages(read_pages(spark, path, page_per_line), skip_unreadable=skip_unreadable)
    wanted = flat.where(F.col("indicator_code").isin(*indicators))
    stamped = wanted.withColumn("_loaded_at", F.current_timestamp())
    return refresh_table_unless_empty(stamped, layers.table("bronze", TABLE))
