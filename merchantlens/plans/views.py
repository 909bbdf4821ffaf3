"""Reader queries on the gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantlens.functions import printf_round, round_to
from merchantlens.plans.read_only import read_only_query

# Limits, tiers and KPI thresholds the views are defined by.
DEFAULT_TOP_SUPPLIERS = 50
MAX_TOP_SUPPLIERS = 500
SHOWN_SQL_ROWS = 50
RISK_TIERS = ("HIGH", "MEDIUM", "LOW")
ALL_TIERS = "All"
LATE_RATE_WARN = 0.1
HIGH_RISK_DANGER, HIGH_RISK_WARN = 0.1, 0.05
REVIEW_DANGER, REVIEW_WARN = 3.5, 4.0


def top_suppliers(performance: DataFrame, limit: int = DEFAULT_TOP_SUPPLIERS) -> DataFrame:
    """The best reviewed suppliers, unreviewed ones last; a bounded top-k, never a full sort."""
    if not 0 <= limit <= MAX_TOP_SUPPLIERS:
        raise ValueError(f"limit must be between 0 and {MAX_TOP_SUPPLIERS}, not {limit}")
    return performance.orderBy(F.desc_nulls_last("avg_review_score"), "seller_id").limit(limit)


def supplier_lookup(performance: DataFrame, seller_id: object) -> DataFrame:
    """The scorecard of one supplier; no row when it is unknown."""
    return performance.where(F.col("seller_id") == F.lit(seller_id))


def risk_view(risk: DataFrame) -> DataFrame:
    """Risk table for display: late rate in percent, by tier severity and then rate."""
    severity = F.when(F.col("risk_tier") == "HIGH", 1).when(F.col("risk_tier") == "MEDIUM", 2).otherwise(3)
    return risk.select(
        "seller_id",
        "seller_state",
        "risk_tier",
        "total_orders",
        round_to(F.col("late_delivery_rate") * 100, 1).alias("late_rate_pct"),
        round_to(F.col("avg_review_score"), 2).alias("review_score"),
        round_to(F.col("avg_delivery_days"), 1).alias("delivery_days"),
    ).orderBy(severity, F.desc_nulls_last("late_rate_pct"), "seller_id")


def risk_view_by_tier(view: DataFrame, tier: str = ALL_TIERS) -> DataFrame:
    return view if tier == ALL_TIERS else view.where(F.col("risk_tier") == tier)


def tier_counts(risk: DataFrame) -> DataFrame:
    """Sellers per tier; a tier nobody is in reads 0."""
    tier = F.col("risk_tier")
    counted = risk.agg(*[F.count(F.when(tier == name, 1)).alias(name) for name in RISK_TIERS])
    rows = F.array(*[F.struct(F.lit(n).alias("risk_tier"), F.col(n).alias("n_sellers")) for n in RISK_TIERS])
    return counted.select(F.inline(rows))


def concentration_view(concentration: DataFrame) -> DataFrame:
    """State table for display: share in percent, largest first."""
    return _with_percent(concentration).orderBy(F.desc_nulls_last("pct"), F.asc_nulls_last("seller_state"))


def _with_percent(concentration: DataFrame) -> DataFrame:
    return concentration.select(
        "seller_state",
        "total_sellers",
        "total_orders",
        round_to(F.col("pct_of_total_orders") * 100, 2).alias("pct"),
        "concentration_flag",
    )


def concentration_alert(concentration: DataFrame) -> DataFrame:
    """One sentence naming the flagged states, largest share first; no row when there is none.

    Flagged states hold more than a fifth of all orders each, so the list has at most four entries.
    """
    flagged = _with_percent(concentration).where(F.col("concentration_flag") == "HIGH")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("pct")).alias("rank"), "seller_state")))
    states = F.transform(F.col("ranked"), lambda entry: entry["seller_state"])
    verb = F.when(F.size("ranked") == 1, " accounts").otherwise(" account")
    return (
        flagged.agg(ranked.alias("ranked"))
        .where(F.size("ranked") > 0)
        .select(F.concat(F.array_join(states, ", "), verb, F.lit(" for >20% of all orders.")).alias("alert"))
    )


def kpi_severity(summary: DataFrame) -> DataFrame:
    """Display class of the three rated KPIs: '', 'warn' or 'danger'; '' where a KPI is NULL."""
    late, high_risk = F.col("overall_late_rate"), F.col("pct_high_risk_sellers")
    review = F.col("avg_review_score")
    return summary.select(
        F.when(late > LATE_RATE_WARN, "warn").otherwise("").alias("late_rate_class"),
        F.when(high_risk > HIGH_RISK_DANGER, "danger")
        .when(high_risk > HIGH_RISK_WARN, "warn")
        .otherwise("")
        .alias("high_risk_class"),
        F.when(review < REVIEW_DANGER, "danger")
        .when(review < REVIEW_WARN, "warn")
        .otherwise("")
        .alias("review_class"),
    )


def kpi_report(summary: DataFrame) -> DataFrame:
    """The KPI row as five lines of text; a KPI that is NULL reads n/a."""
    lines = [
        _line("Total orders: ", F.format_number("total_orders", 0)),
        _line("Total sellers: ", F.format_number("total_sellers", 0)),
        _line("Overall late delivery rate: ", _percent(F.col("overall_late_rate"))),
        _line("% high-risk sellers: ", _percent(F.col("pct_high_risk_sellers"))),
        _line("Average review score: ", _fixed(F.col("avg_review_score"), 2), " / 5.00"),
    ]
    return summary.select(F.concat_ws("\n", *lines).alias("report"))


def _line(label: str, value: Column, unit: str = "") -> Column:
    return F.concat(F.lit(label), F.coalesce(value, F.lit("n/a")), F.lit(unit))


def _percent(rate: Column) -> Column:
    return F.concat(_fixed(rate * 100, 1), F.lit("%"))


def _fixed(value: Column, digits: int) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", printf_round(value, digits)))


def read_only_sql(spark: SparkSession, query: str) -> DataFrame:
    """Run an ad-hoc query; its whole result, in its own order.

    Only tables and views can be read, with built-in operators and functions: programs, files, method
    calls and registered functions are refused once the query is analysed, however they are spelled.
    """
    return read_only_query(spark, query)


def read_only_sql_text(spark: SparkSession, query: str, shown_rows: int = SHOWN_SQL_ROWS) -> str:
    """The result of an ad-hoc query as a text table; an empty result or an error as a sentence.

    A longer result shows its first rows only, and a last line says how many were left out.
    """
    try:
        result = read_only_sql(spark, query)
        shown = result.limit(shown_rows + 1).toPandas()
        more = result.count() - shown_rows if len(shown) > shown_rows else 0
    except Exception as error:  # the caller is a reader: any failure is reported as text
        return f"SQL error: {error}"
    if shown.empty:
        return "Query returned no rows."
    table = shown.head(shown_rows).to_string(index=False)
    return f"{table}\n... {more} more rows" if more else table
