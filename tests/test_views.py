from __future__ import annotations

import pytest
from bronze import SILVER

from merchantlens.plans import gold, views

SUMMARY = (
    "total_orders bigint, total_sellers bigint, overall_late_rate double, pct_high_risk_sellers double,"
    " avg_review_score double"
)
STATES = (
    "seller_state string, total_sellers bigint, total_orders bigint, pct_of_total_orders double,"
    " concentration_flag string"
)
RISK = (
    "seller_id string, seller_city string, seller_state string, total_orders bigint, late_delivery_rate double,"
    " avg_review_score double, avg_delivery_days double, risk_tier string"
)


def risk(spark, rows):
    full = [(s, "c", "SP", 1, late, score, 3.456, tier) for s, tier, late, score in rows]
    return spark.createDataFrame(full, RISK)


def summary(spark, *row):
    return spark.createDataFrame([row], SUMMARY)


def test_top_suppliers_puts_unreviewed_last(spark):
    scores = spark.createDataFrame(
        [("a", 4.0), ("b", None), ("c", 5.0), ("d", 4.0)], "seller_id string, avg_review_score double"
    )
    assert [r[0] for r in views.top_suppliers(scores).collect()] == ["c", "a", "d", "b"]
    assert views.top_suppliers(scores, 2).count() == 2
    assert views.top_suppliers(scores, 0).count() == 0
    for limit in (-1, 501):
        with pytest.raises(ValueError):
            views.top_suppliers(scores, limit)


def test_lookup_takes_its_value_as_data(spark):
    cards = spark.createDataFrame([("a",), ("b",)], "seller_id string")
    assert views.supplier_lookup(cards, "a").count() == 1
    assert views.supplier_lookup(cards, "z").count() == 0
    assert views.supplier_lookup(cards, "a' OR '1'='1").count() == 0


def test_risk_view_orders_and_rounds_again(spark):
    rows = [
        ("low", "LOW", 0.1, None),
        ("h1", "HIGH", 0.3125, 1.005),
        ("m", "MEDIUM", 0.2, 4.0),
        ("h2", "HIGH", 0.5, 1.0),
    ]
    shown = views.risk_view(risk(spark, rows)).collect()
    assert [r["seller_id"] for r in shown] == ["h2", "h1", "m", "low"]
    assert (shown[1]["late_rate_pct"], shown[1]["review_score"], shown[1]["delivery_days"]) == (31.3, 1.0, 3.5)
    assert shown[3]["review_score"] is None


def test_tier_counts_and_filter(spark):
    cards = risk(spark, [("a", "HIGH", 0.5, 1.0), ("b", "HIGH", 0.4, 1.0), ("c", "LOW", 0.0, 1.0)])
    counts = {r["risk_tier"]: r["n_sellers"] for r in views.tier_counts(cards).collect()}
    assert counts == {"HIGH": 2, "MEDIUM": 0, "LOW": 1}
    view = views.risk_view(cards)
    assert views.risk_view_by_tier(view).count() == 3
    assert views.risk_view_by_tier(view, "HIGH").count() == 2
    assert views.risk_view_by_tier(view, "MEDIUM").count() == 0
    assert [r[1] for r in views.tier_counts(cards.limit(0)).collect()] == [0, 0, 0]


@pytest.mark.parametrize(
    ("shares", "sentence"),
    [
        ({"SP": 0.5, "MG": 0.21, "RJ": 0.2}, "SP, MG account for >20% of all orders."),
        ({"SP": 0.5, "MG": 0.1}, "SP accounts for >20% of all orders."),
        ({"B": 0.3, "A": 0.3}, "A, B account for >20% of all orders."),
        ({"SP": 0.2}, None),
        ({}, None),
    ],
)
def test_concentration_alert(spark, shares, sentence):
    rows = [(s, 1, 1, share, "HIGH" if share > 0.2 else "NORMAL") for s, share in shares.items()]
    found = views.concentration_alert(spark.createDataFrame(rows, STATES)).collect()
    assert [r["alert"] for r in found] == ([sentence] if sentence else [])


@pytest.mark.parametrize(
    ("late", "high_risk", "review", "classes"),
    [
        (0.1, 0.05, 4.0, ("", "", "")),
        (0.1001, 0.0501, 3.9999, ("warn", "warn", "warn")),
        (0.9, 0.1, 3.5, ("warn", "warn", "warn")),
        (0.0, 0.1001, 3.4999, ("", "danger", "danger")),
        (None, None, None, ("", "", "")),
    ],
)
def test_kpi_severity(spark, late, high_risk, review, classes):
    assert tuple(views.kpi_severity(summary(spark, 1, 1, late, high_risk, review)).first()) == classes


def test_kpi_report(spark):
    report = views.kpi_report(summary(spark, 1234567, 890, 0.3765, 0.1225, 3.125)).first()["report"]
    assert report == (
        f"Total orders: {1234567:,}\nTotal sellers: {890:,}\n"
        f"Overall late delivery rate: {0.3765:.1%}\n% high-risk sellers: {0.1225:.1%}\n"
        f"Average review score: {3.125:.2f} / 5.00"
    )


def test_kpi_report_without_sellers(spark):
    empty = gold.gold_executive_summary(spark.createDataFrame([], SILVER))
    assert views.kpi_report(empty).first()["report"] == (
        "Total orders: n/a\nTotal sellers: 0\nOverall late delivery rate: n/a\n"
        "% high-risk sellers: n/a\nAverage review score: n/a / 5.00"
    )


@pytest.mark.parametrize(
    "query",
    [
        "SELECT id FROM numbers ORDER BY id DESC",
        "SELECT id FROM numbers ORDER BY id DESC;  ",
        "SELECT id FROM numbers ORDER BY id DESC -- note",
        "SELECT id FROM numbers ORDER BY id DESC; -- done\n",
        "SELECT id FROM numbers ORDER BY id DESC -- a; b",
        "WITH n AS (SELECT id FROM numbers) SELECT id FROM n ORDER BY id DESC",
    ],
)
def test_ad_hoc_queries_run(spark, query):
    spark.range(120).createOrReplaceTempView("numbers")
    assert [r[0] for r in views.read_only_sql(spark, query).collect()] == list(range(119, -1, -1))


@pytest.mark.parametrize(
    "query",
    [
        "DROP VIEW numbers",
        "CREATE TABLE t AS SELECT 1",
        "INSERT INTO numbers VALUES (1)",
        "SHOW TABLES",
        "SET spark.sql.ansi.enabled = false",
        "SELECT 1; DROP VIEW numbers",
        "SELECT reflect/**/('java.lang.Math', 'abs', -5)",
        "SELECT java_method --x\n('java.lang.System', 'nanoTime')",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT java_method('java.lang.System', 'nanoTime')",
        "SELECT `reflect`('java.lang.System', 'nanoTime')",
        "SELECT missing FROM numbers",
    ],
)
def test_ad_hoc_statements_that_are_no_query_are_refused(spark, query):
    spark.range(3).createOrReplaceTempView("numbers")
    with pytest.raises(Exception):
        views.read_only_sql(spark, query)
    assert views.read_only_sql_text(spark, query).startswith("SQL error: ")
    assert spark.table("numbers").count() == 3


def test_ad_hoc_results_as_text(spark):
    assert views.read_only_sql_text(spark, "SELECT 1 AS a WHERE 1 = 0") == "Query returned no rows."
    assert views.read_only_sql_text(spark, "SELECT 1 AS a, 'x' AS b").split() == ["a", "b", "1", "x"]


def test_harmless_literals_pass_and_long_results_are_whole(spark):
    assert views.read_only_sql(spark, "SELECT 'reflect (' AS note").first()[0] == "reflect ("
    assert views.read_only_sql(spark, "SELECT id FROM range(60)").count() == 60
    shown = views.read_only_sql_text(spark, "SELECT id FROM range(60) ORDER BY id").splitlines()
    assert len(shown) == 52 and shown[-1] == "... 10 more rows"


def test_nested_calls_are_refused(spark):
    with pytest.raises(ValueError, match="JVM"):
        views.read_only_sql(spark, "SELECT (SELECT reflect('java.lang.Math', 'abs', -5))")
