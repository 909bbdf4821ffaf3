"""Refreshed tables: one whole version whenever a load stops and whoever loads beside it."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantlens.sources import tables
from merchantlens.sources.tables import Bucketing, Clustering, refresh_table, refresh_table_unless_empty


@pytest.fixture()
def table(spark, layers):
    name = layers.table("bronze", "t")
    refresh_table(spark.range(10).selectExpr("id", "'old' AS kind"), name)
    return name


def new_rows(spark, n=7):
    return spark.range(n).selectExpr("id", "'new' AS kind", "id * 2 AS more")


def content(spark, name):
    kinds = {r["kind"]: r["n"] for r in spark.table(name).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert len(kinds) == 1
    return next(iter(kinds.items()))


def assert_one_version(spark, name):
    assert tables.versions(spark, name) == [tables.current_version(spark, name)]
    database, _, short = name.partition(".")
    listed = {r["tableName"] for r in spark.sql(f"SHOW TABLES IN {database}").collect()}
    assert {n for n in listed if n.startswith(short)} == {short, tables.current_version(spark, name).partition(".")[2]}


def test_a_refresh_replaces_rows_and_columns(spark, table):
    assert refresh_table(new_rows(spark), table) == 7
    assert spark.table(table).columns == ["id", "kind", "more"] and content(spark, table) == ("new", 7)
    assert_one_version(spark, table)
    assert refresh_table(spark.table(table).where("id < 3"), table) == 3  # a table may be made from itself
    assert content(spark, table) == ("new", 3)


def failing_sql(monkeypatch, start, after=False):
    """Raise in place of, or right after, the first statement that starts so."""
    run = SparkSession.sql

    def sql(self, statement, *args, **kwargs):
        hit = statement.startswith(start)
        result = run(self, statement, *args, **kwargs) if after or not hit else None
        if hit:
            raise RuntimeError("stopped")
        return result

    monkeypatch.setattr(SparkSession, "sql", sql)


def test_a_stop_while_rows_are_written(spark, table):
    broken = new_rows(spark).withColumn("more", F.expr("if(id = 5, raise_error('bad row'), id)"))
    with pytest.raises(Exception, match="bad row"):
        refresh_table(broken, table)
    assert content(spark, table) == ("old", 10)
    assert_one_version(spark, table)


@pytest.mark.parametrize(
    ("start", "after", "expected"),
    [
        ("ALTER VIEW", False, ("old", 10)),  # before the switch
        ("ALTER VIEW", True, ("new", 7)),  # in it: the catalog has changed, the caller does not know
        ("ALTER TABLE", False, ("new", 7)),  # after it
        ("SHOW TABLES", False, ("new", 7)),  # while old versions are looked for
    ],
)
def test_a_stop_around_the_switch_leaves_one_whole_version(spark, table, monkeypatch, start, after, expected):
    with monkeypatch.context() as patched:
        failing_sql(patched, start, after)
        with pytest.raises(RuntimeError, match="stopped"):
            refresh_table(new_rows(spark), table)
    assert content(spark, table) == expected
    # The next load clears up whatever the stopped one could not.
    assert refresh_table(new_rows(spark, 4), table) == 4
    assert content(spark, table) == ("new", 4)
    tables.drop_old_versions(spark, table)
    left = set(tables.versions(spark, table)) - {tables.current_version(spark, table)}
    assert not left or (start, after) == ("ALTER VIEW", True) or start == "ALTER TABLE"


def test_a_killed_load_leaves_the_table_and_goes_in_time(spark, table, monkeypatch):
    """A version nobody switched to stays while its load may still run, and is dropped once it cannot."""
    abandoned = f"{table}{tables.VERSION}{1_600_000_000}_killed"
    running = f"{table}{tables.VERSION}{int(tables.time.time())}_running"
    for version in (abandoned, running):
        new_rows(spark).write.saveAsTable(version)
    assert refresh_table(new_rows(spark, 4), table) == 4
    assert set(tables.versions(spark, table)) == {tables.current_version(spark, table), running}
    tables.switch_table(spark, table, running)
    assert content(spark, table) == ("new", 7)
    tables.drop_old_versions(spark, table)
    assert_one_version(spark, table)


def test_two_loads_at_once(spark, table):
    """The loads overlap from before their first row to their switch; a reader meets whole versions only."""
    both = threading.Barrier(2)
    sizes = {"a": 2000, "b": 3000}
    seen, failures = set(), []

    def load(kind):
        try:
            rows = spark.range(sizes[kind]).selectExpr("id", f"'{kind}' AS kind")
            for _ in range(3):
                both.wait(60)
                assert refresh_table(rows, table) == sizes[kind]
        except Exception as error:
            failures.append(error)
            both.abort()

    def read():
        while any(w.is_alive() for w in writers):
            try:
                seen.add(content(spark, table))
            except Exception as error:
                # A reader that has planned on a version which is dropped before it reads has to read again.
                if "FAILED_READ_FILE" not in str(error) and "TABLE_OR_VIEW_NOT_FOUND" not in str(error) and "PATH_NOT_FOUND" not in str(error):
                    failures.append(error)

    writers = [threading.Thread(target=load, args=(kind,)) for kind in sizes]
    reader = threading.Thread(target=read)
    for thread in (*writers, reader):
        thread.start()
    for thread in (*writers, reader):
        thread.join()
    assert not failures
    assert seen <= {("old", 10), ("a", 2000), ("b", 3000)}
    assert content(spark, table) in {("a", 2000), ("b", 3000)}
    tables.drop_old_versions(spark, table)
    assert_one_version(spark, table)


def test_tables_stored_without_versions_and_empty_results(spark, layers):
    name = layers.table("bronze", "plain")
    spark.range(3).write.saveAsTable(name)
    assert tables.current_version(spark, name) == "" and tables.made_from(spark, name) == {}
    assert refresh_table_unless_empty(spark.range(0), name) == 0
    assert spark.table(name).count() == 3 and tables.versions(spark, name) == []
    assert refresh_table(spark.range(4), name) == 4
    assert spark.table(name).count() == 4
    assert_one_version(spark, name)


def test_what_a_version_was_made_from(spark, table):
    source = tables.current_version(spark, table)
    other = table + "_2"
    refresh_table(spark.table(table), other, made_from={table: source})
    assert tables.made_from(spark, other) == {table: source}
    assert isinstance(spark.table(other), DataFrame)


def rows_scanned(df):
    """Rows the file scans of an executed query handed on: those of the row groups that were not skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_lookups_skip_files_and_row_groups(spark, layers, set_conf):
    name = layers.table("gold", "cards")
    set_conf(**{"spark__sql__adaptive__coalescePartitions__enabled": "false"})
    cards = spark.range(0, 80_000, 1, 8).selectExpr("id * 2 AS seller_id", "uuid() AS city")
    refresh_table(cards, name, Clustering("seller_id"))
    found = spark.table(name).where("seller_id = 30000")
    assert [r["seller_id"] for r in found.collect()] == [30000]
    assert 0 < rows_scanned(found) < 20_000
    # Between the ends of a range, but in no Bloom filter.
    assert rows_scanned(spark.table(name).where("seller_id = 30001")) == 0
    plain = layers.table("gold", "plain_cards")
    refresh_table(cards.orderBy(F.rand(1)), plain)
    assert rows_scanned(spark.table(plain).where("seller_id = 30000")) > 70_000


def test_bucketed_versions_stay_bucketed(spark, layers, set_conf):
    set_conf(**{"spark__sql__autoBroadcastJoinThreshold": "-1"})
    for name in ("l", "r"):
        refresh_table(spark.range(100), layers.table("silver", name), Bucketing("id", 4))
    joined = spark.table(layers.table("silver", "l")).join(spark.table(layers.table("silver", "r")), "id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
