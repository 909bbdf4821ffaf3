"""Landing files into bronze tables."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from merchantlens.session import scratch_folder
from merchantlens.sources import csv_tables, indicator_pages, trade_flows
from merchantlens.sources.schemas import DECLARED_SOURCES, MANIFEST, CsvTable
from merchantlens.sources.tables import refresh_table, refresh_table_unless_empty

ENTRY = {entry.table: entry for entry in MANIFEST}

ORDERS_CSV = """\
order_id,customer_id,order_status,order_purchase_timestamp,order_estimated_delivery_date,order_delivered_customer_date
a1,c1,delivered,2023-01-01 10:00:00,2023-01-10 00:00:00,2023-01-09 00:00:00
a2,c2,shipped,2023-01-02 11:00:00,2023-01-11 00:00:00,
"""


def land(folder, name, text):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_bytes(text.encode())
    return str(path)


def test_load_one_csv(spark, layers, tmp_path):
    path = land(tmp_path / "raw", "olist_orders_dataset.csv", ORDERS_CSV)
    assert csv_tables.load_csv_table(spark, path, ENTRY["orders"], layers) == 2
    stored = spark.table(layers.table("bronze", "orders"))
    assert stored.count() == 2
    row = stored.where("order_id = 'a1'").first()
    assert row["order_purchase_timestamp"] == datetime(2023, 1, 1, 10)
    assert row["_source_file"] == "olist_orders_dataset.csv"
    assert row["_loaded_at"] is not None
    assert stored.where("order_id = 'a2'").first()["order_delivered_customer_date"] is None
    assert dict(stored.dtypes)["order_delivered_customer_date"] == "timestamp_ntz"


def test_empty_landing_folder_loads_nothing(spark, layers, tmp_path):
    (tmp_path / "raw").mkdir()
    assert csv_tables.load_all_csv(spark, str(tmp_path / "raw"), layers) == {}


def test_missing_landing_folder_is_an_error(spark, layers, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv_tables.load_all_csv(spark, str(tmp_path / "nowhere"), layers)


def test_manifest_loads_what_is_there(spark, layers, tmp_path):
    raw = tmp_path / "raw"
    land(raw, "olist_orders_dataset.csv", ORDERS_CSV)
    land(raw, "olist_sellers_dataset.csv",
         "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01234,sao paulo,SP\n")
    land(raw, "product_category_name_translation.csv",
         "product_category_name,product_category_name_english\nbeleza,beauty\nlivros,books\n")
    land(raw, "unrelated.csv", "a\n1\n")
    loaded = csv_tables.load_all_csv(spark, str(raw), layers)
    assert loaded == {"orders": 2, "sellers": 1, "product_category_name_translation": 2}
    assert spark.table(layers.table("bronze", "sellers")).first()["seller_zip_code_prefix"] == "01234"


@pytest.mark.parametrize("table", ["product_category_name_translation", "order_reviews"])
def test_byte_order_mark_and_crlf(spark, layers, tmp_path, table):
    header = list(ENTRY[table].types)[:2]
    text = "\ufeff" + ",".join(header) + "\r\nbeleza,beauty\r\nlivros,books\r\n"
    path = land(tmp_path / "raw", ENTRY[table].file_name, text)
    assert csv_tables.load_csv_table(spark, path, ENTRY[table], layers) == 2
    rows = spark.table(layers.table("bronze", table)).select(*header).collect()
    assert sorted(tuple(r) for r in rows) == [("beleza", "beauty"), ("livros", "books")]


def test_a_second_load_replaces_the_first(spark, layers, tmp_path):
    path = land(tmp_path / "raw", "olist_orders_dataset.csv", ORDERS_CSV)
    csv_tables.load_csv_table(spark, path, ENTRY["orders"], layers)
    land(tmp_path / "raw", "olist_orders_dataset.csv", "\n".join(ORDERS_CSV.splitlines()[:2]))
    assert csv_tables.load_csv_table(spark, path, ENTRY["orders"], layers) == 1


def test_bad_rows_are_dropped_and_quoting_survives(spark, layers, tmp_path):
    text = (
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,"said ""fine"", twice","line one\nline two",2018-01-18 00:00:00,2018-01-18 21:46:59\n'
        "r2,o2,five,,,2018-01-18 00:00:00,2018-01-18 21:46:59\n"
        "r3,o3\n"
        "r4,o4,1,,,2018-01-18 00:00:00,\n"
    )
    path = land(tmp_path / "raw", "olist_order_reviews_dataset.csv", text)
    assert csv_tables.load_csv_table(spark, path, ENTRY["order_reviews"], layers) == 2
    rows = {r["review_id"]: r for r in spark.table(layers.table("bronze", "order_reviews")).collect()}
    assert set(rows) == {"r1", "r4"}
    assert rows["r1"]["review_comment_title"] == 'said "fine", twice'
    assert rows["r1"]["review_comment_message"] == "line one\nline two"
    assert rows["r4"]["review_comment_message"] is None


def test_columns_match_by_name(spark, layers, tmp_path):
    path = land(tmp_path / "raw", "items.csv", "price,order_id,order_item_id,note\n1.5,007,2,12\n2.5,008,x,13\n")
    assert csv_tables.load_csv_table(spark, path, ENTRY["order_items"], layers) == 1
    stored = spark.table(layers.table("bronze", "order_items"))
    assert dict(stored.dtypes) | {"_loaded_at": ""} == {
        "price": "double", "order_id": "string", "order_item_id": "int", "note": "int",
        "_source_file": "string", "_source_part": "string", "_loaded_at": "",
    }
    assert stored.first()["order_id"] == "007"


def test_unknown_tables_are_inferred(spark, layers, tmp_path):
    path = land(tmp_path / "raw", "other.csv", "a,b,c\n1,x,2.5\n2,y,3.5\n")
    assert csv_tables.load_csv_table(spark, path, CsvTable("other.csv", "other"), layers) == 2
    types = dict(spark.table(layers.table("bronze", "other")).dtypes)
    assert (types["a"], types["b"], types["c"]) == ("int", "string", "double")


def test_part_files_load_as_one_table(spark, layers, tmp_path):
    folder = tmp_path / "raw" / "olist_sellers_dataset.csv"
    folder.mkdir(parents=True)
    for n in range(3):
        land(folder, f"part-{n}.csv", f"seller_id,seller_state\ns{n},SP\nt{n},MG\n")
    assert csv_tables.load_all_csv(spark, str(tmp_path / "raw"), layers) == {"sellers": 6}
    files = spark.table(layers.table("bronze", "sellers")).groupBy("_source_file", "_source_part").count()
    assert sorted(tuple(r) for r in files.collect()) == [
        ("olist_sellers_dataset.csv", f"part-{n}.csv", 2) for n in range(3)
    ]


def test_a_part_with_another_header_fails_the_load(spark, layers, tmp_path):
    folder = tmp_path / "raw" / "olist_sellers_dataset.csv"
    folder.mkdir(parents=True)
    land(folder, "part-0.csv", "seller_id,seller_state\ns,SP\n")
    land(folder, "part-1.csv", "seller_state,seller_id\nSP,t\n")
    with pytest.raises(Exception, match="header"):
        csv_tables.load_all_csv(spark, str(tmp_path / "raw"), layers)


def test_empty_results_leave_the_table(spark, layers):
    table = layers.table("bronze", "t")
    assert refresh_table(spark.range(3), table) == 3
    assert refresh_table_unless_empty(spark.range(0), table) == 0
    assert spark.table(table).count() == 3
    assert refresh_table(spark.range(0), table) == 0
    assert spark.table(table).count() == 0


def page(rows, **meta):
    return json.dumps([{"page": 1, "pages": 1, **meta}, rows])


def observation(code, country="BRA", year="2018", value=2.99):
    return {
        "indicator": {"id": code, "value": f"name of {code}"},
        "country": {"id": "BR", "value": "Brazil"},
        "countryiso3code": country,
        "date": year,
        "value": value,
        "unit": "",
    }


OVERALL, CUSTOMS = indicator_pages.INDICATORS[:2]


def test_indicator_pages(spark, layers, tmp_path):
    raw = tmp_path / "pages"
    land(raw, "1.json", page([observation(OVERALL), observation(OVERALL, year="2017", value=None)]))
    land(raw, "2.json", json.dumps([{"page": 2}, [observation(CUSTOMS, value=3)]], indent=2))
    land(raw, "3.json", page([observation("SP.POP.TOTL")]))
    land(raw, "4.json", page(None))
    land(raw, "5.json", page([]))
    land(raw, "6.json", '[{"message": [{"id": "120"}]}]')
    land(raw, "7.json", "not json")
    with pytest.raises(Exception, match="unreadable indicator page: not json"):
        indicator_pages.load_indicators(spark, str(raw), layers)
    assert indicator_pages.load_indicators(spark, str(raw), layers, skip_unreadable=True) == 3
    stored = spark.table(layers.table("bronze", indicator_pages.TABLE))
    assert stored.columns == [
        "country_code", "country_name", "indicator_code", "indicator_name", "year", "value", "_loaded_at",
    ]
    assert sorted(tuple(r)[:6] for r in stored.where("value IS NOT NULL").collect()) == [
        ("BRA", "Brazil", CUSTOMS, f"name of {CUSTOMS}", "2018", 3.0),
        ("BRA", "Brazil", OVERALL, f"name of {OVERALL}", "2018", 2.99),
    ]
    assert stored.where("value IS NULL").first()["year"] == "2017"
    assert dict(stored.dtypes)["year"] == "string"


def test_pages_without_observations_leave_the_table(spark, layers, tmp_path):
    good = land(tmp_path / "good", "1.json", page([observation(OVERALL)]))
    empty = land(tmp_path / "empty", "1.json", page(None))
    assert indicator_pages.load_indicators(spark, good, layers) == 1
    assert indicator_pages.load_indicators(spark, empty, layers) == 0
    assert spark.table(layers.table("bronze", indicator_pages.TABLE)).count() == 1


@pytest.mark.parametrize(
    "broken",
    [
        page([observation(OVERALL)])[:-40],
        page([observation(OVERALL, value="1.5x")]),
        page([observation(OVERALL), None]),
        page("rows"),
        '{"message": "busy"}',
    ],
)
def test_an_unreadable_page_fails_the_load_and_leaves_the_table(spark, layers, tmp_path, broken):
    raw = tmp_path / "pages"
    land(raw, "1.json", page([observation(OVERALL, value="2.5")]))
    assert indicator_pages.load_indicators(spark, str(raw), layers) == 1
    land(raw, "2.json", broken)
    with pytest.raises(Exception, match="unreadable indicator page"):
        indicator_pages.load_indicators(spark, str(raw), layers)
    pages = indicator_pages.read_pages(spark, str(raw))
    assert [r["payload"] for r in indicator_pages.unreadable_pages(pages).collect()] == [broken]
    assert [r["value"] for r in spark.table(layers.table("bronze", indicator_pages.TABLE)).collect()] == [2.5]


def flow(reporter="76", partner="0", commodity="TOTAL", period="2023", direction="M", value=1.0, **more):
    return {
        "reporterCode": reporter, "partnerCode": partner, "cmdCode": commodity, "period": period,
        "flowCode": direction, "primaryValue": value, **more,
    }


def test_trade_replies(spark, layers, tmp_path):
    raw = tmp_path / "replies"
    land(raw, "1.json", json.dumps({"elapsedTime": "1", "data": [flow(), flow(direction="X", note="n")]}, indent=1))
    land(raw, "2.json", json.dumps({"data": []}))
    land(raw, "3.json", json.dumps({"error": "quota"}))
    records = trade_flows.read_replies(spark, str(raw))
    assert trade_flows.load_trade_flows(records, layers) == 2
    stored = spark.table(layers.table("bronze", trade_flows.TABLE))
    assert set(stored.columns) == {*flow(), "note", "_loaded_at"}
    assert stored.where("flowCode = 'X'").first()["note"] == "n"


@pytest.mark.parametrize("reply", [{"data": []}, {"error": "quota"}, {"data": None}])
def test_replies_without_records_leave_the_table(spark, layers, tmp_path, reply):
    good = land(tmp_path / "good", "1.json", json.dumps({"data": [flow()]}))
    empty = land(tmp_path / "empty", "1.json", json.dumps(reply))
    assert trade_flows.load_trade_flows(trade_flows.read_replies(spark, good), layers) == 1
    assert trade_flows.load_trade_flows(trade_flows.read_replies(spark, empty), layers) == 0
    assert spark.table(layers.table("bronze", trade_flows.TABLE)).count() == 1


@pytest.mark.parametrize("broken", [json.dumps({"data": [flow()]})[:-9], json.dumps({"data": [flow(value="1.5x")]})])
def test_an_unreadable_reply_fails_the_load_and_leaves_the_table(spark, layers, tmp_path, broken):
    raw = tmp_path / "replies"
    schema = "data array<struct<reporterCode string, primaryValue double>>"
    land(raw, "1.json", json.dumps({"data": [flow()]}))
    assert trade_flows.load_trade_flows(trade_flows.read_replies(spark, str(raw), schema), layers) == 1
    land(raw, "2.json", broken)
    with pytest.raises(Exception, match="(?i)malformed"):
        trade_flows.load_trade_flows(trade_flows.read_replies(spark, str(raw), schema), layers)
    assert [r["reply"] for r in trade_flows.unreadable_replies(spark, str(raw), schema).collect()] == [broken]
    assert spark.table(layers.table("bronze", trade_flows.TABLE)).count() == 1
    kept = trade_flows.read_replies(spark, str(raw), schema, skip_unreadable=True)
    assert trade_flows.load_trade_flows(kept, layers) == 1


def test_replies_of_different_shape_merge_in_one_scan(spark, tmp_path):
    """Fields and kinds of number differ between replies; the landing is gone once the replies are read."""
    raw = tmp_path / "replies"
    bodies = [
        {"data": [flow(value=1), flow(value=2.5, note="n", extra={"a": 1, "empty": {}})]},
        {"data": [{"primaryValue": 1.25e7, "code": 7, "list": [1, 2.5], "odd name,`x`": True}, None]},
        {"data": [{"primaryValue": 123456789012, "code": "x7", "nothing": None, "big": 10**22}]},
    ]
    for k, body in enumerate(bodies):
        land(raw, f"{k}.json", json.dumps(body))
    land(raw, "blank.json", " \n")
    records = trade_flows.read_replies(spark, str(raw))
    (raw / "0.json").unlink()
    assert "FileScan text" not in records._jdf.queryExecution().executedPlan().toString()
    types = dict(records.dtypes)
    assert types == dict.fromkeys(flow(), "string") | {
        "primaryValue": "double", "note": "string", "extra": "struct<a:bigint>", "code": "string", "list": "array<double>",
        "odd name,`x`": "boolean", "nothing": "string", "big": "decimal(23,0)",
    }
    assert sorted(r["primaryValue"] for r in records.collect()) == [1.0, 2.5, 1.25e7, 123456789012.0]
    assert {r["code"] for r in records.collect()} == {None, "7", "x7"}
    assert records.where("extra.a = 1").first()["list"] is None


@pytest.mark.parametrize("broken", [json.dumps({"data": [flow()]})[:-9], "busy", json.dumps({"data": [flow(), 3]})])
def test_unreadable_replies_without_a_schema(spark, layers, tmp_path, broken):
    raw = tmp_path / "replies"
    land(raw, "1.json", json.dumps({"data": [flow()]}))
    land(raw, "2.json", broken)
    with pytest.raises(Exception, match="malformed trade reply"):
        trade_flows.read_replies(spark, str(raw))
    assert [r["reply"] for r in trade_flows.unreadable_replies(spark, str(raw)).collect()] == [broken]
    kept = trade_flows.read_replies(spark, str(raw), skip_unreadable=True)
    assert trade_flows.load_trade_flows(kept, layers) == 1


def test_replies_with_a_given_schema(spark, tmp_path):
    path = land(tmp_path, "1.json", json.dumps({"data": [flow(extra=1)]}))
    records = trade_flows.read_replies(
        spark, path, "data array<struct<reporterCode string, primaryValue double>>"
    )
    assert [tuple(r) for r in records.collect()] == [("76", 1.0)]


def test_trade_selection(spark):
    rows = [flow(value=float(n)) for n in range(600)]
    rows += [flow(partner="32"), flow(commodity="01"), flow(period="2022"), flow("32"), flow(direction="X")]
    flows = spark.createDataFrame(rows)
    chosen = trade_flows.select_trade_flows(flows, "76")
    assert sorted(r["primaryValue"] for r in chosen.collect()) == [float(n) for n in range(600)]
    first = trade_flows.select_trade_flows(flows, "76", limit=500)
    assert [r["primaryValue"] for r in first.collect()] == [float(n) for n in range(500)]
    detailed = flows.selectExpr("*", "IF(primaryValue < 9, 'M', 'A') AS freqCode", "'0' AS partner2Code")
    assert trade_flows.select_trade_flows(detailed, "76", frequency="M").count() == 9
    assert trade_flows.select_trade_flows(detailed, "76", second_partner="4").count() == 0
    assert trade_flows.select_trade_flows(flows, "76", trade_flow="X").count() == 1
    assert trade_flows.select_trade_flows(flows, "76", partner="32").count() == 1
    assert trade_flows.select_trade_flows(flows, "76", commodity_code="01", period="2023").count() == 1
    assert trade_flows.select_trade_flows(flows, "76", period="2021").count() == 0


def test_scratch_is_below_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_folder(spark, "x"), scratch_folder(spark, "x")
    assert first.startswith(shared + "/x-") and first != second


def test_declared_sources_cover_the_manifest():
    assert {entry.table for entry in MANIFEST} < set(DECLARED_SOURCES)
    assert len(MANIFEST) == 9 and len(DECLARED_SOURCES) == 11


def test_lineage_comes_from_the_scanned_file(spark, tmp_path):
    path = land(tmp_path, "olist_sellers_dataset.csv", "seller_id\ns\n")
    df = csv_tables.read_csv_table(spark, path, ENTRY["sellers"])
    assert df.select("_source_file").first()[0] == "olist_sellers_dataset.csv"
    assert df.select(F.typeof("_loaded_at")).first()[0] == "timestamp"


def test_unreadable_pages_parse_each_page_once(spark):
    pages = spark.createDataFrame(
        [(1, '[{"page":1},[{"value":"1.5"}]]'), (2, '[{"page":1},[{"value":"1.5x"}]]'), (3, "[{"), (4, " "), (5, None)],
        "n int, payload string",
    )
    found = indicator_pages.unreadable_pages(pages)
    assert found.columns == pages.columns
    assert sorted(r["n"] for r in found.collect()) == [2, 3]
    counted = found.agg(F.count(F.lit(1)))
    # Once for the two parts of a payload, once for the rows in the second.
    assert counted._jdf.queryExecution().executedPlan().toString().count("from_json") == 2
