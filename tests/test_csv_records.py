"""CSV files with line breaks in values, cut into records by many tasks, against Spark's reader in one task."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from merchantlens.sources import csv_records, csv_tables
from merchantlens.sources.schemas import MANIFEST, CsvTable

REVIEWS = next(entry for entry in MANIFEST if entry.table == "order_reviews")
HEADER = "review_id,order_id,review_score,review_comment_title,review_comment_message"
RNG = random.Random(8)


def in_one_task(spark, path):
    """The reader's own way, which holds a whole file in one task."""
    schema = ", ".join(f"{name} {REVIEWS.types[name].simpleString()}" for name in HEADER.split(","))
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "DROPMALFORMED"}
    return rows(spark.read.schema(schema).options(**options).csv(path))


def rows(df):
    return sorted(map(repr, df.select(*HEADER.split(",")).collect()))


def field(text):
    return '"' + text.replace('"', '""') + '"'


def message():
    parts = ["word", " ", ",", "\n", '"', '""', "\n\n", "é", "x" * 30, '","', '\n"', '"\n', "\\", "'"]
    return "".join(RNG.choice(parts) for _ in range(RNG.randint(0, 8)))


def records(n):
    for k in range(n):
        score = RNG.choice(["5", "1", "", "five"])
        tail = [f",{field(message())}", "", ",plain", f",{field(message())},one more"][0 if RNG.random() < 0.8 else RNG.randint(1, 3)]
        yield f"r{k},o{k},{score},{field(message())}{tail}"


@pytest.fixture()
def small_blocks(set_conf):
    def cut(n_bytes):
        set_conf(**{"spark__sql__files__maxPartitionBytes": f"{n_bytes}b", "spark__sql__files__openCostInBytes": "1b"})

    return cut


@pytest.mark.parametrize("block", [60, 1000])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("last", ["", "\n\n\n"])
def test_records_equal_the_reader(spark, tmp_path, small_blocks, block, line_end, last):
    path = str(tmp_path / "reviews.csv")
    text = line_end.join([HEADER, *records(60)]) + last
    with open(path, "w", newline="", encoding="utf-8") as file:
        file.write(text)
    expected = in_one_task(spark, path)
    small_blocks(block)
    assert spark.read.text(path).rdd.getNumPartitions() > (20 if block < 1000 else 1)
    found = csv_tables.read_csv_table(spark, path, REVIEWS)
    assert len(expected) > 20 and rows(found) == expected


def test_every_place_of_a_block_border(spark, tmp_path, small_blocks):
    """One record over many lines: each block size puts the borders elsewhere."""
    path = str(tmp_path / "reviews.csv")
    long = "a\nb\n\"\"\n,\n" * 4
    text = f'{HEADER}\nr1,o1,5,t,{field(long)}\nr2,o2,4,"\n",x\n"r3",o3,3,"a ""b""","\n\n"\n'
    with open(path, "w", newline="") as file:
        file.write(text)
    expected = in_one_task(spark, path)
    assert len(expected) == 3
    for block in (2, 5, 7, 11, 16, 29, 64):
        small_blocks(block)
        assert rows(csv_tables.read_csv_table(spark, path, REVIEWS)) == expected, block


def test_one_large_file_is_many_tasks(spark, tmp_path, small_blocks):
    path = str(tmp_path / "reviews.csv")
    with open(path, "w", newline="") as file:
        file.write("\n".join([HEADER, *records(2000)]) + "\n")
    small_blocks(8000)
    placed = csv_records._placed_lines(spark, path)
    tasks = placed.groupBy("block").agg(F.count("*").alias("n")).collect()
    assert len(tasks) > 10 and max(t["n"] for t in tasks) < sum(t["n"] for t in tasks) / 5
    assert spark.read.option("multiLine", True).csv(path).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("line", ['r1,o1,5,5" screen,x', 'r1,o1,5,"open', 'r1,o1,5,"a"b,x', 'r1,o1,5, "a",x'])
def test_quotes_that_enclose_no_field_leave_the_file_to_one_task(spark, tmp_path, small_blocks, line, caplog):
    path = str(tmp_path / "reviews.csv")
    text = "\n".join([HEADER, "r0,o0,1,a,b", line, 'r2,o2,2,6" disk,y', 'r3,o3,3,"x\ny",z', ""])
    with open(path, "w", newline="") as file:
        file.write(text)
    expected = in_one_task(spark, path)
    small_blocks(9)
    with pytest.raises(csv_records.IrregularQuotes):
        csv_records.quoted_records(spark, path)
    assert rows(csv_tables.read_csv_table(spark, path, REVIEWS)) == expected
    assert "read by one task" in caplog.text


def test_lone_carriage_returns_leave_the_file_to_one_task(spark, tmp_path):
    path = str(tmp_path / "reviews.csv")
    with open(path, "w", newline="") as file:
        file.write("\r".join([HEADER, "r0,o0,1,a,b", 'r1,o1,2,"c\rd",e', ""]))
    expected = in_one_task(spark, path)
    assert len(expected) == 2 and rows(csv_tables.read_csv_table(spark, path, REVIEWS)) == expected


def test_part_files_and_their_headers(spark, tmp_path, small_blocks):
    folder = tmp_path / "reviews.csv"
    folder.mkdir()
    for k in range(3):
        (folder / f"part-{k}.csv").write_text("\n".join([HEADER, *records(9), f'x{k},o,5,t,"a\nb"', ""]))
    expected = in_one_task(spark, str(folder))
    small_blocks(50)
    found = csv_tables.read_csv_table(spark, str(folder), REVIEWS)
    assert rows(found) == expected
    parts = {r["review_id"]: r["_source_part"] for r in found.where("review_id LIKE 'x%'").collect()}
    assert parts == {f"x{k}": f"part-{k}.csv" for k in range(3)}
    (folder / "part-9.csv").write_text("order_id,review_id\no,r\n")
    with pytest.raises(ValueError, match="header differs"):
        csv_tables.read_csv_table(spark, str(folder), REVIEWS)


@pytest.mark.parametrize("text", ["", HEADER, f"{HEADER}\n", f"﻿{HEADER}\r\n\r\n"])
def test_files_without_records(spark, tmp_path, text):
    path = tmp_path / "reviews.csv"
    path.write_text(text, newline="")
    assert csv_tables.read_csv_table(spark, str(path), REVIEWS).count() == 0


def test_unknown_columns_are_typed_without_a_second_scan(spark, tmp_path):
    text = (
        "a,b,c,d,e,f,g,h\n1,3000000000,1.5,2020-01-01 10:00:00,true,007,x,\n-2,1,2,2020-01-02,FALSE,8,1,\n"
        ",,,,,,,\n3,2,1e3,2021-01-01,false,9,2,\n"
    )
    path = tmp_path / "other.csv"
    path.write_text(text)
    inferred = spark.read.options(header=True, inferSchema=True, preferDate=False).csv(str(path))
    for free_text in (False, True):
        found = csv_tables.read_csv_table(spark, str(path), CsvTable("other.csv", "other", {}, free_text))
        assert dict(found.dtypes) == dict(inferred.dtypes) | {
            "_source_file": "string", "_source_part": "string", "_loaded_at": "timestamp"
        }
        assert sorted(map(repr, found.select(*"abcdefgh").collect())) == sorted(map(repr, inferred.collect()))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FileScan csv" not in plan and "FileScan text" not in plan
