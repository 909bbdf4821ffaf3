"""Ad-hoc queries: what passes, what is refused, and that the caller's session is left alone."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from merchantlens.plans import views
from merchantlens.plans.read_only import RUN_ON_FILES, RefusedQuery

PASS = [
    # Functions Spark builds from calls of its own methods are built-in all the same.
    ("SELECT url_encode('a b') || base64(encode('x', 'utf-8')) || luhn_check('79927398713')", ["a+beA==true"]),
    ("SELECT to_json(named_struct('a', 1)) || from_json('{\"a\": 2}', 'a int').a", ['{"a":1}2']),
    ("SELECT get_json_object(s, '$.a') FROM VALUES ('{\"a\": 5}') AS t(s)", ["5"]),
    ("SELECT variant_get(parse_json('{\"a\": [1, 2]}'), '$.a[1]', 'int')", [2]),
    ("SELECT aggregate(transform(sequence(1, 4), x -> x * n), 0, (a, x) -> a + x) FROM numbers WHERE n = 2", [20]),
    ("SELECT n FROM numbers WHERE n IN (SELECT max(n) FROM numbers) OR EXISTS (SELECT 1 FROM numbers m WHERE m.n = numbers.n + 4)", [0, 4]),
    ("SELECT n FROM numbers WHERE n > (SELECT avg(n) FROM numbers) AND n NOT IN (SELECT 3)", [4]),
    ("SELECT t.v FROM numbers, LATERAL (SELECT n * 10 AS v) t ORDER BY 1 DESC LIMIT 2", [40, 30]),
    ("SELECT rank() OVER (PARTITION BY n % 2 ORDER BY n DESC) FROM numbers WHERE n = 4", [1]),
    ("SELECT sum(n) FROM numbers GROUP BY ROLLUP (n % 2) ORDER BY 1", [4, 6, 10]),
    ("SELECT v FROM (SELECT 1 AS a, 2 AS b) UNPIVOT (v FOR k IN (a, b))", [1, 2]),
    ("SELECT `0` FROM (SELECT n % 2 AS p, n FROM numbers) PIVOT (sum(n) FOR p IN (0, 1))", [6]),
    ("SELECT n FROM numbers TABLESAMPLE (100 PERCENT) EXCEPT SELECT 1 INTERSECT SELECT 1", [0, 2, 3, 4]),
    ("SELECT col FROM explode(array(7, 8)) WHERE col > 7", [8]),
    ("SELECT /*+ BROADCAST(b) */ count(*) FROM numbers a JOIN numbers b USING (n)", [5]),
    ("WITH RECURSIVE r(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM r WHERE k < 3) SELECT max(k) FROM r", [3]),
    ("SELECT 'reflect(x) TRANSFORM USING \"class\":\"a.Invoke\"'", ["reflect(x) TRANSFORM USING \"class\":\"a.Invoke\""]),
    ("SELECT regexp_replace(CAST(DATE'2020-01-02' AS STRING), '-', '/')", ["2020/01/02"]),
    ("FROM numbers |> WHERE n = 1 |> SELECT n + 1 AS m", [2]),
    ("VALUES (1), (2)", [1, 2]),
]

REFUSED = [
    "SELECT TRANSFORM(id) USING 'cat' AS (a string) FROM range(2)",
    "SELECT TRANSFORM(n) USING 'id' FROM numbers",
    "FROM numbers MAP n USING 'cat' AS (m)",
    "FROM numbers REDUCE n USING 'cat' AS m",
    "SELECT * FROM numbers WHERE n IN (SELECT CAST(a AS INT) FROM (SELECT TRANSFORM(n) USING 'cat' AS (a) FROM numbers))",
    "WITH t AS (SELECT TRANSFORM(n) USING 'cat' AS (a) FROM numbers) SELECT * FROM t",
    "SELECT reflect('java.lang.Math', 'abs', -5)",
    "SELECT try_reflect('java.lang.Math', 'abs', -5)",
    "SELECT java_method('java.lang.Runtime', 'getRuntime')",
    "SELECT n FROM numbers ORDER BY reflect('java.lang.System', 'nanoTime')",
    "SELECT n FROM numbers GROUP BY n HAVING max(reflect('java.lang.System', 'nanoTime')) > 'x'",
    "SELECT transform(array(1), x -> reflect('java.lang.Math', 'abs', x)) FROM numbers",
    "SELECT url_encode(reflect('java.lang.Math', 'abs', -5))",
    "SELECT n FROM numbers WHERE EXISTS (SELECT 1 FROM numbers m WHERE m.n = numbers.n AND reflect('java.lang.Math', 'abs', m.n) > '1')",
    "SELECT (SELECT max((SELECT java_method('java.lang.Math', 'abs', -1))) FROM numbers)",
    "SELECT t.v FROM numbers, LATERAL (SELECT reflect('java.lang.Math', 'abs', n) AS v) t",
    "SELECT sum(n) OVER (ORDER BY reflect('java.lang.Math', 'abs', n)) FROM numbers",
    "SELECT owner_function(n) FROM numbers",
    "SELECT * FROM csv.`/etc/hostname`",
    "SELECT (SELECT count(*) FROM text.`/etc/hostname`)",
    "SELECT 1) ; DROP VIEW numbers; SELECT (1",
]


@pytest.fixture(autouse=True)
def numbers(spark):
    spark.range(5).select(F.col("id").cast("int").alias("n")).createOrReplaceTempView("numbers")
    spark.udf.register("owner_function", lambda n: n, "int")


@pytest.mark.parametrize(("query", "expected"), PASS, ids=range(len(PASS)))
def test_queries_that_only_read_pass(spark, query, expected):
    rows = [r[0] for r in views.read_only_sql(spark, query).collect()]
    ordered = "ORDER BY" in query
    assert (rows if ordered else sorted(rows)) == expected


@pytest.mark.parametrize("query", REFUSED, ids=range(len(REFUSED)))
def test_queries_that_do_more_are_refused(spark, query):
    with pytest.raises(Exception):
        views.read_only_sql(spark, query)
    assert views.read_only_sql_text(spark, query).startswith("SQL error: ")


@pytest.mark.parametrize(
    ("query", "named"),
    [(REFUSED[0], "ScriptTransformation"), (REFUSED[4], "ScriptTransformation"), (REFUSED[6], "CallMethodViaReflection"),
     (REFUSED[13], "CallMethodViaReflection"), (REFUSED[17], "UDF")],
)
def test_refusals_name_the_part(spark, query, named):
    with pytest.raises(RefusedQuery, match=named):
        views.read_only_sql(spark, query)


def test_files_behind_no_view_are_refused(spark, tmp_path, layers):
    path = str(tmp_path / "numbers")
    spark.table("numbers").write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("from_files")
    assert views.read_only_sql(spark, "SELECT sum(n) FROM from_files").first()[0] == 10
    spark.table("numbers").write.saveAsTable(layers.table("gold", "stored"))
    assert views.read_only_sql(spark, f"SELECT sum(n) FROM {layers.table('gold', 'stored')}").first()[0] == 10
    with pytest.raises(Exception):
        views.read_only_sql(spark, f"SELECT * FROM parquet.`{path}`")


def test_char_columns_can_be_read(spark, layers):
    table = layers.table("gold", "codes")
    spark.sql(f"CREATE TABLE {table} (code CHAR(3)) USING parquet")
    spark.sql(f"INSERT INTO {table} VALUES ('a')")
    assert views.read_only_sql(spark, f"SELECT code || '.' FROM {table}").first()[0] == "a  ."


def test_the_callers_session_is_left_alone(spark, set_conf):
    set_conf(**{"spark__sql__shuffle__partitions": "3"})
    before = spark.conf.get(RUN_ON_FILES)
    result = views.read_only_sql(spark, "SELECT current_database(), n FROM numbers")
    assert result.sparkSession is not spark
    assert result.sparkSession.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get(RUN_ON_FILES) == before == "true"
    result.sparkSession.sql("CREATE TEMPORARY VIEW only_there AS SELECT 1")
    assert not spark.catalog.tableExists("only_there")
    source = re.sub(r"(?s)\"\"\".*?\"\"\"", "", open(views.__file__).read())
    assert "conf.set" not in source
