"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the folder of test tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the
timed runs per query (the median counts; one more run before them warms up). With ``BENCH_DUCKDB=1``
the oracle SQL is timed on DuckDB as well and reported under ``duckdb``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

from merchantlens.checks.oracles import ORACLES
from merchantlens.checks.queries import QUERIES
from merchantlens.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
HEADLINE = list(QUERIES)


def median_seconds(run: Callable[[], None], runs: int) -> float:
    run()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 4)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.showConsoleProgress": "false",
            # Call-site capture for error messages costs more than planning on queries this small.
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def on_spark(name: str) -> Callable[[], None]:
        return lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {name: median_seconds(on_spark(name), runs) for name in names}
    result = {
        "metric": "sum of median query times",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if os.environ.get("BENCH_DUCKDB") == "1":
        result["duckdb"] = duckdb_seconds(names, folder, int(cpus), runs)
    print(json.dumps(result))


def duckdb_seconds(names: list[str], folder: str, cpus: int, runs: int) -> dict[str, float]:
    import duckdb

    connection = duckdb.connect(config={"threads": cpus})
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return {
        name: median_seconds(lambda sql=ORACLES[name]: connection.execute(sql).fetchall(), runs)
        for name in names
    }


if __name__ == "__main__":
    main()
