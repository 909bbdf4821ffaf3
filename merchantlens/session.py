"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from graphlib import TopologicalSorter
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")

# Independent table writes that are submitted at the same time.
PARALLEL_WRITES = 4

# Settings the jobs rely on. Memory, executors and shuffle.partitions belong to the cluster.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "merchantlens", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing, the folder lies in the warehouse, which is shared as well.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def run_together(spark: SparkSession, jobs: Mapping[str, Callable[[], Result]]) -> dict[str, Result]:
    """Run independent jobs from a few driver threads; results in the order given.

    One job's last tasks and another's first then share the cluster. The first failure is raised.
    """
    with ThreadPoolExecutor(PARALLEL_WRITES) as pool:
        # Wrapped once per job: each thread needs its own copy of the session's local properties.
        running = {name: pool.submit(inheritable_thread_target(spark)(job)) for name, job in jobs.items()}
        return {name: job.result() for name, job in running.items()}


def run_when_ready(
    spark: SparkSession, needs: Mapping[str, Collection[str]], job: Callable[[str], Result]
) -> dict[str, Result]:
    """Run ``job`` for every name as soon as all names it needs are done; results in the order given.

    A cycle is an error before anything runs. After a failure nothing more starts; what runs is awaited
    and the first failure raised.
    """
    order: TopologicalSorter[str] = TopologicalSorter(needs)
    order.prepare()
    done: dict[str, Result] = {}
    running: dict[Future[Result], str] = {}
    with ThreadPoolExecutor(PARALLEL_WRITES) as pool:
        while order.is_active():
            for name in order.get_ready():
                running[pool.submit(inheritable_thread_target(spark)(job), name)] = name
            finished, _ = wait(running, return_when=FIRST_COMPLETED)
            for future in finished:
                name = running.pop(future)
                done[name] = future.result()
                order.done(name)
    return {name: done[name] for name in needs}
