"""What the operators share: scratch tables, small column idioms and the join that splits hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantlens.session import scratch_folder

# Words are runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# A key with this share of all rows or more is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000
# Rows of narrow keys up to which a table is broadcast: some 10 MB.
BROADCAST_ROWS = 100_000
# Rows of whole texts that travel to a Python worker at a time, where the job says so.
BATCH_ROWS = 500
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared scratch folder and read it back: lineage ends there."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that start inside send texts to the workers in batches of at most ``BATCH_ROWS`` rows.

    An executor holds a batch several times over: as Arrow data on both sides, as Python objects, and what is made
    from them. Only the size of the batches changes, never what is in them; a smaller one that is set stays.
    """
    before = spark.conf.get(BATCH_SETTING)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_held_out(doc_id: Column) -> Column:
    """Rows no model may learn from; false for a null id, which ``is_training`` refuses as well."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def is_training(doc_id: Column) -> Column:
    return doc_id.isNotNull() & ~is_held_out(doc_id)


def text_key(text: Column) -> Column:
    """32 bytes that stand for a whole text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def join_by_size(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Join to a stored table, broadcast if it is counted to have few rows, by a shuffle beyond that."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, key, how)


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str | list[str], hot: DataFrame) -> DataFrame:
    """Left join to a table of one row per key, rows of hot keys staying where they are.

    ``hot`` lists keys of which there are at most ``1 / HOT_SHARE`` by construction; the lookup rows
    of these, and only these, are broadcast. All others take the shuffle join, null keys included.
    """
    keys = [key] if isinstance(key, str) else key
    marks = {name: f"__hot_{name}" for name in keys}
    mark = hot.select(*[F.col(name).alias(other) for name, other in marks.items()], F.lit(True).alias("__is_hot"))
    same = reduce(and_, [F.col(name) == F.col(other) for name, other in marks.items()])
    marked = rows.join(F.broadcast(mark), same, "left").drop(*marks.values())
    hot_lookup = lookup.join(F.broadcast(hot.select(*keys)), keys, "left_semi")
    stay = marked.where("__is_hot").drop("__is_hot").join(F.broadcast(hot_lookup), keys, "left")
    move = marked.where("__is_hot IS NULL").drop("__is_hot").join(lookup, keys, "left")
    return stay.unionByName(move)


def hot_keys(counts: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """Keys of a table of counts per key that hold at least ``HOT_SHARE`` of all rows; null keys are none."""
    keys = [key] if isinstance(key, str) else key
    known = reduce(and_, [F.col(name).isNotNull() for name in keys])
    return counts.where(known & (F.col(count) >= max(2.0, total * HOT_SHARE))).select(*keys)
