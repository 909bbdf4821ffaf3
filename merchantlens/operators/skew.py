"""Equi-joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is hot from 1/2000 of all rows on, so there are never more than 2000 of them.
HOT_SHARE = 1 / 2000
# Counters of the heavy-hitter sketch. Its error is about 3.5 / counters of all rows, well below the
# hot share, at about half a megabyte per sketch.
SKETCH_COUNTERS = 16_384
# Rows of one hot key, on either side, that meet in one cell of a split join.
CELL_ROWS = 8192
# Sketches are merged in two steps, so that no task receives one from every scan task.
SKETCH_GROUPS = 512


@dataclass(frozen=True)
class LookupSide:
    """The right side of a join: at most one row per key, joined ``inner`` or ``left``.

    The rows of hot keys are broadcast; a hot key with a second row fails the query when it runs.
    """

    frame: DataFrame
    how: str = "inner"


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys that hold at least ``HOT_SHARE`` of the rows.

    One pass over the key column alone: sketches are merged, nothing is shuffled by key and at most
    2000 values reach the driver. The sketch only decides which way a key is joined; a key it misses
    is still joined, so results do not depend on its accuracy.
    """
    column = F.col(key)
    sketches = (
        df.where(column.isNotNull())
        .groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("sketch_group"))
        .agg(
            F.expr(f"approx_top_k_accumulate(`{key}`, {SKETCH_COUNTERS})").alias("sketch"),
            F.count(column).alias("n_rows"),
        )
    )
    # Grouped by a constant: merging no sketches at all must give no row, not a sketch of nothing.
    merged = sketches.groupBy(F.lit(0).alias("all_groups")).agg(
        F.expr(f"approx_top_k_combine(sketch, {SKETCH_COUNTERS})").alias("sketch"),
        F.sum("n_rows").alias("n_rows"),
    )
    most = round(1 / HOT_SHARE)
    summary = merged.select(F.expr(f"approx_top_k_estimate(sketch, {most})").alias("top"), "n_rows").first()
    if summary is None:
        return []
    threshold = max(2, summary["n_rows"] * HOT_SHARE)
    return [entry["item"] for entry in summary["top"] if entry["count"] >= threshold]


def lookup_join(left: DataFrame, key: str, sides: Sequence[LookupSide], hot: Sequence = ()) -> list[DataFrame]:
    """Join ``left`` to every lookup side on ``key``; returns parts that together are the result.

    Cold keys take the ordinary shuffle join, so that part stays partitioned by the key and later
    grouping by it needs no further shuffle. Rows of hot keys are not moved at all: each side has one
    row per key, so what is broadcast for them is at most ``len(hot)`` rows per side.
    """
    if not hot:
        return [_join_all(left, key, sides)]
    # A null key equals none of the hot ones and goes the ordinary way.
    is_hot = F.coalesce(F.col(key).isin(list(hot)), F.lit(False))
    cold = _join_all(
        left.where(~is_hot), key, [LookupSide(s.frame.where(~is_hot), s.how) for s in sides]
    )
    stay = _join_all(
        left.where(is_hot), key, [LookupSide(F.broadcast(_one_row(s.frame.where(is_hot), key)), s.how) for s in sides]
    )
    return [cold, stay]


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: Sequence = ()) -> DataFrame:
    """Join on ``key``, ``inner`` or ``left``, where a hot key may have many rows on both sides.

    ``hot`` names the keys that are heavy on either side; it decides the way, never the rows. A hot key with
    at most one row on the right takes the way of ``lookup_join``. One with more is dealt over a grid: its
    left rows to as many parts as they fill cells, its right rows likewise, each left row to every right
    part and each right row to every left part. Each pair of rows meets in exactly one cell, a cell takes
    some ``CELL_ROWS`` rows of either side, and cells are keys of the shuffle of their own, so any
    number of tasks share the output of one key. Copies are fewer than the pairs by that factor.

    Rows go to parts by a hash of their values and of the input partition they are in: the same for a
    repeated attempt, and different for equal rows from different partitions.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(list(hot)), F.lit(False))
    n_right = _rows_per_key(right.where(is_hot), key)
    many = [k for k, n in n_right.items() if n > 1]
    if not many:
        return union_all(lookup_join(left, key, [LookupSide(right, how)], hot))
    in_grid = F.coalesce(F.col(key).isin(many), F.lit(False))
    single = [k for k in hot if k not in set(many)]
    parts = lookup_join(left.where(~in_grid), key, [LookupSide(right.where(~in_grid), how)], single)
    n_left = _rows_per_key(left.where(in_grid), key)
    # A grid key has rows on the right, so inner and left joins give the same there.
    cells = {k: (_cells(n_left.get(k, 0)), _cells(n_right[k])) for k in many}
    dealt_left = _dealt(left.where(in_grid), key, cells, ("__left_part", "__right_part"), 0)
    dealt_right = _dealt(right.where(in_grid), key, cells, ("__right_part", "__left_part"), 1)
    grid = dealt_left.join(dealt_right, [key, "__left_part", "__right_part"]).drop("__left_part", "__right_part")
    return union_all([*parts, grid])


def _cells(n_rows: int) -> int:
    return max(1, math.ceil(n_rows / CELL_ROWS))


def _rows_per_key(df: DataFrame, key: str) -> dict:
    """Counts of the hot keys: at most as many rows as there are hot keys on both sides together."""
    return {row[key]: row["n"] for row in df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}


def _dealt(df: DataFrame, key: str, cells: dict, parts: tuple[str, str], own: int) -> DataFrame:
    """``df`` with the part each row belongs to, once for every part of the other side."""

    def number(side: int) -> Column:
        counts = F.create_map(*[F.lit(x) for k, grid in cells.items() for x in (k, grid[side])])
        return F.element_at(counts, F.col(key))

    hashed = [name for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    placed = F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), number(own)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), number(1 - own) - 1))
    return df.withColumn(parts[0], placed).withColumn(parts[1], copies)


def is_first(*keys: str, within: str | None = None) -> Column:
    """True for one row of every combination of ``keys``, which takes a sort that spills and no hash table.

    On rows that a join left partitioned by one of ``keys`` nothing is shuffled. ``within``, one of them, makes
    that the partitioning: before a join on it, the mark shares the join's shuffle and sort.
    """
    if within is None:
        return F.row_number().over(Window.partitionBy(*keys).orderBy(keys[-1])) == 1
    others = [name for name in keys if name != within]
    by_key = Window.partitionBy(within).orderBy(*others)
    same = reduce(Column.__and__, [F.lag(name).over(by_key).eqNullSafe(F.col(name)) for name in others])
    return (F.row_number().over(by_key) == 1) | ~same


def _one_row(side: DataFrame, key: str) -> DataFrame:
    """``side`` as it is, but a key with several rows raises an error instead of growing a broadcast."""
    names = [name for name in side.columns if name != key]
    repeated = F.raise_error(F.concat(F.lit(f"several rows for one {key}: "), F.col(key).cast("string")))
    counted = side.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct(*names)).alias("row"))
    row = F.when(F.col("n") > 1, repeated).otherwise(F.col("row"))
    return counted.select(key, row.alias("row")).select(key, *[f"row.`{name}`" for name in names])


def _join_all(left: DataFrame, key: str, sides: Sequence[LookupSide]) -> DataFrame:
    for side in sides:
        left = left.join(side.frame, key, side.how)
    return left


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
