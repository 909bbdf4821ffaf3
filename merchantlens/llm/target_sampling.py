"""Importance resampling towards a target distribution.

1. Features are the runs of one and two words, hashed to buckets. Occurrences per bucket are summed over all
   documents and over the target texts, each task first; a bucket's gain follows from the two sums.
2. The gains are one array of as many whole numbers as there are buckets, whatever the corpus. Each document's
   weight is the mean over its features, each looked up in that array by its bucket. With Gumbel noise from a hash of the id, the
   highest scores are a draw without replacement in proportion to exp(weight / 1000).
3. The cutoff key is found by weighted medians of medians. The open keys lie in blocks of bounded size;
   each block tells the median of its keys, and the pivot is the median of these, each weighted by its
   block's size. At least a quarter of the open keys is on either side of it (an eighth where blocks are
   first drawn together in groups), so a counted pass discards that much for certain. What is left once it
   fits one block is sorted, and the key of the wanted rank is the cutoff.
4. Keys from the cutoff on win. Only winners are sorted, by range, and numbered with the sizes of the ranges
   before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantlens.llm.common import let, stored

# Words are what stands between: digits, ASCII letters (lower-cased before) and everything beyond ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A null id stands behind every other among equal scores; no row can have this one beside it.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Resampling:
    """How documents are drawn. ``block`` keys are sorted at once; ``groups`` medians reach the driver."""

    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7
    block: int = 1 << 14
    groups: int = 1024


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS), "")


def buckets_of(words: Column, buckets: int) -> Column:
    """Buckets of the single words and of the neighbouring pairs, as one array."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def features(w: Column) -> Column:
        first = F.when(F.size(w) > 1, F.slice(w, 1, F.size(w) - 1)).otherwise(F.slice(w, 1, 0))
        pairs = F.zip_with(first, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: bucket(F.concat_ws(" ", a, b)))
        return F.concat(F.transform(w, bucket), pairs)

    return let(words, features)


def bucket_counts(texts: DataFrame, text: str, how: Resampling) -> DataFrame:
    """(bucket, n): occurrences per bucket over all texts, at most one row per bucket and task shuffled."""
    found = texts.select(F.explode(buckets_of(words_of(F.col(text)), how.buckets)).alias("bucket"))
    return found.groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str, how: Resampling) -> list[int]:
    """The gain of each bucket: ``buckets`` numbers, also from empty tables, where all counts are 0."""
    sums = np.zeros((2, how.buckets))
    for k, texts in enumerate((docs, target)):
        for row in bucket_counts(texts, text, how).collect():
            sums[k, row["bucket"]] = row["n"]
    (s, t), (all_s, all_t) = sums, sums.sum(axis=1)
    ratio = ((t + 1) * (all_s + how.buckets)) / ((s + 1) * (all_t + how.buckets))
    return np.floor(1000 * np.log(ratio)).astype(int).tolist()


def score_documents(docs: DataFrame, gains: list[int], how: Resampling, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per row of ``docs``.

    A null or wordless text has no features and weight 0. The noise of a null id is that of an empty one.
    """
    array = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<int>")
    words = words_of(F.col(text))
    summed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        let(
            words,
            lambda w: F.struct(
                F.size(w).alias("n_words"),
                F.aggregate(buckets_of(w, how.buckets), F.lit(0).cast("long"), lambda a, b: a + F.get(array, b)).alias("gain"),
            ),
        ).alias("of"),
    ).select("doc_id", "of.*")
    n_features = F.greatest(2 * F.col("n_words").cast("long") - 1, F.lit(0).cast("long"))
    h = F.conv(
        F.substring(F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8),
        16, 10,
    ).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(0)
    return (
        summed.withColumn("n_features", n_features)
        .withColumn("weight", weight.cast("long"))
        .select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"))
    )


def draw(docs: DataFrame, target: DataFrame, how: Resampling | None = None, text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``docs``; ``rank`` is null for rows not drawn.

    Of the documents with ``least_words`` words, ``percent`` in a hundred are drawn, rounded down: highest
    scores first, then smaller ids, null ids last; rows alike in both are taken in the order they are
    stored in, so each is drawn at most once and the number drawn is exact. Columns of ``docs`` beside id and
    text play no part. Empty tables give no row.
    """
    how = how or Resampling()
    scored = score_documents(docs, bucket_gains(docs, target, text, how), how, text)
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    eligible = F.col("n_words") >= how.least_words
    keys = scored.where(eligible).select(
        (-F.col("score")).alias("k1"), F.coalesce("doc_id", F.lit(NO_ID)).alias("k2"), F.col("row").alias("k3")
    )
    n_drawn = keys.count() * how.percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not n_drawn:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    last = select_key(keys, n_drawn, how)
    key = F.struct((-F.col("score")).alias("k1"), F.coalesce("doc_id", F.lit(NO_ID)).alias("k2"), F.col("row").alias("k3"))
    wins = eligible & (key <= _literal(last))
    others = scored.where(~wins).select(*out, F.lit(None).cast("long").alias("rank"))
    return others.unionByName(numbered(scored.where(wins), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]).select(*out, "rank"))


def _literal(key: tuple[int, int, int]) -> Column:
    return F.struct(*[F.lit(int(part)).cast("long").alias(f"k{i}") for i, part in enumerate(key, 1)])


def select_key(keys: DataFrame, rank: int, how: Resampling) -> tuple[int, int, int]:
    """The key (k1, k2, k3) of the given rank, from 1, in ascending order; keys are unique.

    Each round reads the open keys once. It counts those on either side of the pivot and finds the
    medians of both sides, of which the side that holds the rank gives the next pivot. Keys are
    written anew once a quarter of the written ones is left, so all rounds together read a few
    times what the first one reads.
    """
    written = n_open = None
    low = high = pivot = None  # keys above low and up to high are open
    while True:
        sides = _side_medians(keys, low, high, pivot, how)
        if pivot is not None:
            n_below = sum(n for _, n in sides[0])
            if rank <= n_below:
                side, high = sides[0], pivot
            else:
                side, low, rank = sides[1], pivot, rank - n_below
        else:
            side = sides[1]
        n_open = sum(n for _, n in side)
        if n_open <= how.block:
            rest = _open(keys, low, high).orderBy("k1", "k2", "k3").limit(rank)
            return tuple(rest.orderBy(F.desc("k1"), F.desc("k2"), F.desc("k3")).first())
        written = n_open if written is None else written
        if 4 * n_open <= written:
            keys, written = stored(_open(keys, low, high), "open-keys"), n_open
        pivot = _weighted_median(side)


def _open(keys: DataFrame, low, high) -> DataFrame:
    key = F.struct("k1", "k2", "k3")
    if low is not None:
        keys = keys.where((F.col("k1") >= low[0]) & (key > _literal(low)))
    if high is not None:
        keys = keys.where((F.col("k1") <= high[0]) & (key <= _literal(high)))
    return keys


def _weighted_median(medians: list[tuple[tuple[int, int, int], int]]) -> tuple[int, int, int]:
    """The first key at which half of the weight is reached."""
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def _side_medians(keys: DataFrame, low, high, pivot, how: Resampling) -> list[list[tuple[tuple[int, int, int], int]]]:
    """For the keys up to the pivot and beyond it: weighted medians of groups of blocks, with their sizes."""
    block = how.block

    def medians(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(waiting: list[np.ndarray]) -> pd.DataFrame:
            rows = []
            held = np.concatenate(waiting)
            below = np.zeros(len(held), bool)
            if pivot is not None:
                a, b, c = held.T
                p, q, r = pivot
                below = (a < p) | ((a == p) & ((b < q) | ((b == q) & (c <= r))))
            for side, own in ((0, held[below]), (1, held[~below])):
                if len(own):
                    middle = np.lexsort(own.T[::-1])[(len(own) - 1) // 2]
                    rows.append((side, *own[middle].tolist(), len(own)))
            return pd.DataFrame(rows, columns=["side", "k1", "k2", "k3", "n"])

        waiting: list[np.ndarray] = []
        for batch in batches:
            values = batch.to_numpy(np.int64)
            for start in range(0, len(values), block):
                waiting.append(values[start : start + block])
                if sum(map(len, waiting)) >= block:
                    yield told(waiting)
                    waiting = []
        if waiting:
            yield told(waiting)

    schema = "side int, k1 bigint, k2 bigint, k3 bigint, n bigint"
    blocks = _open(keys, low, high).mapInPandas(medians, schema)
    # Groups of blocks are drawn together by the same rule, so that a bounded number reaches the driver.
    grouped = blocks.withColumn("part", F.pmod(F.xxhash64("k1", "k2", "k3"), F.lit(how.groups)))
    by_key = Window.partitionBy("side", "part").orderBy("k1", "k2", "k3")
    whole = Window.partitionBy("side", "part")
    reached = grouped.withColumns({"seen": F.sum("n").over(by_key), "all": F.sum("n").over(whole)})
    first = reached.where((2 * F.col("seen") >= F.col("all")) & (2 * (F.col("seen") - F.col("n")) < F.col("all")))
    sides: list[list[tuple[tuple[int, int, int], int]]] = [[], []]
    for row in first.select("side", "k1", "k2", "k3", "all").collect():
        sides[row["side"]].append(((row["k1"], row["k2"], row["k3"]), row["all"]))
    return sides


def numbered(winners: DataFrame, order: list[Column]) -> DataFrame:
    """``winners`` with ``rank``, 1, 2, 3, ... in the given order, sorted by range and never in one task."""
    spark = winners.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        winners.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = stored(placed, "winners")
    # The place is a task's number in its upper bits and the row's number within it in the lower 33.
    part, within = F.shiftright("_place", 33).cast("int"), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = {row["part"]: row["n"] for row in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, seen = [0] * (max(sizes, default=-1) + 1), 0
    for k in sorted(sizes):
        starts[k], seen = seen, seen + sizes[k]
    offsets = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    return placed.withColumn("rank", F.get(offsets, part) + within + 1).drop("_place")
