"""Benchmark decontamination by spaced seeds, in built-in functions.

A seed is a hash of the words a mask selects from eight consecutive words. Between them the masks ignore
every position, so one changed word per eight leaves a seed in common. Test seeds are joined to the seeds
of all documents, and each hit is verified along its diagonal: words are compared in place, single
substitutions are bridged, and the best stretch must be long enough.

The test set is a stated query set: it is taken in blocks of bounded size, and only a block is broadcast.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantlens.llm.common import join_by_size, stored, text_key

# Fixed positions of the masks; each ignores three of eight words.
MASKS = ((0, 1, 3, 5, 6), (0, 2, 3, 4, 7), (1, 2, 4, 5, 7))
SPAN = 8
# Words of a verified stretch: so many matches, or this share of a shorter item.
LEAST_MATCHES = 13
LEAST_SHARE = 0.8
# Test words per broadcast block: some 300,000 seeds.
BLOCK_WORDS = 100_000
# Neighbouring places of an item whose seeds are in one block.
SEED_RUN = 1024
# Shorter items are phrases that stand in any text; they are reported, but remove nothing.
LEAST_FILTER_WORDS = 3


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the runs of letters and digits, lower-cased; null counts as empty."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda word: F.xxhash64(word))


def with_seeds(rows: DataFrame, words: str) -> DataFrame:
    """One row per place and mask: ``place`` and ``seed``. Texts of fewer than eight words have none."""
    placed = rows.where(F.size(words) >= SPAN).select(
        "*", F.explode(F.sequence(F.lit(0), F.size(words) - SPAN)).alias("place")
    )
    hashes = [
        F.xxhash64(F.lit(number), *[F.get(F.col(words), F.col("place") + offset) for offset in mask])
        for number, mask in enumerate(MASKS)
    ]
    return placed.select("*", F.stack(F.lit(len(MASKS)), *hashes).alias("seed"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS, least_words: int = 1
) -> DataFrame:
    """(doc_id, item_id, n_matched, n_item_words): verified overlaps, the best of each pair.

    Items of fewer than eight words have no seed; they are found where all their words stand side by side.
    ``least_words`` leaves shorter items out. Texts without a word, null ones too, neither have nor find
    an overlap. A null id is an id like others; equal test texts are searched once and reported under each of
    their ids, equal documents are verified once and each reported; an empty table gives no row.
    """
    items = benchmark.select(
        "item_id", F.xxhash64(text_key(F.coalesce("text", F.lit("")))).alias("item"), word_hashes(F.col("text")).alias("item_words")
    ).where(F.size("item_words") >= max(1, least_words))
    items = stored(items, "test-items")
    keyed = docs.select("doc_id", _text_key(text).alias("key"), F.col(text).alias("text"))
    named = items.select("item", "item_id", F.size("item_words").alias("n_item_words"))
    found = verified_overlaps(keyed, items.dropDuplicates(["item"]).select("item", "item_words"), block_words)
    per_text = found.groupBy("key").agg(F.collect_list(F.struct("item", "n_matched")).alias("hits"))
    per_text = stored(per_text, "leaked-texts")
    told = join_by_size(keyed.select("doc_id", "key"), per_text, "key", "inner").select("doc_id", F.explode("hits").alias("hit"))
    best = told.groupBy("doc_id", F.col("hit.item").alias("item")).agg(F.max("hit.n_matched").alias("n_matched"))
    return best.join(named, "item").select("doc_id", "item_id", "n_matched", "n_item_words")


def _text_key(text: str) -> Column:
    return text_key(F.coalesce(F.col(text), F.lit("")))


def verified_overlaps(keyed: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, item, n_matched) for rows (key, text), equal texts with one key, and distinct items (item, item_words).

    Hits are reduced to diagonals, one row per text, item and shift, before any is verified, and only texts
    with a diagonal are read again: an item that is copied whole is compared once, however many seeds agree.
    """
    train = keyed.select("key", word_hashes(F.col("text")).alias("words"))
    long, short = items.where(F.size("item_words") >= SPAN), items.where(F.size("item_words") < SPAN)
    diagonals = stored(_diagonals(train, long, block_words).distinct(), "diagonals")
    hit = stored(diagonals.select("key").distinct(), "hit-texts")
    texts = join_by_size(keyed, hit, "key", "left_semi").dropDuplicates(["key"])
    met = diagonals.join(texts.select("key", word_hashes(F.col("text")).alias("words")), "key").join(items, "item")
    matched = _best_stretch(F.col("words"), F.col("item_words"), F.col("shift"))
    needed = F.least(F.lit(LEAST_MATCHES), F.ceil(F.size("item_words") * LEAST_SHARE))
    checked = met.select("key", "item", matched.alias("n_matched"), needed.alias("needed")).where("n_matched >= needed")
    best = checked.groupBy("key", "item").agg(F.max("n_matched").alias("n_matched"))
    return best.unionByName(_whole_short_items(train, short, block_words))


def _diagonals(train: DataFrame, items: DataFrame, block_words: int) -> DataFrame:
    """(key, item, shift) of every seed that a text and an item share, in blocks of the items' seeds."""
    placed = with_seeds(items.select("item", F.col("item_words").alias("w")), "w")
    seeds = stored(placed.select("seed", "item", F.col("place").alias("item_place")), "test-seeds")
    blocks = max(1, math.ceil(seeds.count() / len(MASKS) / block_words))
    found = []
    for block in range(blocks):
        # Long items are spread over the blocks in runs of seeds, so that none makes a block larger.
        run = F.xxhash64("item", F.floor(F.col("item_place") / SEED_RUN))
        part = seeds.where(F.pmod(run, F.lit(blocks)) == block)
        hits = with_seeds(train, "words").join(F.broadcast(part), "seed")
        found.append(hits.select("key", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct())
    return reduce(DataFrame.unionByName, found)


def _whole_short_items(train: DataFrame, items: DataFrame, block_words: int) -> DataFrame:
    """(key, item, n_matched) of the items without seeds, whose words all stand side by side in a text."""
    rows = stored(
        items.select("item", F.size("item_words").alias("n_words"), _window(F.col("item_words"), F.lit(0), F.size("item_words")).alias("window")),
        "short-items",
    )
    lengths = sorted(row["n_words"] for row in rows.select("n_words").distinct().collect())
    empty = train.select("key", F.lit(0).cast("long").alias("item"), F.lit(0).alias("n_matched")).limit(0)
    blocks = math.ceil(rows.count() / block_words)
    found = []
    for block in range(blocks if lengths else 0):
        windows = [F.when(F.col("place") + n <= F.size("words"), _window(F.col("words"), F.col("place"), F.lit(n))) for n in lengths]
        placed = train.where(F.size("words") > 0).select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("place"))
        each = placed.select("key", F.explode(F.array_compact(F.array(*windows))).alias("window"))
        part = rows.where(F.pmod("item", F.lit(blocks)) == block)
        met = each.join(F.broadcast(part), "window").select("key", "item", F.col("n_words").alias("n_matched"))
        found.append(met.distinct())
    return reduce(DataFrame.unionByName, found, empty)


def _window(words: Column, start: Column, n_words: Column) -> Column:
    """Hash of a run of word hashes and its length."""
    return F.xxhash64(n_words, F.slice(words, start + 1, n_words))


def _best_stretch(words: Column, item: Column, shift: Column) -> Column:
    """Most matches in a stretch of the diagonal without two mismatches side by side.

    A stretch starts and ends anywhere on the item; words before or after the document do not match.
    """

    def step(acc: Column, same: Column) -> Column:
        broken = ~same & (acc["missed"] == 1)
        run = F.when(broken, 0).otherwise(acc["run"] + F.when(same, 1).otherwise(0))
        missed = F.when(same | broken, 0).otherwise(1)
        return F.struct(run.alias("run"), missed.alias("missed"), F.greatest(acc["best"], run).alias("best"))

    same = F.transform(item, lambda w, i: F.coalesce(F.get(words, shift + i) == w, F.lit(False)))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("missed"), F.lit(0).alias("best"))
    return F.aggregate(same, start, step, lambda acc: acc["best"])


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", least_words: int = LEAST_FILTER_WORDS
) -> DataFrame:
    """The rows of ``docs`` whose text has no verified overlap; decided by the text, not by the id.

    Items of fewer than ``least_words`` words do not remove a text: such phrases stand anywhere. Null
    and empty texts stay, and so does everything where the benchmark is empty.
    """
    items = benchmark.select(
        F.xxhash64(text_key(F.coalesce("text", F.lit("")))).alias("item"), word_hashes(F.col("text")).alias("item_words")
    ).where(F.size("item_words") >= max(1, least_words))
    items = stored(items.dropDuplicates(["item"]), "test-items")
    keyed = docs.withColumn("__text", _text_key(text))
    overlaps = verified_overlaps(keyed.select(F.col("__text").alias("key"), F.col(text).alias("text")), items)
    leaked = stored(overlaps.select(F.col("key").alias("__text")).distinct(), "leaked-texts")
    return join_by_size(keyed, leaked, "__text", "left_anti").select(*docs.columns)
