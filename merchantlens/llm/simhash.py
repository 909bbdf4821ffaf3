"""SimHash near-duplicates: byte-position inverted index, count filter, verification, components.

Two 64-bit fingerprints with at most four different bits share at least four of their eight bytes in
place. The index holds each distinct fingerprint under triples of byte positions, chosen so that any four
equal bytes contain one of the triples in full. Pairs of a posting list are tallied by shared bytes, those
with four or more are verified by their bits, and only a spanning forest of the verified links leaves a
list. A list that is too long for that is not compared at all: its fingerprints are listed under every
value within two bits instead. Two of them share such a value exactly if at most four bits differ.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantlens.llm.common import hot_keys, join_lookup, small_batches, stored, text_key
from merchantlens.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
# Posting lists up to this length are compared pair by pair inside one task.
LIST_LIMIT = 4096


def covering_triples() -> list[tuple[int, ...]]:
    """Triples of byte positions such that every set of four positions contains one of them."""
    chosen: list[tuple[int, ...]] = []
    open_sets = set(itertools.combinations(range(8), 4))
    while open_sets:
        best = max(itertools.combinations(range(8), 3), key=lambda t: sum(set(t) <= set(s) for s in open_sets))
        chosen.append(best)
        open_sets = {s for s in open_sets if not set(best) <= set(s)}
    return chosen


def fingerprint_text(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set if more than half of the shingle hashes have it; a text without words gives 0."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest, line = xxhash.xxh64_digest, b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(line)]
    sums = np.zeros(64, np.int64)
    for k in range(0, n, 32_768):
        block = zip(starts[k : k + 32_768], stops[k : k + 32_768], strict=True)
        hashes = np.frombuffer(b"".join([digest(line[i:j], 42) for i, j in block]), np.uint8)
        sums += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text") -> Column:
    """Signed 64-bit fingerprint of a text column; null and empty texts have 0."""

    @F.pandas_udf("bigint")
    def fingerprint(texts: pd.Series) -> pd.Series:
        values = [fingerprint_text(t or "") for t in texts]
        return pd.Series(np.array(values, np.uint64).view(np.int64))

    return fingerprint(docs[text])


def link_fingerprints(fps: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the distinct fingerprints ``fp``."""
    keys = [
        F.struct(F.lit(k).alias("triple"), F.col("fp").bitwiseAND(_mask(triple)).alias("value"))
        for k, triple in enumerate(covering_triples())
    ]
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.*")
    sizes = postings.groupBy("triple", "value").agg(F.count("*").alias("n")).where("n > 1")
    lists = stored(
        postings.join(sizes, ["triple", "value"]).withColumn("long", F.col("n") > list_limit), "simhash-lists"
    )
    compared = (
        lists.where("NOT long")
        .groupBy("triple", "value")
        .agg(F.collect_list("fp").alias("fps"))
        .select(F.explode(_forest()(F.col("fps"))).alias("edge"))
        .select("edge.*")
    )
    near = [0, *[1 << i for i in range(64)], *[(1 << i) | (1 << j) for i in range(64) for j in range(i)]]
    flips = F.array(*[F.lit(_signed(bits)) for bits in near])
    middles = (
        lists.where("long")
        .select("fp")
        .distinct()
        .select("fp", F.explode(flips).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    )
    # At most 2081 fingerprints lie within two bits of a value, so these lists are bounded.
    met = (
        middles.groupBy("middle")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("others"))
        .where(F.size("others") > 1)
        .select("a", F.explode("others").alias("b"))
    )
    return compared.unionByName(met).where("a <> b").distinct()


def _forest():
    @F.pandas_udf("array<struct<a: bigint, b: bigint>>")
    def forest(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in lists:
            yield pd.Series([_spanning_links(np.array(fps, np.int64)) for fps in series])

    return forest


def _spanning_links(fps: np.ndarray) -> list[dict[str, int]]:
    """Breadth-first forest of the links inside one posting list; each member is expanded once."""
    octets, bits = fps.view(np.uint8).reshape(-1, 8), fps.view(np.uint64)
    waiting = np.arange(len(fps))
    links = []
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            at = queue.pop()
            shared = (octets[waiting] == octets[at]).sum(axis=1)
            close = shared >= 8 - MAX_BITS
            close[close] = np.bitwise_count(bits[waiting[close]] ^ bits[at]) <= MAX_BITS
            found = waiting[close]
            links += [{"a": int(fps[at]), "b": int(fps[other])} for other in found]
            queue += found.tolist()
            waiting = waiting[~close]
    return links


def _mask(positions: tuple[int, ...]) -> Column:
    return F.lit(_signed(reduce(int.__or__, (0xFF << (8 * p) for p in positions))))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def simhash_components(
    docs: DataFrame, text: str = "text", list_limit: int = LIST_LIMIT, row_key: Column | None = None
) -> DataFrame:
    """``doc_id`` (long), ``fp``, ``label`` (smallest linked fp) and ``component_id`` for each row.

    ``component_id`` is the smallest non-null id of the component. Equal texts, repeated rows and
    repeated ids simply share a fingerprint. Links run through any row, null ids included.
    ``row_key`` adds a column ``row`` to tell rows apart by.
    """
    extra = [] if row_key is None else [row_key.alias("row")]
    with small_batches(docs.sparkSession):
        rows = stored(
            docs.select(F.col("doc_id").cast("long"), fingerprints(docs, text).alias("fp"), *extra), "simhash-rows"
        )
    groups = stored(
        rows.groupBy("fp").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_id")), "simhash-groups"
    )
    labels = connected_components(link_fingerprints(groups.select("fp"), list_limit))
    labelled = groups.join(labels.withColumnsRenamed({"node": "fp"}), "fp", "left").select(
        "fp", "n_rows", "first_id", F.coalesce("label", "fp").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    lookup = stored(labelled.join(least, "label").select("fp", "n_rows", "label", "component_id"), "simhash-labels")
    hot = hot_keys(lookup, "fp", "n_rows", rows.count())
    return join_lookup(rows, lookup.drop("n_rows"), "fp", hot)


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, one per component: that with the smallest id.

    Where that id is repeated in its component, or all its ids are null, the row whose values hash lowest
    stays, so a rerun keeps the same one. Rows alike in every column are one row. Each text is fingerprinted
    once and moved once, by the hash of its row: copies and components are handled as narrow rows.
    """
    row_key = text_key(F.to_json(F.struct(*docs.columns)))
    marked = simhash_components(docs, text, row_key=row_key)
    chosen = (
        marked.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("label")
        .agg(F.min("row").alias("__row"))
        .select("__row")
    )
    # Rows alike are reduced in their own task before they move, and meet the chosen ones where they land.
    distinct = docs.withColumn("__row", row_key).dropDuplicates(["__row"])
    return distinct.join(stored(chosen, "simhash-chosen"), "__row", "left_semi").select(*docs.columns)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
