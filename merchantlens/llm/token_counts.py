"""Token counts: a broadcast table of frequent pre-token lengths, worker caches for the others.

No pre-token is ever shuffled. The table is found by heavy-hitter sketches over all texts, one per scan
task and merged in two steps; it only decides which lengths are ready from the start, never a count.
Pre-tokens are taken with their trailing punctuation, as the runs between single spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantlens.llm.chunk_tokens import ChunkLengths

# Entries of the broadcast table; with at most LONGEST characters each it stays below 2 MB.
FREQUENT = 16_384
LONGEST = 32
SKETCH_COUNTERS = 32_768
SKETCH_GROUPS = 512
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def frequent_lengths(docs: DataFrame, tokenizer: str, text: str = "text", most: int = FREQUENT) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of all texts: at most ``most`` entries."""
    chunks = docs.select(F.explode(F.split(text, " ")).alias("chunk")).where(
        F.length("chunk").between(1, LONGEST)
    )
    sketches = chunks.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(chunk, {SKETCH_COUNTERS})").alias("sketch")
    )
    merged = sketches.groupBy(F.lit(0).alias("one")).agg(
        F.expr(f"approx_top_k_combine(sketch, {SKETCH_COUNTERS})").alias("sketch")
    )
    row = merged.select(F.expr(f"approx_top_k_estimate(sketch, {most})").alias("top")).first()
    lengths = ChunkLengths(tokenizer, {})
    spaced = [" " + entry["item"] for entry in row["top"]] if row else []
    return {chunk: lengths[chunk] for chunk in spaced if not chunk[1:].isspace()}


def count_tokens(docs: DataFrame, tokenizer: str, frequent: dict[str, int], text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row of ``docs``; a null text counts as an empty one: 0 and 0."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = ChunkLengths(tokenizer, shared.value)
        for batch in batches:
            texts = batch["text"].fillna("")
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "n_bytes": [len(t.encode("utf-8", "replace")) for t in texts],
                    "n_tokens": [lengths.of_text(t) for t in texts],
                }
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInPandas(count, SCHEMA)
