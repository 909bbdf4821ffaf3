"""Connected components by alternating star contractions, as a handful of joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantlens.llm.common import stored

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, label): the smallest node of its component, for each node that has an edge (a, b).

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest
    neighbour it has. No node collects its neighbours: minima are summed before the shuffle. Rounds
    grow with the logarithm of the longest chain; each ends in a table of the shared folder.
    """
    current = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "components",
    )
    seen = _state(current)
    for _ in range(max_rounds):
        current = stored(_small_star(_large_star(current)), "components")
        now = _state(current)
        if now == seen:
            nodes = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return nodes.unionByName(roots)
        seen = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.xxhash64("u", "v") % 65_521)
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge runs from the larger node u to the smaller v.
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(hung).distinct()
