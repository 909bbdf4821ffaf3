"""Quality by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled documents spans the space: hashed words, word shapes and repetitions, weighted
by inverse document frequency and reduced by a truncated singular value decomposition. The sample's vectors
are broadcast; every document's cosine with all of them is computed exactly, in blocks, and the labels of
the nearest vote with their similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantlens.llm.common import stored

# The classifier is fitted on at most this many labelled documents, those with the smallest hash.
SAMPLE = 3_000
WORD_TERMS, SHAPE_TERMS = 4_096, 1_024
RANK = 48
NEIGHBOURS = 15
BLOCK = 512
CACHE_ENTRIES = 300_000
SCHEMA = "doc_id bigint, score double"


@dataclass(frozen=True)
class NeighbourModel:
    weights: np.ndarray  # of terms
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled documents x rank, of length 1 or 0
    labels: np.ndarray


class ChunkTerms(dict):
    """White-space delimited chunk to its word and shape term; emptied when full."""

    RUNS = ((re.compile(r"[^\W\d_]"), "a"), (re.compile(r"\d"), "0"), (re.compile(r"(.)\1+"), r"\1"))

    def __missing__(self, chunk: str) -> tuple[int, int]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        word = zlib.crc32(chunk.lower().strip(".,").encode("utf-8", "replace")) % WORD_TERMS
        case = "A" if len(chunk) > 1 and chunk.isupper() else "a"
        shape = chunk
        for pattern, sign in self.RUNS:
            shape = pattern.sub(sign, shape)
        terms = self[chunk] = (word, WORD_TERMS + zlib.crc32((case + shape).encode("utf-8", "replace")) % SHAPE_TERMS)
        return terms

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text and their damped shares. The last term counts words equal to the one before."""
        chunks = text.split()
        if not chunks:
            return np.empty(0, np.int64), np.empty(0)
        pairs = np.array(list(map(self.__getitem__, chunks)))
        repeated = sum(a == b for a, b in zip(chunks, chunks[1:], strict=False))
        counts = np.bincount(pairs.ravel(), minlength=WORD_TERMS + SHAPE_TERMS + 1)
        counts[-1] = repeated
        terms = np.flatnonzero(counts)
        values = np.sqrt(counts[terms] / len(chunks))
        values[terms >= WORD_TERMS] *= 2.0  # a shape says more than a word
        return terms, values


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, text: str = "text") -> DataFrame:
    """Stored (text, label) rows of at most ``most`` labelled documents, those whose id hashes lowest.

    Only ids are joined at full size; the texts of the chosen ones are picked out of the scan, so no
    text is shuffled. ``labels`` has doc_id and label, null labels are left out.
    """
    known = labels.where(F.col("label").isNotNull()).select("doc_id", "label")
    ids = docs.select("doc_id").distinct().join(known, "doc_id").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id", "label"), "doc_id", "label").limit(most)
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    return stored(rows.select("text", "label"), "labelled-sample")


def learn_neighbours(labelled: DataFrame, most: int = SAMPLE, text: str = "text", label: str = "label") -> NeighbourModel:
    """Fit on rows (text, label 0 or 1); null labels are left out, null texts are empty ones."""
    rows = labelled.where(F.col(label).isNotNull()).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("double").alias("label")
    )
    hashed = rows.withColumn("h", F.xxhash64("text", "label"))
    limit = hashed.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= limit).limit(most) if limit is not None else hashed.limit(0)
    chunks = ChunkTerms()
    n_terms = WORD_TERMS + SHAPE_TERMS + 1
    vectors, labels = [], []
    for row in sample.toLocalIterator():  # at most ``most`` texts, one at a time
        vectors.append(chunks.vector(row["text"]))
        labels.append(row["label"])
    dense = np.zeros((len(vectors), n_terms), np.float32)
    for k, (terms, values) in enumerate(vectors):
        dense[k, terms] = values
    weights = np.log((1 + len(vectors)) / (1 + (dense > 0).sum(axis=0))).astype(np.float32) + 0.1
    dense *= weights
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    axes = _leading_axes(dense, RANK)
    return NeighbourModel(weights, axes, _unit(dense @ axes), np.array(labels))


def _leading_axes(rows: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors by subspace iteration from a fixed start."""
    basis = np.random.default_rng(8).standard_normal((rows.shape[1], rank + 8)).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    if not len(rows):
        return basis[:, :rank]
    _, _, inner = np.linalg.svd(rows @ basis, full_matrices=False)
    return basis @ inner[:rank].T


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def vote(vectors: np.ndarray, model: NeighbourModel, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest; the overall share where nothing is similar."""
    if not len(model.labels):
        return np.full(len(vectors), 0.5)
    overall, k = model.labels.mean(), min(neighbours, len(model.labels))
    cosines = vectors @ model.vectors.T
    nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosines, nearest, axis=1), 0) ** 4 + 1e-9
    known = (weight * model.labels[nearest]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(np.where((np.abs(vectors).max(axis=1) > 0), known, overall), 0, 1)


def score_quality(docs: DataFrame, model: NeighbourModel, text: str = "text") -> DataFrame:
    """(doc_id, score) per row; empty and null texts get the share of label 1 in the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values, as workers may lack the class

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, chunks = NeighbourModel(**shared.value), ChunkTerms()
        for batch in batches:
            for begin in range(0, len(batch), BLOCK):
                part = batch.iloc[begin : begin + BLOCK]
                latent = np.zeros((len(part), model.axes.shape[1]))
                for k, text in enumerate(part["text"]):
                    terms, values = chunks.vector(text or "")
                    if len(terms):
                        latent[k] = (values * model.weights[terms]) @ model.axes[terms]
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"].astype("Int64"), "score": vote(_unit(latent), model)}
                )

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInPandas(score, SCHEMA)
