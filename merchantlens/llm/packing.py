"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, pieces and attention cost (the sum of squared piece lengths, which
is what block-diagonal attention pays). A piece goes to the open sequence that all three admit and that
the chosen measure ranks first; if none admits it, it opens one. Pieces are dealt at random to groups of
a bounded number of tokens and rows, longest first within a group, so only the last sequences of a group
stay partly empty.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Literal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantlens.llm.chunk_tokens import ChunkIds
from merchantlens.llm.common import stored

END_ID = 1
PIECES_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED_SCHEMA = f"{PIECES_SCHEMA}, sequence_id bigint, offset bigint"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. ``weights`` are those of the three in the measure that picks it."""

    tokens: int = 4096
    pieces: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.05)
    measure: Literal["residual_norm", "dot_product"] = "residual_norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.pieces, self.attention], np.int64)


@dataclass(frozen=True)
class GroupSize:
    """Bounds of one packing group, so of one task's memory."""

    tokens: int = 8_000_000
    rows: int = 100_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: Capacity, text: str = "text") -> DataFrame:
    """Pieces of each document's ids with the end id; a null text is an empty one: one piece, one id."""
    longest = min(capacity.tokens, math.isqrt(capacity.attention))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = ChunkIds(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                packed = ids_of.of_text(text or "") + end
                for piece, start in enumerate(range(0, len(packed) // 4, longest)):
                    part = packed[4 * start : 4 * (start + longest)]
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
            found = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield found.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInPandas(cut, PIECES_SCHEMA)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: Capacity | None = None, group: GroupSize | None = None, text: str = "text"
) -> DataFrame:
    """Every piece of every row of ``docs`` with its sequence and its place there.

    Repeated rows are documents of their own. An empty table gives no piece.
    """
    capacity, group = capacity or Capacity(), group or GroupSize()
    pieces = stored(
        token_pieces(docs, tokenizer, capacity, text).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    size = pieces.agg(F.count("*").alias("rows"), F.sum("length").alias("tokens")).first()
    groups = max(1, math.ceil((size["tokens"] or 0) / group.tokens), math.ceil(size["rows"] / group.rows))
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        local, offsets = best_fit(frame["length"].to_numpy(np.int64), capacity)
        frame["sequence_id"] = (np.int64(frame["pack"].iat[0]) << 32) + local
        frame["offset"] = offsets
        return frame[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype(
            {"doc_id": "Int64"}
        )

    return dealt.groupBy("pack").applyInPandas(pack, PACKED_SCHEMA)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, taken in the order given."""
    full = capacity.vector()
    weights = np.array(capacity.weights)[:, None]
    # The open sequences in the order they were opened: number, the three residuals, and these as shares. One
    # without a free piece is closed, so only tokens and attention can refuse.
    room = max(1, len(lengths))
    number = np.empty(room, np.int64)
    residual = np.empty((3, room), np.int64)
    share = np.empty((3, room))
    tokens, _, attention = residual
    n_open = n_bins = 0
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    for k, length in enumerate(lengths.tolist()):
        demand = np.array([length, 1, length * length])
        fits = ((tokens[:n_open] >= length) & (attention[:n_open] >= length * length)).nonzero()[0]
        if len(fits):
            rank, asked = share.take(fits, axis=1), (demand / full)[:, None]
            if capacity.measure == "residual_norm":
                rank -= asked
                rank *= rank
                rank *= weights
            else:
                rank *= asked
                rank *= -weights
            at = fits[rank.sum(axis=0).argmin()]
        else:
            if (demand > full).any():
                raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
            at, number[n_open], residual[:, n_open] = n_open, n_bins, full
            n_open, n_bins = n_open + 1, n_bins + 1
        sequence[k], offset[k] = number[at], full[0] - tokens[at]
        left = residual[:, at] - demand
        if left.all():
            residual[:, at], share[:, at] = left, left / full
        else:
            n_open -= 1
            for column in (number, *residual, *share):
                column[at:n_open] = column[at + 1 : n_open + 1]
    return sequence, offset
