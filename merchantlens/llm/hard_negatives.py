"""Hard negatives by rotated one-bit codes with deterministic intervals.

Every vector x of whole numbers is rotated into ``bits`` dimensions (zeros appended, one orthonormal map
for all), and the signs there are its code. The code stands for a direction u in the vector's own space; stored with
it are the alignment a = <u, x>, the length of the code's share in that space and the length of x. For an anchor
q, t = <u, q> is estimated from popcounts of the code with the bit planes of q's rotated components in a few bits, whose
rounding error is known. Then <x, q> = a t + <r, q - t u> with r = x - a u, and by Cauchy-Schwarz it lies within
|r| sqrt(|q|^2 - t^2) of a t: an interval, not an estimate. Only pairs whose interval can still matter are
scored as whole numbers, so results are exact whatever the codes are.

Anchors come in blocks of bounded size, each broadcast once for their positives and once for their negatives.
A task keeps the best few rows of each list; these meet in a ranking per list. No pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchantlens.llm.common import stored

# Stands for a null id in comparisons; behind every other id.
NO_ID = (1 << 63) - 1
# Longest vectors the rotation is built for.
MOST_COMPONENTS = 8192
# Anchors and rows that are compared at once inside a task.
ANCHOR_SLICE, ROW_SLICE = 512, 2048

CODED = "row bigint, vec_id bigint, label bigint, anchor boolean, ints binary, code binary, aligned double, share double, norm double"
BEST = "slot bigint, score bigint, oid bigint, row bigint"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


@dataclass(frozen=True)
class Mining:
    """What is mined, and how. A negative's score lies between ``lowest`` and ``highest`` hundredths of the positive's."""

    positives: int = 5
    negatives: int = 5
    lowest: int = 80
    highest: int = 100
    scale: int = 256
    bits: int = 512
    planes: int = 6
    seed: int = 12
    block: int = 16_384


def rotation(dim: int, how: Mining) -> np.ndarray:
    """Orthonormal columns: ``dim`` components to a multiple of 64, and at least ``bits``, of them."""
    bits = -(-max(how.bits, dim) // 64) * 64
    return np.linalg.qr(np.random.default_rng(how.seed).standard_normal((bits, dim)))[0]


class Codes:
    """Codes of some rows, with what their intervals need."""

    def __init__(self, ints: np.ndarray, turn: np.ndarray):
        turned = ints @ turn.T
        signs = turned > 0
        unit = np.where(signs, 1.0, -1.0) / np.sqrt(turn.shape[0])
        self.code = np.packbits(signs, axis=1, bitorder="little").view("<u8")
        self.share = np.maximum(np.linalg.norm(unit @ turn, axis=1), 1e-9)
        self.aligned = (unit * turned).sum(axis=1) / self.share
        self.norm = np.linalg.norm(ints, axis=1)


class Anchors:
    """A block of anchors: whole numbers, bit planes of the rotated components and their rounding error."""

    def __init__(self, row: np.ndarray, label: np.ndarray, ints: np.ndarray, turn: np.ndarray, planes: int):
        self.row, self.label, self.ints = row, label, ints
        self.norm = np.linalg.norm(ints.astype(float), axis=1)
        turned = ints @ turn.T
        self.low = turned.min(axis=1, initial=0.0)
        self.step = np.maximum(turned.max(axis=1, initial=0.0) - self.low, 1e-9) / (2**planes - 1)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.level_sum = levels.sum(axis=1)
        self.planes = np.stack(
            [np.packbits((levels >> j & 1).astype(bool), axis=1, bitorder="little").view("<u8") for j in range(planes)], axis=1
        )
        self.error = np.linalg.norm(turned - (self.low[:, None] + levels * self.step[:, None]), axis=1)

    def slices(self) -> Iterator[np.ndarray]:
        for start in range(0, len(self.row), ANCHOR_SLICE):
            yield np.arange(start, min(start + ANCHOR_SLICE, len(self.row)))

    def intervals(self, of: np.ndarray, code, aligned, share, norm) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of the anchors ``of`` with coded rows."""
        bits = code.shape[1] * 64
        shared = np.zeros((len(of), len(code)), np.int32)
        for j in range(self.planes.shape[1]):
            ones = np.zeros(shared.shape, np.uint16)
            for w in range(code.shape[1]):
                ones += np.bitwise_count(self.planes[of, j, w][:, None] & code[None, :, w])
            shared += ones.astype(np.int32) << j
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        low, step, q = self.low[of][:, None], self.step[of][:, None], self.norm[of][:, None]
        t = low * (2 * ones - bits) + step * (2 * shared - self.level_sum[of][:, None])
        t /= np.sqrt(bits) * share
        error = self.error[of][:, None] / share
        rest = np.sqrt(np.maximum(norm**2 - aligned**2, 0.0))
        # How far rounding can move a bound: many times the unit roundoff of the sums above.
        slack = 1e-9 * norm * q + 1e-6

        def edge(t: np.ndarray, sign: float) -> np.ndarray:
            t = np.clip(t, -q, q)
            return aligned * t + sign * rest * np.sqrt(np.maximum(q * q - t * t, 0.0))

        # The upper bound grows with t up to the code's own direction and is |x| |q| from there on.
        upper = np.where(norm * (t + error) >= aligned * q, norm * q, edge(t + error, 1.0))
        lower = np.where(norm * (t - error) <= -aligned * q, -norm * q, edge(t - error, -1.0))
        return lower - slack, upper + slack

    def score(self, of: np.ndarray, ints: np.ndarray) -> np.ndarray:
        """Exact products of the anchors ``of``, one by one, with as many rows."""
        mine = self.ints[of]
        largest = int(np.abs(mine).max(initial=0)) * int(np.abs(ints).max(initial=0)) * max(1, ints.shape[1])
        if largest < 1 << 53:
            return np.einsum("ij,ij->i", mine.astype(float), ints.astype(float)).astype(np.int64)
        sums = (mine.astype(object) * ints.astype(object)).sum(axis=1)
        if any(abs(s) >> 63 for s in sums):
            raise OverflowError("a product of two vectors exceeds 64 bits")
        return sums.astype(np.int64)


class BestRows:
    """The best ``k`` rows of each slot: higher scores first, then smaller ids, then earlier rows."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.entries = np.empty((0, 4), np.int64)  # slot, score, oid, row
        self.last = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, oid: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        found = np.concatenate([self.entries, np.column_stack([slot, score, oid, row])])
        found = found[np.lexsort((found[:, 3], found[:, 2], -found[:, 1], found[:, 0]))]
        first = np.flatnonzero(np.diff(found[:, 0], prepend=-1))
        place = np.arange(len(found)) - np.repeat(first, np.diff(np.append(first, len(found))))
        self.entries = found[place < self.k]
        full = found[place == self.k - 1]
        self.last[full[:, 0]] = full[:, 1]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.entries, columns=["slot", "score", "oid", "row"])


@dataclass(frozen=True)
class Table:
    """The coded rows, stored, and what reads them."""

    rows: DataFrame
    turn: np.ndarray
    kind: str


def coded_table(vectors: DataFrame, is_anchor: Column, how: Mining, vec_id: str, vector: str, label: str) -> Table:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * how.scale))
    usable = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        whole.alias("ints"),
    )
    usable = stored(usable.withColumn("row", F.monotonically_increasing_id()), "whole-vectors")
    largest = F.array_max(F.transform("ints", lambda x: F.abs(x)))
    size = usable.agg(F.max(F.size("ints")).alias("dim"), F.max(largest).alias("largest")).first()
    dim, top = size["dim"] or 0, size["largest"] or 0
    if dim > MOST_COMPONENTS:
        raise ValueError(f"vectors of {dim} components; the rotation is built for at most {MOST_COMPONENTS}")
    kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if top >> bits == 0)
    turn = rotation(max(1, dim), how)
    shared = vectors.sparkSession.sparkContext.broadcast(turn)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = shared.value
        for batch in batches:
            for start in range(0, len(batch), ROW_SLICE):
                part = batch.iloc[start : start + ROW_SLICE]
                ints = np.zeros((len(part), turn.shape[1]), kind)
                for k, values in enumerate(part["ints"]):
                    ints[k, : len(values)] = values
                codes = Codes(ints.astype(float), turn)
                yield pd.DataFrame(
                    {
                        "row": part["row"].to_numpy(),
                        "vec_id": part["vec_id"].astype("Int64").to_numpy(),
                        "label": part["label"].to_numpy(),
                        "anchor": part["anchor"].to_numpy(),
                        "ints": [v.tobytes() for v in ints],
                        "code": [v.tobytes() for v in codes.code],
                        "aligned": codes.aligned,
                        "share": codes.share,
                        "norm": codes.norm,
                    }
                )

    coded = usable.select("row", "vec_id", "label", "anchor", "ints").mapInPandas(encode, CODED)
    return Table(stored(coded, "coded-vectors"), turn, kind)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    how: Mining | None = None,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its best other rows of the same label; each positive's negatives the best rows
    of other labels whose score is near enough below its own. Ties go to smaller ids, null ids last, then to the row
    stored first. Rows with a null label, a null vector or a null, infinite or NaN component take no part;
    components a shorter vector lacks count as 0. Repeated rows are rows of their own. A null id is no
    anchor unless ``is_anchor`` says so, and no vectors give no rows. Other columns play no part.
    """
    how = how or Mining()
    spark = vectors.sparkSession
    table = coded_table(vectors, is_anchor, how, vec_id, vector, label)
    n_anchors = table.rows.where("anchor").count()
    n_blocks = -(-n_anchors // how.block)
    found = [_mine_block(spark, table, n, n_blocks, how) for n in range(n_blocks)]
    if not found:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, found)


def _mine_block(spark: SparkSession, table: Table, number: int, n_blocks: int, how: Mining) -> DataFrame:
    own = table.rows.where("anchor").where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == number)
    local = own.select("row", "vec_id", "label", "ints").orderBy("row").toPandas()
    ints = _whole(local["ints"], table).astype(np.int64)
    if local.empty:  # a hash may deal no anchor to a block
        return spark.createDataFrame([], RESULT)
    # Arrays only: workers need not know this package's classes to read them.
    shared = spark.sparkContext.broadcast(
        (local["row"].to_numpy(np.int64), local["label"].to_numpy(np.int64), ints, table.turn, how.planes)
    )
    positives = _ranked(_best_positives(table, shared, how), how.positives).toPandas()

    # Slot a * positives + p is the anchor's positive number p; its window of scores is empty where there is none.
    score = np.full((len(local), how.positives), -1, np.int64)
    score[positives["slot"], positives["rank"] - 1] = positives["score"]
    windows = spark.sparkContext.broadcast(score)
    negatives = _ranked(_best_negatives(table, shared, windows, how), how.negatives)
    of_slot = pd.DataFrame(
        {
            "slot": positives["slot"] * how.positives + positives["rank"] - 1,
            "anchor_id": local["vec_id"].astype("Int64").to_numpy()[positives["slot"]],
            "positive_oid": positives["oid"],
            "positive_score": positives["score"],
        }
    ).astype({"anchor_id": "Int64"})
    listed = spark.createDataFrame(of_slot, "slot bigint, anchor_id bigint, positive_oid bigint, positive_score bigint")
    mined = negatives.join(F.broadcast(listed), "slot").select(
        "anchor_id",
        _id("positive_oid").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        _id("oid").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
    return stored(mined, "hard-negatives")


def _id(oid: str) -> Column:
    return F.when(F.col(oid) != NO_ID, F.col(oid))


def _whole(packed: pd.Series, table: Table) -> np.ndarray:
    return np.frombuffer(b"".join(packed), table.kind).reshape(len(packed), table.turn.shape[1])


def _ranked(best: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each slot, out of the best of each task."""
    by_score = Window.partitionBy("slot").orderBy(F.desc("score"), "oid", "row")
    return best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


@dataclass
class Slice:
    """Some coded rows inside a task."""

    row: np.ndarray
    oid: np.ndarray
    label: np.ndarray
    ints: np.ndarray
    coded: tuple[np.ndarray, ...]

    def take(self, at: np.ndarray) -> Slice:
        return Slice(self.row[at], self.oid[at], self.label[at], self.ints[at], tuple(c[at] for c in self.coded))


def _slices(batches: Iterator[pd.DataFrame], kind: str) -> Iterator[Slice]:
    for batch in batches:
        for start in range(0, len(batch), ROW_SLICE):
            part = batch.iloc[start : start + ROW_SLICE]
            n = len(part)
            code = np.frombuffer(b"".join(part["code"]), "<u8").reshape(n, -1)
            yield Slice(
                part["row"].to_numpy(np.int64),
                part["oid"].to_numpy(np.int64),
                part["label"].to_numpy(np.int64),
                np.frombuffer(b"".join(part["ints"]), kind).reshape(n, -1),
                (code, *(part[name].to_numpy(float) for name in ("aligned", "share", "norm"))),
            )


def _compared(table: Table) -> DataFrame:
    return table.rows.select(
        "row", F.coalesce("vec_id", F.lit(NO_ID)).alias("oid"), "label", "ints", "code", "aligned", "share", "norm"
    )


def _best_positives(table: Table, shared, how: Mining) -> DataFrame:
    """The best rows of each anchor's label in each task; slots are anchors."""
    kind, k = table.kind, how.positives

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors(*shared.value)
        best = BestRows(len(anchors.row), k)
        by_label = np.argsort(anchors.label, kind="stable")
        labels, starts = np.unique(anchors.label[by_label], return_index=True)
        ends = np.append(starts[1:], len(by_label))
        for rows in _slices(batches, kind):
            for label in np.unique(rows.label):
                n = np.searchsorted(labels, label)
                if n == len(labels) or labels[n] != label:
                    continue
                some = rows.take(np.flatnonzero(rows.label == label))
                for start in range(starts[n], ends[n], ANCHOR_SLICE):
                    of = by_label[start : min(start + ANCHOR_SLICE, ends[n])]
                    lower, upper = anchors.intervals(of, *some.coded)
                    itself = anchors.row[of][:, None] == some.row
                    lower[itself], upper[itself] = -np.inf, -np.inf
                    least = best.last[of].astype(float)
                    if lower.shape[1] >= k:
                        least = np.maximum(least, np.partition(lower, -k, axis=1)[:, -k])
                    a, r = np.nonzero((upper >= least[:, None]) & ~itself)
                    best.add(of[a], anchors.score(of[a], some.ints[r]), some.oid[r], some.row[r])
        yield best.frame()

    return _compared(table).mapInPandas(search, BEST)


def _best_negatives(table: Table, shared, windows, how: Mining) -> DataFrame:
    """The best rows of other labels within each positive's window in each task; slots are positives."""
    kind = table.kind

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors(*shared.value)
        positive = windows.value
        per_anchor = positive.shape[1]
        best = BestRows(positive.size, how.negatives)
        # Whole-number borders of the windows; a negative positive score admits nothing.
        none = positive < 0
        wide = positive.astype(object)  # hundredths of a score may need more than 64 bits
        floor_, ceiling = (x.astype(np.int64) for x in (-(-how.lowest * wide // 100), how.highest * wide // 100))
        for rows in _slices(batches, kind):
            for of in anchors.slices():
                lower, upper = anchors.intervals(of, *rows.coded)
                last = best.last.reshape(-1, per_anchor)[of]
                least = np.where(none[of], np.inf, np.maximum(floor_[of], last)).min(axis=1)
                most = np.where(none[of], -np.inf, ceiling[of]).max(axis=1)
                other = anchors.label[of][:, None] != rows.label
                a, r = np.nonzero(other & (upper >= least[:, None]) & (lower <= most[:, None]))
                score = anchors.score(of[a], rows.ints[r])
                for p in range(per_anchor):
                    slot = of[a] * per_anchor + p
                    fits = ~none[of[a], p] & (score >= floor_[of[a], p]) & (score <= ceiling[of[a], p]) & (score >= best.last[slot])
                    best.add(slot[fits], score[fits], rows.oid[r[fits]], rows.row[r[fits]])
        yield best.frame()

    return _compared(table).mapInPandas(search, BEST)
