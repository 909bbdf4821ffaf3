"""Suffix-array dedup: byte strings of a given length that occur twice, over all documents.

1. Equal texts become one, with their number.
2. Every window of ``length`` bytes is filed under the smallest hash of the 64-byte strings inside it (its
   anchor). Equal windows have equal anchors, so a run of neighbouring windows with one anchor is a short
   text of its own, a segment, and segments of different anchors share no window.
3. Anchors that occur once are done with. Equal segments that occur twice are repeated as a whole.
4. Anchors with different segments remain. Their segments are cut into slices of 64 windows at fixed
   distances from the anchor. The bytes that all windows of a slice share, its core, must occur twice, or
   none of its windows does; and slices that are equal as a whole are repeated.
5. What remains are different slices with one core. A hash of the core deals them to buckets of bounded
   size; each bucket is a collection whose Burrows-Wheeler transform and common prefixes are built column
   by column (``column_bwt``). The core, which is in every window, is one symbol there: a window of
   ``length`` bytes is as many symbols as a slice has windows. Windows that share so many with a neighbour
   are repeated. A core with more distinct slices than a bucket may hold has its windows counted one by one
   instead, which any number of tasks can share.
6. The repeated windows go back to the texts, are joined to spans there, and cut out.

Passages of a number of words are sought in the same way, with a word's code as the symbol instead of a byte:
``step`` is the bytes of a symbol, and lengths and places are in symbols throughout.

The sequential files of the method are the bucket arrays here: a bucket is read and rewritten front to back
once per column, and its size is bounded, so it needs no file on a worker's own disk. Tables between the
steps lie in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantlens.llm.column_bwt import Collection
from merchantlens.llm.common import WORD_PATTERN, hot_keys, join_lookup, small_batches, stored, text_key

LENGTH = 400
GRAM = 64
# Windows of a text are taken in blocks of so many, which bounds the memory for a long one.
BLOCK = 1 << 19
BUCKET_BYTES = 1_500_000
# Windows of a slice, and distinct slices of one core that a bucket takes.
SLICE = 64
CORE_LIMIT = 2_000
# Rows a worker turns into windows or slices at a time: each gives up to 64 windows, or a slice per 64 windows.
ROWS_AT_ONCE = 500
# Bytes a word is coded in where passages are measured in words.
CODE = 4
# Symbols that texts of one transform may have: a core's slices stay below in any case.
ALPHABET = 60_000
WORDS = re.compile(WORD_PATTERN.encode())

SPANS = "array<struct<lo: int, hi: int>>"
SEGMENTS = f"key binary, anchor bigint, c1 bigint, c2 bigint, lo int, hi int, lead int, copies bigint, elsewhere {SPANS}"
WORD = ["anchor", "c1", "c2"]
SLICES = "anchor bigint, c1 bigint, c2 bigint, at int, until int, ahead int, core binary, content binary"


def segments_of(data: bytes, length: int, gram: int = GRAM, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: its hash, first and last window start, anchor place after the first."""
    symbols = np.frombuffer(data, _kind(step))
    found = [
        _block_segments(symbols[start : start + BLOCK + length - 1], start, length, gram // step)
        for start in range(0, len(symbols) - length + 1, BLOCK)
    ]
    if not found:
        return tuple(np.empty((4, 0), np.int64))
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _block_segments(symbols: np.ndarray, start: int, length: int, gram: int):
    if symbols.itemsize == 1:
        hashes = np.random.default_rng(400).integers(1, 1 << 63, 256, np.uint64)[symbols]
    else:
        hashes = symbols * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
    reach = 1
    while reach < gram:  # strings of twice the length from two neighbours
        hashes = hashes[:-reach] * np.uint64(0x9E3779B97F4A7C15 ^ (reach << 7)) + hashes[reach:]
        hashes ^= hashes >> np.uint64(31)
        reach *= 2
    low = np.uint64((1 << 24) - 1)
    # The leftmost of equal hashes wins: the place inside the block breaks ties.
    ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (_sliding_minimum(ranked, length - gram + 1) & low).astype(np.int64)
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    last = np.append(first[1:], len(anchors)) - 1
    return hashes[anchors[first]].view(np.int64), first + start, last + start, anchors[first] - first


def _kind(step: int) -> str:
    return "u1" if step == 1 else "<u4"


def _coded(data: bytes, step: int) -> bytes:
    """The symbols of a text: its bytes, or four bytes a word."""
    if step == 1:
        return data
    import xxhash

    return b"".join(map(xxhash.xxh32_digest, WORDS.findall(data)))


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def distinct_texts(docs: DataFrame, text: str = "text") -> str:
    """Name of a new table (key, data, copies) of the distinct texts, bucketed by key."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = (
        docs.select(_key(text).alias("key"), data.alias("data"))
        .groupBy("key")
        .agg(F.first("data").alias("data"), F.count("*").alias("copies"))
    )
    name = f"distinct_texts_{uuid.uuid4().hex}"
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts.write.format("parquet").bucketBy(buckets, "key").saveAsTable(name)
    return name


def _key(text: str) -> Column:
    return F.substring(text_key(F.coalesce(F.col(text), F.lit(""))), 1, 16)


def cut_segments(texts: DataFrame, length: int = LENGTH, step: int = 1) -> DataFrame:
    """The segments of each distinct text, those that are equal within a text as one row of several copies.

    A segment that stands twice in its text is repeated wherever it stands; ``elsewhere`` has these byte
    ranges, joined, in the row of the first one. So a periodic text, where the anchor moves on with
    every window, gives as many rows as it has different segments. Texts shorter than ``length`` give none.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            for part in _portions(batch):
                columns = []
                for key, text, copies in part.itertuples(index=False):
                    data = _coded(text, step)
                    anchors, lo, hi, lead = segments_of(data, length, step=step)
                    view = memoryview(data)
                    ranges = zip((step * lo).tolist(), (step * (hi + length)).tolist(), strict=True)
                    digests = b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in ranges)
                    content = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    first, times, elsewhere = _equal_segments(anchors, content, lo, hi + length)
                    columns.append(
                        (key, anchors[first], content[first], lo[first], hi[first], lead[first], copies * times, elsewhere)
                    )
                sizes = [len(c[1]) for c in columns]
                if not any(sizes):  # long texts of few words
                    continue
                yield pd.DataFrame(
                    {
                        "key": np.repeat(np.array([c[0] for c in columns], object), sizes),
                        "anchor": np.concatenate([c[1] for c in columns]),
                        "c1": np.concatenate([c[2][:, 0] for c in columns]),
                        "c2": np.concatenate([c[2][:, 1] for c in columns]),
                        "lo": np.concatenate([c[3] for c in columns]).astype(np.int32),
                        "hi": np.concatenate([c[4] for c in columns]).astype(np.int32),
                        "lead": np.concatenate([c[5] for c in columns]).astype(np.int32),
                        "copies": np.concatenate([c[6] for c in columns]),
                        "elsewhere": list(chain.from_iterable(c[7] for c in columns)),
                    }
                )

    # Words are a byte or more, with one between them.
    least = length if step == 1 else 2 * length - 1
    long_enough = texts.where(F.length("data") >= least).select("key", "data", "copies")
    return long_enough.mapInPandas(cut, SEGMENTS)


def _portions(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """``batch`` in parts of ``ROWS_AT_ONCE`` rows, which bound what a worker holds of the rows made from them."""
    return (batch.iloc[begin : begin + ROWS_AT_ONCE] for begin in range(0, len(batch), ROWS_AT_ONCE))


def _equal_segments(
    anchors: np.ndarray, content: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, list[list[dict[str, int]]]]:
    """The first of each kind of segment in a text, how often it stands there, and where if twice or more."""
    n = len(anchors)
    if len(np.unique(content[:, 0])) == n:
        return np.arange(n), np.ones(n, np.int64), [[] for _ in range(n)]
    order = np.lexsort((np.arange(n), anchors, content[:, 1], content[:, 0]))
    a, c = anchors[order], content[order]
    new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]).any(axis=1))
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, n))
    places: list[list[dict[str, int]]] = [[] for _ in heads]
    for kind in np.flatnonzero(times > 1):
        own = order[heads[kind] : heads[kind] + times[kind]]  # in text order
        lo, hi = starts[own], ends[own]
        breaks = np.flatnonzero(lo[1:] > hi[:-1]) + 1
        first, last = np.append(0, breaks), np.append(breaks, len(own)) - 1
        places[kind] = [{"lo": int(a), "hi": int(b)} for a, b in zip(lo[first], hi[last], strict=True)]
    return order[heads], times, places


def repeated_spans(
    texts: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, core_limit: int = CORE_LIMIT, step: int = 1
) -> DataFrame:
    """(key, spans): ranges [lo, hi) of symbols covered by repeated strings, unmerged, for texts that have any."""
    segments = stored(cut_segments(texts, length, step), "segments")
    anchors = stored(
        segments.groupBy("anchor").agg(F.sum("copies").alias("n"), F.count("*").alias("n_rows")), "anchors"
    )
    n_segments = anchors.agg(F.sum("n_rows")).first()[0] or 0
    shared = anchors.where("n > 1").select("anchor", F.lit(True).alias("shared"))
    found = join_lookup(segments, shared, "anchor", hot_keys(anchors, "anchor", "n_rows", n_segments))
    segments = stored(found.where("shared").drop("shared"), "shared-segments")

    contents = segments.groupBy(*WORD).agg(
        F.sum("copies").alias("n"), F.count("*").alias("n_rows"), F.min(F.struct("key", "lo", "hi", "lead")).alias("at")
    )
    contents = stored(contents, "segment-contents")
    rivals = contents.groupBy("anchor").agg(F.count("*").alias("rivals")).where("rivals > 1").select("anchor")
    compared = stored(contents.join(rivals, "anchor").select(*WORD, "at.*"), "compared-segments")
    pieces = stored(_with_bytes(compared, texts, length, step), "segment-bytes")
    partial = _compare(pieces, length, bucket_bytes, core_limit, step)

    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("at.hi") - F.col("at.lo")).alias("hi")))
    full = contents.where("n > 1").select(*WORD, whole.cast(SPANS).alias("runs"))
    single = contents.where("n = 1").select(*WORD)
    partly = partial.join(single, WORD, "left_semi")
    runs = stored(full.unionByName(partly), "repeated-runs")
    met = join_lookup(segments, runs, WORD, hot_keys(contents, WORD, "n_rows", n_segments))
    own = F.transform(
        F.coalesce("runs", F.array().cast(SPANS)),
        lambda run: F.struct((F.col("lo") + run["lo"]).alias("lo"), (F.col("lo") + run["hi"] + length).alias("hi")),
    )
    # One text's spans: no longer than the text.
    placed = met.select("key", F.explode(F.concat(own.cast(SPANS), "elsewhere")).alias("span"))
    return placed.groupBy("key").agg(F.collect_list("span").cast(SPANS).alias("spans"))


def repeated_passages(texts: DataFrame, n_words: int, **limits: int) -> DataFrame:
    """(key, spans): byte ranges of the passages of ``n_words`` words that occur twice, however they are spaced.

    Words are told apart by four bytes each, which workers make anew where they need them: no table holds them.
    """

    def places(data: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_word_places(d, s) for d, s in zip(data, spans, strict=True)])

    spans = repeated_spans(texts, n_words, step=CODE, **limits)
    placed = texts.join(spans, "key").select("key", F.pandas_udf(places, SPANS)("data", "spans").alias("spans"))
    return stored(placed, "repeated-passages")


def _word_places(data: bytes, spans: list[dict[str, int]]) -> list[dict[str, int]]:
    """Byte ranges of ranges of words."""
    words = [m.span() for m in WORDS.finditer(data)]
    return [{"lo": words[span["lo"]][0], "hi": words[span["hi"] - 1][1]} for span in spans]


def _with_bytes(compared: DataFrame, texts: DataFrame, length: int, step: int) -> DataFrame:
    """``compared`` with the symbols of each segment as bytes, fetched once per text."""

    @F.pandas_udf("array<binary>")
    def slices(data: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [d[step * p["lo"] : step * (p["hi"] + length)] for p in places_of]
                for d, places_of in zip((_coded(d, step) for d in data), places, strict=True)
            ]
        )

    wanted = compared.groupBy("key").agg(F.collect_list(F.struct(*WORD, "lo", "hi", "lead")).alias("places"))
    met = wanted.join(texts.select("key", "data"), "key")
    zipped = met.select(F.explode(F.arrays_zip("places", slices("data", "places").alias("segment"))).alias("z"))
    return zipped.select(*[f"z.places.{name}" for name in (*WORD, "lead")], F.col("z.segment").alias("segment"))


def _compare(pieces: DataFrame, length: int, bucket_bytes: int, core_limit: int, step: int) -> DataFrame:
    """(*WORD, runs): repeated windows of distinct segments that share their anchor."""
    if step > 1:  # every word may be a symbol of its own
        core_limit = min(core_limit, CORE_LIMIT)
    slices = stored(_slices(pieces, length, step), "slices")
    contents = slices.groupBy("core", "content").agg(
        F.count("*").alias("n"), F.min(F.struct(*WORD, "at", "until", "ahead")).alias("of")
    )
    contents = stored(contents, "slice-contents")
    rivals = contents.groupBy("core").agg(F.count("*").alias("rivals")).where("rivals > 1")
    compared = stored(contents.join(rivals, "core"), "compared-slices").select("core", "content", "rivals", "of.*")
    wanted = compared.groupBy(*WORD).agg(
        F.collect_list(F.struct("core", "content", "rivals", "at", "until", "ahead")).alias("s")
    )
    size, core = _windows(length, step), _core_symbols(length, step)
    around = step * (F.col("until") - F.col("at") + size)
    total = compared.agg(F.sum(around)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    behind = step * (F.col("s.at") + F.col("s.ahead") + core)
    cut = (
        pieces.join(wanted, WORD)
        .select("segment", F.explode("s").alias("s"))
        .select(
            "s.core", "s.content", "s.rivals",
            F.substring("segment", step * F.col("s.at") + 1, step * F.col("s.ahead")).alias("left"),
            F.substring("segment", behind + 1, step * (F.col("s.until") + length) - behind).alias("right"),
        )
        .withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets)))
    )
    cut = stored(cut, "slice-bytes")
    few, many = cut.where(F.col("rivals") <= core_limit), cut.where(F.col("rivals") > core_limit)
    found = few.groupBy("bucket").applyInPandas(_transform(size, step), f"core binary, content binary, runs {SPANS}")
    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("of.until") - F.col("of.at")).alias("hi")))
    full = contents.where("n > 1").select("core", "content", whole.cast(SPANS).alias("runs"))
    single = contents.where("n = 1").select("core", "content")
    partly = found.unionByName(_counted_windows(many, size, step)).join(single, ["core", "content"], "left_semi")
    runs = stored(full.unionByName(partly), "slice-runs")
    placed = slices.join(runs, ["core", "content"]).select(*WORD, "at", F.explode("runs").alias("run"))
    run = F.struct((F.col("at") + F.col("run.lo")).alias("lo"), (F.col("at") + F.col("run.hi")).alias("hi"))
    return placed.groupBy(*WORD).agg(F.collect_list(run).cast(SPANS).alias("runs"))


def _windows(length: int, step: int) -> int:
    """Windows of a whole slice: ``SLICE`` bytes, or fewer where windows are so short that no core would be left."""
    return min(SLICE // step, length)


def _core_symbols(length: int, step: int) -> int:
    return length - _windows(length, step) + 1


def _slices(pieces: DataFrame, length: int, step: int) -> DataFrame:
    size, n_core = _windows(length, step), _core_symbols(length, step)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for part in chain.from_iterable(map(_portions, batches)):
            rows = []
            for anchor, c1, c2, lead, segment in part[[*WORD, "lead", "segment"]].itertuples(index=False):
                last = len(segment) // step - length
                # Slice g holds the windows that start size * g to size * g + size - 1 symbols before the anchor.
                for g in range((lead - last) // size, lead // size + 1):
                    core = lead - size * g
                    at, until = max(0, core - size + 1), min(last, core)
                    rows.append(
                        (
                            anchor, c1, c2, at, until, core - at,
                            digest(segment[step * core : step * (core + n_core)], g),
                            digest(segment[step * at : step * (until + length)], core - at),
                        )
                    )
            yield pd.DataFrame(rows, columns=[name.split()[0] for name in SLICES.split(", ")])

    return pieces.mapInPandas(cut, SLICES)


def _transform(size: int, step: int):
    """Repeated windows of a bucket; each is ``size`` symbols long, of which one stands for the core."""

    def transform(frame: pd.DataFrame) -> pd.DataFrame:
        # Sorted, so that a repeated attempt builds the same collection.
        frame = frame.sort_values(["core", "content"], ignore_index=True)
        core = (frame["core"] != frame["core"].shift()).cumsum().to_numpy() - 1
        runs: list[list[dict[str, int]]] = []
        for part in _parts(core, (frame["left"].str.len() + frame["right"].str.len()).to_numpy() // step, step):
            sides = [np.frombuffer(side, _kind(step)) for name in ("left", "right") for side in frame[name].iloc[part]]
            known, numbers = np.unique(np.concatenate(sides), return_inverse=True)
            numbered = np.split(numbers, np.cumsum([len(side) for side in sides])[:-1])
            names = len(known) + core[part] - core[part][0]
            texts = [
                np.concatenate([a, [n], b]).astype(np.uint16)
                for a, n, b in zip(numbered[: len(names)], names, numbered[len(names) :], strict=True)
            ]
            runs += map(_runs, Collection(texts).build().repeated(size))
        out = frame[["core", "content"]].assign(runs=runs)
        return out[[len(r) > 0 for r in runs]]

    return transform


def _parts(core: np.ndarray, n_symbols: np.ndarray, step: int) -> list[np.ndarray]:
    """Rows in parts of at most ``ALPHABET`` different symbols; a core's slices stand together and stay together."""
    first = np.flatnonzero(np.diff(core, prepend=-1))
    # One name a core, and with words as many symbols as there are in the worst case.
    sizes = np.ones(len(first), np.int64) if step == 1 else 1 + np.add.reduceat(n_symbols, first)
    cuts, total = [], 0
    for begin, size in zip(first.tolist(), sizes.tolist(), strict=True):
        if total and total + size > ALPHABET:
            cuts.append(begin)
            total = 0
        total += size
    return np.split(np.arange(len(core)), cuts)


def _runs(starts: np.ndarray) -> list[dict[str, int]]:
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    first, last = np.append(starts[0], starts[breaks + 1]), np.append(starts[breaks], starts[-1])
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(first, last, strict=True)]


def _counted_windows(pieces: DataFrame, size: int, step: int) -> DataFrame:
    """Repeated windows of slices whose core is too frequent for one bucket."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for part in chain.from_iterable(map(_portions, batches)):
            rows = []
            for core, content, left, right in part.itertuples(index=False):
                n_left, n_right = len(left) // step, len(right) // step
                # A window has so many symbols before the core, and the rest of size - 1 behind it.
                for before in range(min(n_left, size - 1), max(0, size - 1 - n_right) - 1, -1):
                    window = core + left[step * (n_left - before) :] + right[: step * (size - 1 - before)]
                    rows.append((core, content, n_left - before, xxhash.xxh3_128_digest(window, before)))
            yield pd.DataFrame(rows, columns=["core", "content", "at", "window"])

    each = pieces.select("core", "content", "left", "right").mapInPandas(
        windows, "core binary, content binary, at int, window binary"
    )
    each = stored(each, "frequent-windows")
    twice = each.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    one = F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"))
    return (
        each.join(twice, "window", "left_semi")
        .groupBy("core", "content")
        .agg(F.collect_list(one).cast(SPANS).alias("runs"))
    )


CUT = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept: binary, kept_sha256: string, rest: binary>"


def cut_spans(data: pd.Series, spans: pd.Series, passages: pd.Series) -> pd.DataFrame:
    """What is left of each text without its spans, which may overlap; ``rest`` if passages take more than these."""
    rows = []
    for whole, ranges, others in zip(data, spans, passages, strict=True):
        ranges = [(r["lo"], r["hi"]) for r in (ranges if ranges is not None else ())]
        kept, n_spans = _without(whole, ranges)
        rest = _without(whole, ranges + [(r["lo"], r["hi"]) for r in others])[0] if others is not None else kept
        rows.append(
            (
                len(whole), len(whole) - len(kept), n_spans, kept, hashlib.sha256(kept).hexdigest(),
                rest if len(rest) < len(kept) else None,
            )
        )
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "rest"])


def _without(whole: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside all ranges, and the number of ranges after joining those that meet."""
    merged: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    edges = [0, *[edge for span in merged for edge in span], len(whole)]
    return b"".join(whole[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)), len(merged)


def valid_text(kept: Column) -> Column:
    """Bytes as text, without what is left of characters that were cut in two."""

    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda data: data.decode("utf-8", "ignore"))

    return F.pandas_udf(decode, "string")(kept)


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    length: int = LENGTH,
    n_words: int | None = None,
    rest_words: int | None = None,
    **limits: int,
) -> DataFrame:
    """``docs`` with ``_cut``: sizes, spans, kept bytes and their SHA-256, every repeated byte left out.

    With ``n_words``, passages of so many words that occur twice are left out as well, however short they are
    in bytes. With ``rest_words``, these fields stay as they are, and ``rest`` is the bytes that passages of so
    many words leave of the kept ones; it is null where they take none. All are sought in the whole texts. All
    occurrences go, the first one too. A null text is an empty one; repeated rows make each other's texts
    repeated. Columns of ``docs`` but the text stay as they are, one called ``_cut`` gives way.
    """
    spark = docs.sparkSession
    name = distinct_texts(docs, text)
    try:
        texts = spark.table(name)
        with small_batches(spark):
            spans = repeated_spans(texts, length, **limits)
            if n_words is not None:
                both = spans.unionByName(repeated_passages(texts, n_words, **limits))
                spans = both.groupBy("key").agg(F.flatten(F.collect_list("spans")).cast(SPANS).alias("spans"))
            whole = texts.join(spans, "key", "left")
            if rest_words is None:
                whole = whole.withColumn("passages", F.lit(None).cast(SPANS))
            else:
                passages = repeated_passages(texts, rest_words, **limits).withColumnRenamed("spans", "passages")
                whole = whole.join(passages, "key", "left")
            made = whole.select("key", "copies", F.pandas_udf(cut_spans, CUT)("data", "spans", "passages").alias("_cut"))
            cut = stored(made, "cut-texts")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    hot = hot_keys(cut, "key", "copies", docs.count()).withColumnRenamed("key", "__key")
    others = docs.drop("_cut").withColumn("__key", _key(text)).drop(text)
    return join_lookup(others, cut.select(F.col("key").alias("__key"), "_cut"), "__key", hot).drop("__key")
