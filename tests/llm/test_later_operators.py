"""Byte-pair round trips, hard negatives and resampling against brute force and the library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from merchantlens.llm import forced_bpe, hard_negatives, target_sampling
from merchantlens.llm.oracles import ORACLES
from merchantlens.llm.queries import QUERIES

RNG = random.Random(11)
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


# --- byte-pair encoding -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def bpe():
    return forced_bpe.ForcedBoundaryBpe(TOKENIZER, entries=500)


def ids_of(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def test_round_trip_of_any_character(bpe, library):
    points = [c for c in [*range(0x3000), *range(0xFE00, 0xFF00), 0x1F600, 0x1D400, 0x10D50] if not 0xD800 <= c < 0xE000]
    tokens = forced_bpe.TokenStrings(TOKENIZER)
    for c in points:
        text = f"a{chr(c)}b {chr(c)} {chr(c)}s's\n{chr(c)}, {chr(c).upper()} Word{chr(c)}. x.{chr(c)}"
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids_of(bpe.encode(text)) == expected, hex(c)
        assert tokens.decode(bpe.encode(text)) == library.decode(expected, skip_special_tokens=False), hex(c)


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "theandir", "éèaçüß", "日本語のab1'st", "!?.,-'s |<>endoftx"])
def test_long_and_odd_texts(bpe, library, alphabet):
    for n in (1, 2, 23, 24, 25, 400, 30_000):
        text = "".join(RNG.choice(alphabet) for _ in range(n))
        assert ids_of(bpe.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_forced(bpe):
    """No token has a cut pair inside, words are really cut, and both ways of merging agree."""
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    for token in bpe.vocabulary:
        symbols = bpe._symbols(token.removesuffix(bpe.end), token.endswith(bpe.end))
        assert set(zip(symbols, symbols[1:], strict=False)) <= bpe.inside
    cut = 0
    for _ in range(2000):
        word = "".join(RNG.choice(letters) for _ in range(RNG.randint(1, 30)))
        fragments = bpe.fragments_of(word)
        cut += len(fragments) > 1
        whole = bpe._merged(bpe._symbols(word, True))
        assert [t for f in fragments for t in bpe._merged(f[:])] == whole == bpe._merged_long(bpe._symbols(word, True))
    assert cut > 500


def test_documents_round_trip(spark, library):
    texts = [None, "", " \n\t", "Hello, World.", "<|startoftext|>Été<|endoftext|> <|end", "ΌΣΟΣ İstanbul", "a\x1cb\x85c d", "x" * 5000, "don't 12,5"]
    rows = [(None if k == 3 else k, t, "clash", b"x") for k, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded binary").repartition(3)
    back = forced_bpe.decode_documents(forced_bpe.encode_documents(docs, TOKENIZER, entries=3), TOKENIZER)
    found = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in back.collect())
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        expected[(doc_id, len(ids), packed, library.decode(ids, skip_special_tokens=False))] += 1
    assert found == expected
    at_once = forced_bpe.encode_documents(docs, TOKENIZER, entries=3, decoded=True).collect()
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in at_once) == expected
    nulls = spark.createDataFrame([(1, None)], "doc_id bigint, ids binary")
    assert forced_bpe.decode_documents(nulls, TOKENIZER).first()["decoded"] == ""
    assert forced_bpe.encode_documents(docs.limit(0), TOKENIZER).count() == 0


def test_round_trip_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = QUERIES["op11_bpe_round_trip"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in found} == set(texts) and len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


# --- hard negatives ---------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, row string, slot int"


def mined_by_brute_force(rows, k=5, least=80):
    """Rows are (vec_id, components, label); shorter vectors count as followed by zeros."""
    usable = [
        (i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = Counter()
    for a, (anchor, q, own) in enumerate(usable):
        if anchor is None or anchor % 100:
            continue
        scores = [(sum(x * y for x, y in zip(q, v, strict=False)), i, label) for i, v, label in usable]
        order = sorted(range(len(usable)), key=lambda n: (-scores[n][0], (1 << 63) if scores[n][1] is None else scores[n][1], n))
        for p in [n for n in order if scores[n][2] == own and n != a][:k]:
            top = scores[p][0]
            fits = [n for n in order if scores[n][2] != own and least * top <= 100 * scores[n][0] <= 100 * top][:k]
            for rank, n in enumerate(fits, 1):
                found[(anchor, scores[p][1], rank, scores[n][1], top, scores[n][0])] += 1
    return found


def float32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("how", [hard_negatives.Mining(), hard_negatives.Mining(bits=64, planes=2, block=2)])
def test_mined_negatives_equal_brute_force(spark, how):
    draw = random.Random(4)
    center = [[draw.gauss(0, 1) for _ in range(20)] for _ in range(4)]

    def near(k):
        return [x + draw.gauss(0, 0.7) for x in center[k]]

    rows = [(n * 10, near(n % 4), draw.choice([0, 1, 2, None, 3])) for n in range(300)]
    rows += [(n * 10, [0.5] * 20, n % 2) for n in range(300, 340)]  # ties
    rows += [(7000, None, 1), (7100, [1.0, None], 1), (7200, [float("nan")] * 20, 1), (7300, [float("inf")], 1), (7400, [], 1)]
    rows += [(None, near(1), 1), (7500, near(2)[:7], 2), (7600, [0.0] * 20, 0), (7700, [-x for x in near(0)], 3)]
    rows += [rows[0], rows[10], rows[20]]  # repeated rows
    rows = float32(rows)
    frame = spark.createDataFrame([(*row, "x", 1) for row in rows], VECTORS).coalesce(1)
    found = hard_negatives.mine_hard_negatives(frame, F.col("vec_id") % 100 == 0, how)
    assert Counter(map(tuple, found.collect())) == mined_by_brute_force(rows)
    spread = hard_negatives.mine_hard_negatives(frame.repartition(7, "vec_id"), F.col("vec_id") % 100 == 0, how)
    assert Counter(map(tuple, spread.collect())) == mined_by_brute_force(rows)


def test_mining_with_nothing_to_find(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine_hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1, "", 0), (5, [1.0], 2, "", 0)], VECTORS)
    assert hard_negatives.mine_hard_negatives(alone, F.col("vec_id") % 100 == 0).count() == 0
    none = spark.createDataFrame([(1, [1.0], 1, "", 0), (5, [1.0], 2, "", 0)], VECTORS)
    assert hard_negatives.mine_hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0


def test_large_components_are_scored_exactly(spark):
    big = float(2**21)
    rows = float32([(0, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big, 2.0], 2), (3, [big - 1, 0.0], 2), (4, [big * 2, 0.0], 2)])
    frame = spark.createDataFrame([(*row, "", 0) for row in rows], VECTORS)
    found = hard_negatives.mine_hard_negatives(frame, F.col("vec_id") % 100 == 0)
    assert Counter(map(tuple, found.collect())) == mined_by_brute_force(rows)


@pytest.mark.parametrize(("bits", "planes"), [(64, 1), (256, 4), (512, 6)])
def test_intervals_hold_the_product(bits, planes):
    how = hard_negatives.Mining(bits=bits, planes=planes)
    random_ = np.random.default_rng(bits)
    ints = np.floor(random_.standard_normal((400, 33)) * random_.choice([1, 40, 3000], (400, 1))).astype(np.int64)
    ints[:5] = 0
    ints[5:8] = ints[8:11]
    turn = hard_negatives.rotation(33, how)
    codes = hard_negatives.Codes(ints.astype(float), turn)
    anchors = hard_negatives.Anchors(np.arange(60), np.zeros(60, np.int64), ints[:60], turn, planes)
    lower, upper = anchors.intervals(np.arange(60), codes.code, codes.aligned, codes.share, codes.norm)
    exact = ints[:60] @ ints.T
    assert (lower <= exact).all() and (exact <= upper).all()
    if bits == 512:
        length = np.linalg.norm(ints, axis=1)
        assert np.median((upper - lower) / np.maximum(1, length[:60, None] * length)) < 0.7


def test_mining_query(spark):
    read = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    rows = [(r[0], list(r[1]), (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2]) for r in read]
    found = QUERIES["op12_hard_negatives"](spark, FOLDER).collect()
    assert Counter(map(tuple, found)) == mined_by_brute_force(rows) and found


# --- resampling -------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def drawn_by_brute_force(docs, target, percent=25, least=20):
    def features(text):
        words = WORDS.findall((text or "").translate(LOWER))
        both = [*words, *[f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]
        return len(words), [zlib.crc32(f.encode()) % 10_000 for f in both]

    found = [(doc_id, *features(text)) for doc_id, text in docs]
    s, t = Counter(b for *_, bs in found for b in bs), Counter(b for text in target for b in features(text)[1])
    all_s, all_t = s.total() + 10_000, t.total() + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10_000)]
    scored = []
    for doc_id, n_words, buckets in found:
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, n_words, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((n for n, r in enumerate(scored) if r[1] >= least), key=lambda n: (-scored[n][4], scored[n][0] is None, scored[n][0] or 0))
    rank = {n: k for k, n in enumerate(order[: percent * len(order) // 100], 1)}
    return Counter((r[0], r[2], r[3], r[4], rank.get(n)) for n, r in enumerate(scored))


def some_texts(n):
    words = ["the", "THE", "été", "x1", "don't", "日本", "a-b", "Ünder", "…", "42"]
    return [" ".join(RNG.choice(words) for _ in range(RNG.choice([0, 5, 19, 20, 21, 60]))) for _ in range(n)]


@pytest.mark.parametrize("how", [target_sampling.Resampling(), target_sampling.Resampling(block=4, groups=3), target_sampling.Resampling(block=40, groups=1)])
def test_draws_equal_brute_force(spark, how):
    texts = [None, "", "...", *some_texts(400), "one two " * 5000]
    rows = [(None if n == 9 else n, text) for n, text in enumerate(texts)]
    rows += [rows[20]] * 30 + [rows[9]] * 3  # one document many times, a null id too
    target = [None, "", *some_texts(9)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, text string, row int, score string, rank int")
    aims = spark.createDataFrame([(n, text) for n, text in enumerate(target)], "item_id int, text string")
    found = target_sampling.draw(frame.repartition(5), aims, how)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, found.collect())) == drawn_by_brute_force(rows, target)


def test_draws_from_little_or_nothing(spark):
    docs = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id bigint, text string")
    none = docs.limit(0)
    assert target_sampling.draw(none, none).count() == 0
    assert {r["rank"] for r in target_sampling.draw(docs, none).collect()} == {None}
    whole = target_sampling.draw(docs, none, target_sampling.Resampling(percent=100))
    assert {r["doc_id"]: r["rank"] for r in whole.collect()} == {1: 1, 2: None}


def test_the_cutoff_key_of_any_rank(spark):
    values = [(RNG.randint(-3, 3), RNG.randint(0, 9), n) for n in range(500)]
    keys = spark.createDataFrame(values, "k1 bigint, k2 bigint, k3 bigint").repartition(6)
    ordered = sorted(values)
    for rank in (1, 2, 250, 499, 500):
        assert target_sampling.select_key(keys, rank, target_sampling.Resampling(block=8, groups=5)) == ordered[rank - 1]


def test_resampling_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = QUERIES["op13_target_resampling"](spark, FOLDER)
    assert Counter(map(tuple, found.collect())) == drawn_by_brute_force(docs, target)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_target_resampling"])
def test_queries_equal_their_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = connection.execute(ORACLES[name])
    expected = [c[0] for c in cursor.description]
    assert sorted(expected) == sorted(QUERIES[name](spark, FOLDER).columns)
    assert Counter(cursor.fetchall()) == Counter(map(tuple, QUERIES[name](spark, FOLDER).select(*expected).collect()))
