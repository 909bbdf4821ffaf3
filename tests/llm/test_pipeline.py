"""The pipeline, each stage and as a whole, on awkward rows: nulls, ties, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from merchantlens.llm import license_scan

RNG = random.Random(11)
VOCABULARY = [a + b + c for a in ("ba", "ke", "lo", "mi") for b in ("ra", "su", "te") for c in ("n", "sto", "vel")]
# Names that the operators give to columns of their own, or might.
CLASHING = (
    "key text, copies int, fp bigint, label int, row string, item string, piece int, _cut string, _kept string, "
    "_measures string, _base_failed int, _failed_rules int, _words int, _lines int, _windows int, _fp int, _text string, _key string"
).replace("key text", "key string")
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"


def prose(n: int) -> str:
    words = [RNG.choice(VOCABULARY) for _ in range(n)]
    words[::9] = ["the"] * len(words[::9])
    words[4::9] = ["of"] * len(words[4::9])
    return " ".join(words)


def document(doc_id, text, lang="en"):
    extra = ["k" if name.endswith("string") else 7 for name in CLASHING.split(", ")]
    return (doc_id, text, lang, "web", None if text is None else len(text), *extra)


ITEM = prose(40)
SHARED = prose(60)
COPIED = prose(120)
PLAIN = {k: prose(80 + k) for k in range(20, 26)}
ROWS = [
    document(1, None), document(2, ""), document(3, "too short"), document(None, None),
    document(4, "### $$$ " * 60),
    document(10, COPIED), document(7, COPIED), document(7, COPIED), document(None, COPIED),
    document(30, prose(50) + " " + ITEM + " " + prose(50)),
    document(40, prose(70) + "\n" + SHARED + "\n" + prose(70)), document(41, prose(90) + "\n" + SHARED),
    document(50, prose(9000)),
    *[document(k, text, None) for k, text in PLAIN.items()],
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(1, ITEM, "x"), (2, None, None), (3, "", "y"), (4, "short item", "z")]
    spark.createDataFrame(items, "item_id bigint, text string, item_words string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def no_folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def staged(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs, stage(spark, docs, folder)


def ids(frame):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in frame.select("doc_id").collect())


def lost(more, fewer):
    return list((Counter(more.collect()) - Counter(fewer.collect())).elements())


def unchanged(docs, kept):
    """Rows that stay keep all their values, the clashing columns too."""
    assert kept.schema.names == docs.schema.names
    assert [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    assert not lost(kept, docs)


CLEAN = [20, 21, 22, 23, 24, 25]


def test_quality_stage(spark, folder):
    docs, kept = staged(spark, folder, corpus_pipeline.quality)
    unchanged(docs, kept)
    assert ids(kept) == [-1, 7, 7, 10, *CLEAN, 30, 40, 41, 50]


def test_near_dedup_stage(spark, folder):
    docs, kept = staged(spark, folder, corpus_pipeline.near_dedup)
    unchanged(docs, kept)
    # 1, 2 and the null id have no words and share fingerprint zero.
    assert ids(kept) == [1, 3, 4, 7, *CLEAN, 30, 40, 41, 50]


def test_suffix_stage(spark, folder):
    docs, kept = staged(spark, folder, corpus_pipeline.suffix_array_dedup)
    assert kept.schema.names == docs.schema.names
    rows = {r["doc_id"]: r for r in kept.collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    assert not {7, 10} & set(rows) and None in rows
    assert all(rows[k]["text"] == PLAIN[k] for k in CLEAN)
    for k in (40, 41):
        assert SHARED not in rows[k]["text"] and rows[k]["n_chars"] == len(rows[k]["text"])
        assert rows[k]["text"].split()[:70] == before[k]["text"].split()[:70]
        assert rows[k]["_cut"] == rows[k]["_key"] == "k" and rows[k]["_kept"] == "k" and rows[k]["copies"] == 7


def test_decontamination_stage(spark, folder):
    docs, kept = staged(spark, folder, corpus_pipeline.decontaminate)
    unchanged(docs, kept)
    assert [r["doc_id"] for r in lost(docs, kept)] == [30]


def test_packing_stage(spark, folder):
    docs, packed = staged(spark, folder, corpus_pipeline.pack)
    rows = packed.collect()
    pieces = sorted((r["doc_id"], r["piece"]) for r in rows if r["doc_id"] is not None)
    assert {k for k, _ in pieces} == {r["doc_id"] for r in docs.collect()} - {None}
    assert pieces.count((7, 0)) == 2 and max(p for k, p in pieces if k == 50) >= 1
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 4096


def test_the_whole_pipeline(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {7, *CLEAN, 40, 41, 50}
    assert sorted(r["doc_id"] for r in rows if r["piece"] == 0) == [7, *CLEAN, 40, 41, 50]


def test_the_pipeline_on_empty_tables(spark, no_folder):
    for _, stage in corpus_pipeline.STAGES:
        assert staged(spark, no_folder, stage)[1].isEmpty()
    assert corpus_pipeline.run(spark, no_folder).isEmpty()


def test_anchors_leave_only_gaps_without_unique_words(monkeypatch):
    """What patience alignment hands on: gaps where no word stands once on both sides."""
    handed = []
    exact = license_scan.most_equal

    def watched(text, template):
        handed.append((text, template))
        return exact(text, template)

    monkeypatch.setattr(license_scan, "most_equal", watched)
    scanner = license_scan.LicenseScanner(license_scan.TEMPLATES)
    for name, template in scanner.templates:
        dropped = [w for k, w in enumerate(template) if k % 10 != 7]
        for text in (template, dropped, [-1, *dropped, -1, -1], template[:9] + [-1, -1] + template[9:]):
            handed.clear()
            pairs = license_scan.align(text, template)
            assert len(pairs) == len(exact(text, template)), name
            for gap, left in handed:
                assert not any(gap.count(w) == 1 == left.count(w) for w in gap), name


def test_gaps_are_aligned_to_the_most_equal_words():
    def most(a, b):
        if not a or not b:
            return 0
        return max(most(a[1:], b), most(a, b[1:]), (a[0] == b[0]) + most(a[1:], b[1:]))

    for _ in range(300):
        a, b = ([RNG.randint(0, 3) for _ in range(RNG.randint(0, 7))] for _ in range(2))
        pairs = license_scan.most_equal(a, b)
        assert len(pairs) == most(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
