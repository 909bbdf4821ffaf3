"""From raw documents to packed training sequences: five stages, each an operator of ``merchantlens.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a frame; the
result is written as Parquet and read again for the next stage. Columns other than the documents' own pass
through, whatever they are called but for names with two leading underscores. Null texts fail the quality
rules, so the later stages meet none unless they are called alone. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantlens.llm import decontamination, packing, quality_rules, simhash, suffix_dedup
from merchantlens.llm.common import read_table, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# The shortest repeated passage that goes whatever its bytes: over 50 words.
PASSAGE_WORDS = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table; null and empty texts do not.

    Repeated rows are judged alike and all stay. Whole rows travel in one column, as any other may clash.
    """
    judged = quality_rules.judge_quality(docs.select("text", F.struct(*docs.columns).alias("__row")))
    return judged.where("_kept").select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: the one with its smallest id.

    Of rows that share this id, and of components without any, the row whose values hash lowest stays. Null
    and empty texts have fingerprint zero, so one of all these stays.
    """
    return simhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 400 and passages of over 50 words that occur twice; a text of nothing else goes.

    A character cut in two is left out, and ``n_chars`` follows the text. Equal texts of 400 bytes or more
    repeat each other, so repeated rows go; null and empty texts have nothing to lose and stay, as empty ones.
    """
    others = [name for name in docs.columns if name != "text"]
    cut = suffix_dedup.remove_repeats(docs.select("text", F.struct(*others).alias("__row")), n_words=PASSAGE_WORDS)
    text = F.when(F.col("_cut.n_removed") > 0, suffix_dedup.valid_text(F.col("_cut.kept"))).otherwise(
        F.col("_cut.kept").cast("string")
    )
    kept = cut.where("_cut.n_removed = 0 OR _cut.n_removed < _cut.n_bytes").select(text.alias("text"), "__row.*")
    sized = kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in others else kept
    return sized.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item; null and empty texts have none.

    Texts decide, so repeated rows stay or go together. Without benchmark items everything stays.
    """
    return decontamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 4096 tokens; a null text is an empty one.

    Repeated rows are packed as often as they stand. Equal lengths may fill either place.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

# Neither fingerprints nor token ids can be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
