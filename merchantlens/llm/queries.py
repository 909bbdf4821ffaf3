"""One query per operator, on the test tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantlens.llm import (
    decontamination,
    forced_bpe,
    hard_negatives,
    language_id,
    license_scan,
    packing,
    quality_neighbours,
    quality_rules,
    simhash,
    suffix_dedup,
    target_sampling,
    token_counts,
    url_filters,
)
from merchantlens.llm.common import is_held_out, is_training, read_table

TOKEN_LIMIT = 1024
LEAST_QUALITY = 0.7
# The shortest passage that the further columns of op4 leave out whatever its bytes: over 50 words.
PASSAGE_WORDS = 51
URL_RULES = [
    url_filters.UrlRule("block", "net/"),
    url_filters.UrlRule("allow", "example.net/en/"),
    url_filters.UrlRule("block", "example.com/de/"),
    url_filters.UrlRule("allow", "org/fr/"),
]


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """A page's outcome is bad if the label under its number says low quality or toxic."""
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    labels = read_table(spark, folder, "labels")
    bad = F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")
    outcomes = pages.join(labels.groupBy("doc_id").agg(bad), F.col("page_id") == F.col("doc_id")).select(
        url_filters.url_parts(F.col("url"))[0].alias("host"), "bad"
    )
    judged = url_filters.filter_urls(pages, outcomes, URL_RULES)
    return judged.select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"), F.col("_n_labelled").alias("host_labelled"), F.col("_n_bad").alias("host_bad"),
        F.col("_bad_rate").alias("host_bad_rate"), F.col("_bad_rate_lower").alias("host_bad_rate_lower"),
    )


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.learn_languages(docs.where(is_training(F.col("doc_id"))))
    named = language_id.identify_languages(docs, model)
    return named.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, read_table(spark, folder, "benchmark"))


def op4_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The contract's columns and ``kept_text`` are of strings of 400 bytes; ``text`` is without passages of over 50 words too."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    counted = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    cut = suffix_dedup.remove_repeats(docs, rest_words=PASSAGE_WORDS)
    # What is left as text; bytes of characters that were cut in two show as replacement characters.
    kept, rest = (F.make_valid_utf8(c.cast("string")) for c in (F.col("_cut.kept"), F.coalesce("_cut.rest", "_cut.kept")))
    return cut.select("doc_id", *[f"_cut.{name}" for name in counted], kept.alias("kept_text"), rest.alias("text"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs, tokenizer = read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    frequent = token_counts.frequent_lengths(docs, tokenizer)
    counted = token_counts.count_tokens(docs, tokenizer, frequent)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    labels = read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    training = quality_neighbours.labelled_sample(docs.where(is_training(F.col("doc_id"))), labels)
    scored = quality_neighbours.score_quality(docs, quality_neighbours.learn_neighbours(training))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"),
    )


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge_quality(read_table(spark, folder, "documents").select("doc_id", "text"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id",
        *[F.col(f"_measures.{name}").alias(name) for name in base],
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
    )


def op10_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, folder, "documents"))


def op11_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return forced_bpe.encode_documents(read_table(spark, folder, "documents"), tokenizer, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return target_sampling.draw(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_language_id": op2_language_id,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scans": op10_license_scans,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_target_resampling": op13_target_resampling,
}
