"""Language identification: known words first, then ever shorter character n-grams.

Words and n-grams are counted over all training texts in Spark; the model keeps the most frequent ones, so
its size is bounded. A text's score is the sum over its words of the log frequencies per language. A word
the model knows counts by its own frequency; another one by its known 4-grams, or else 3-, 2- or 1-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantlens.llm.common import stored

WORDS = 50_000
GRAMS = 20_000
LONGEST_GRAM = 4
# Classes of totals per doubling when the least total of the kept terms is looked for.
TOTAL_CLASSES = 64
UNKNOWN = "und"
CACHE_ENTRIES = 200_000
# Chunks that are looked up together.
BLOCK = 20_000
SCHEMA = "doc_id bigint, lang_pred string, score double"


@dataclass(frozen=True)
class LanguageModel:
    """Terms with their row in ``logs``, the log frequencies per language; n-grams longest first."""

    languages: list[str]
    words: dict[str, int]
    grams: list[tuple[int, dict[str, int]]]
    logs: np.ndarray


def learn_languages(
    docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = WORDS, most_grams: int = GRAMS
) -> LanguageModel:
    """Count words and n-grams of all rows with a language; the most frequent words and n-grams a length are kept.

    ``most_words`` and ``most_grams`` bound the model, not the counting; of equal counts the smaller terms are
    kept. Null texts and languages teach nothing. Without any training row the model is empty.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))
    counts = labelled.select(F.col(lang).alias("lang"), F.explode(words).alias("term")).groupBy("term", "lang").count()
    counts = stored(counts, "language-words")
    languages = sorted(row["lang"] for row in counts.select("lang").distinct().collect())
    padded = F.concat(F.lit(" "), F.col("term"), F.lit(" "))
    tables = [_frequencies(counts, languages, most_words)]
    for n in range(LONGEST_GRAM, 0, -1):
        starts = F.explode(F.sequence(F.lit(1), F.length(padded) - n + 1)).alias("at")
        each = counts.where(F.length(padded) >= n).select("lang", "count", padded.alias("padded"), starts)
        each = each.select("lang", "count", F.substring("padded", F.col("at"), F.lit(n)).alias("term"))
        summed = stored(each.groupBy("term", "lang").agg(F.sum("count").alias("count")), "language-grams")
        tables.append(_frequencies(summed, languages, most_grams))
    rows: list[dict[str, int]] = []
    for terms, _ in tables:
        begin = sum(map(len, rows))
        rows.append({term: begin + k for k, term in enumerate(terms)})
    grams = list(zip(range(LONGEST_GRAM, 0, -1), rows[1:], strict=True))
    return LanguageModel(languages, rows[0], grams, np.concatenate([logs for _, logs in tables]))


def _frequencies(counts: DataFrame, languages: list[str], most: int) -> tuple[list[str], np.ndarray]:
    """The ``most`` terms with the largest counts, and their smoothed log frequencies per language.

    Numbers of terms per class of totals tell how low the kept ones reach, so only terms of these classes
    are sorted: some more than ``most``, however many terms and partitions there are.
    """
    if not languages:
        return [], np.empty((0, 0))
    per_term = counts.groupBy("term").agg(
        F.sum("count").alias("total"),
        *[F.sum(F.when(F.col("lang") == name, F.col("count")).otherwise(0)).alias(f"n{k}") for k, name in enumerate(languages)],
    )
    per_term = stored(per_term.withColumn("class", F.floor(F.log2("total") * TOTAL_CLASSES)), "language-terms")
    classes = per_term.groupBy("class").agg(F.count("*").alias("terms")).toPandas().sort_values("class", ascending=False)
    reached = classes["class"][classes["terms"].cumsum() - classes["terms"] < most]
    columns = [f"n{k}" for k in range(len(languages))]
    totals = np.array(counts.groupBy().agg(*[F.sum(F.when(F.col("lang") == x, F.col("count"))) for x in languages]).first(), float)
    top = per_term.where(F.col("class") >= int(reached.min())) if len(reached) else per_term
    top = top.orderBy(F.desc("total"), "term").limit(most).toPandas()
    logs = np.log((top[columns].to_numpy(float) + 0.5) / (totals + 0.5 * len(top)))
    return list(top["term"]), logs


class ChunkScores:
    """Scores of white-space delimited chunks, kept in a bounded table; unseen ones are scored together."""

    LETTERS = re.compile(r"[^\W\d_]+")

    def __init__(self, model: LanguageModel, entries: int = CACHE_ENTRIES):
        self.model, self.entries = model, entries
        self.rows: dict[str, int] = {}
        self.table = np.zeros((entries, len(model.languages) + 1))
        self.grams = [(n, *_sorted_keys(grams, n)) for n, grams in model.grams]

    def of_texts(self, texts: Iterable[str]) -> np.ndarray:
        """One row per text: sums per language, and the number of words."""
        texts = list(texts)
        totals = np.zeros((len(texts), self.table.shape[1]))
        chunks: list[str] = []
        owners: list[int] = []
        starts: list[int] = []
        for owner, text in enumerate(texts):
            found = text.split()
            for begin in range(0, len(found), BLOCK):
                owners.append(owner)
                starts.append(len(chunks))
                chunks += found[begin : begin + BLOCK]
                if len(chunks) >= BLOCK:
                    np.add.at(totals, owners, np.add.reduceat(self._of_chunks(chunks), starts))
                    chunks, owners, starts = [], [], []
        if chunks:
            np.add.at(totals, owners, np.add.reduceat(self._of_chunks(chunks), starts))
        return totals

    def _of_chunks(self, chunks: list[str]) -> np.ndarray:
        if len(self.rows) > self.entries - 2 * BLOCK:
            self.rows.clear()
        begin = len(self.rows)
        words: list[str] = []
        owners: list[int] = []
        starts: list[int] = []
        for chunk in dict.fromkeys(chunks):
            if chunk not in self.rows:
                row = self.rows[chunk] = len(self.rows)
                found = self.LETTERS.findall(chunk.lower())
                if not all(map(str.isalpha, found)):
                    found = [word for word in found if any(map(str.isalpha, word))]
                if found:
                    owners.append(row)
                    starts.append(len(words))
                    words += found
        self.table[begin : len(self.rows)] = 0
        if words:
            scored = np.column_stack([self._of_words(words), np.ones(len(words))])
            self.table[owners] = np.add.reduceat(scored, starts)
        return self.table[np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))]

    def _of_words(self, words: list[str]) -> np.ndarray:
        logs = self.model.logs
        known = np.array([self.model.words.get(word, -1) for word in words])
        scores = np.zeros((len(words), logs.shape[1]))
        scores[known >= 0] = logs[known[known >= 0]]
        left = np.flatnonzero(known < 0)
        for n, keys, rows in self.grams:
            if not len(left) or not len(keys):
                continue
            padded = [f" {words[i]} " for i in left]
            grams = _gram_keys("".join(padded), n)
            ends = np.cumsum(np.fromiter(map(len, padded), np.int64, len(padded)))
            owner = np.repeat(np.arange(len(left)), np.diff(ends, prepend=0))[: len(grams)]
            place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            # A string that runs into the next word belongs to neither.
            hit = np.flatnonzero((keys[place] == grams) & (np.arange(len(grams)) + n <= ends[owner]))
            if not len(hit):
                continue
            met, first, found = np.unique(owner[hit], return_index=True, return_counts=True)
            scores[left[met]] = np.add.reduceat(logs[rows[place[hit]]], first) / found[:, None]
            left = np.delete(left, met)
        return scores


def _gram_keys(text: str, n: int) -> np.ndarray:
    """A 64-bit hash of each string of ``n`` characters, equal for equal strings."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    count = max(0, len(points) - n + 1)
    keys = np.zeros(count, np.uint64)
    for k in range(n):
        keys = (keys + points[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _sorted_keys(grams: dict[str, int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams in order, and their rows."""
    keys = _gram_keys("".join(grams), n)[::n]
    order = np.argsort(keys)
    return keys[order], np.fromiter(grams.values(), np.int64, len(grams))[order]


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row; ``und`` with score 0 where a text is null or has no letter.

    The score is the posterior of the predicted language with equal priors; ties go to the first name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values, as workers may lack the class

    def identify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LanguageModel(**shared.value)
        scores = ChunkScores(model)
        for batch in batches:
            named, sure = [], []
            for total in scores.of_texts(text or "" for text in batch["text"]):
                if not model.languages or not total[-1]:
                    named.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                best = int(np.argmax(total[:-1]))
                named.append(model.languages[best])
                sure.append(float(1 / np.exp(total[:-1] - total[best]).sum()))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": named, "score": sure})

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInPandas(identify, SCHEMA)
