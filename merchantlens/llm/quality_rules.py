"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every measure is computed from the whole text in its own row, so nothing is shuffled and no group can
grow: repeated eight-word windows are found by sorting the window hashes of one text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantlens.llm.common import WORD_PATTERN, let

WINDOW = 8
SPACE_PATTERN = r"[\x20\x09-\x0D]"
SYMBOL_PATTERN = r"[#*$%&|<>]"

# Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to a in is it that for was with as on be at by this are or from an have not "
    "de la le les et des en un une du que est pour dans qui par sur au "
    "der die und das den von zu mit ist im ein eine auf nicht sich dem für als "
    "el los las y del se por con su para no una lo es como"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text while ``measure`` per hundred of ``base`` lies between ``least`` and ``most``."""

    name: str
    measure: str
    base: str
    least: float | None = None
    most: float | None = None

    def passed(self) -> str:
        value = f"100.0 * {self.measure}"
        bounds = [
            f"{value} {sign} {bound} * {self.base}"
            for sign, bound in ((">=", self.least), ("<=", self.most))
            if bound is not None
        ]
        return " AND ".join(bounds)


OUTCOMES = ("_measures", "_base_failed", "_failed_rules", "_kept")
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200.0, most=1400.0),
    Rule("symbols", "n_symbols", "n_words", most=8.0),
    Rule("exclamations", "n_exclamations", "n_words", most=15.0),
    Rule("stop_words", "n_stop_words", "n_words", least=2.0),
    Rule("line_copies", "n_dup_lines", "n_lines", most=40.0),
)
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_exclamations", "n_stop_words", "n_lines",
)


def quality_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``_measures`` of counts; a null or empty text measures 0 throughout.

    Two windows count as equal when their 64-bit hashes are. Columns of ``docs`` stay as they are, one called
    ``_measures`` gives way; names with two leading underscores are reserved.
    """
    own = [name for name in docs.columns if name != "_measures"]
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORD_PATTERN), F.lit(0))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD_PATTERN))
    # Only hashes of the words are kept: fixed width, and cheap to compare and to combine.
    hashed = docs.withColumns({"__words": F.transform(words, lambda word: F.xxhash64(word)), "__lines": lines})
    windowed = hashed.withColumn("__windows", _window_hashes(F.col("__words")))
    stop = F.filter("__words", lambda word: word.isin([F.xxhash64(F.lit(stop)) for stop in STOP_WORDS]))
    n_lines = F.size("__lines")
    counts = {
        "n_words": F.size("__words"),
        "word_chars": F.length(whole) - F.regexp_count(whole, F.lit(SPACE_PATTERN)),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOL_PATTERN)),
        "n_dup_lines": n_lines - F.size(F.array_distinct("__lines")),
        "n_repeat_words": _repeated_words(F.col("__windows")),
        "n_exclamations": F.regexp_count(whole, F.lit("!")),
        "n_stop_words": F.size(stop),
        "n_lines": n_lines,
    }
    measures = F.struct(*[counts[name].cast("long").alias(name) for name in MEASURES])
    return windowed.select(*own, measures.alias("_measures"))


def _window_hashes(words: Column) -> Column:
    """A hash for each run of eight word hashes, by joining neighbours of one, two and four words."""

    def joined(reach: int) -> Callable[[Column], Column]:
        def pairs(hashes: Column) -> Column:
            paired = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + reach)))
            return F.slice(paired, F.lit(1), F.greatest(F.size(hashes) - reach, F.lit(0)))

        return pairs

    return let(let(let(words, joined(1)), joined(2)), joined(4))


def _repeated_words(windows: Column) -> Column:
    """Words inside a window that occurs twice or more; sorting is left out where all differ."""

    def starts(ranked: Column) -> Column:
        repeated = F.filter(
            ranked,
            lambda x, i: (x["h"] == F.get(ranked, i + 1)["h"])
            | ((i > 0) & (x["h"] == F.get(ranked, F.greatest(i - 1, F.lit(0)))["h"])),
        )
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    covered = F.aggregate(
        let(ranked, starts),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered)


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``_measures``, ``_base_failed``, ``_failed_rules`` and ``_kept``.

    The table of rules becomes plain comparisons of one projection. A null text fails the base rules. Columns
    of ``docs`` that are called like one of the new ones give way; repeated rows are judged alike.
    """
    own = [name for name in docs.columns if name not in OUTCOMES]
    at = {name: F.col(f"_measures.{name}") for name in MEASURES}
    measured = quality_measures(docs, text)
    flat = measured.select(*own, "_measures", *[column.alias(name_of(n)) for n, column in at.items()])
    passed = [F.expr(_on_flat(rule.passed())) for rule in rules]
    failed = F.filter(
        F.array(*[F.when(~ok, F.lit(rule.name)) for rule, ok in zip(rules, passed, strict=True)]),
        lambda name: name.isNotNull(),
    )
    base_failed = F.expr(_on_flat(BASE_FAILED))
    return flat.select(
        *own,
        "_measures",
        base_failed.alias("_base_failed"),
        failed.alias("_failed_rules"),
        reduce(Column.__and__, passed, ~base_failed).alias("_kept"),
    )


def name_of(measure: str) -> str:
    return f"__{measure}"


def _on_flat(condition: str) -> str:
    return " ".join(name_of(part) if part in MEASURES else part for part in condition.split())
