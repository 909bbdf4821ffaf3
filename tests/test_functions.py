from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from merchantlens.functions import (
    action_items,
    action_items_or_reply,
    json_string_items,
    printf_round,
    ratio,
    round_to,
)
from merchantlens.functions.text import DEFAULT_ACTION_ITEM

DEFAULT = [DEFAULT_ACTION_ITEM]


def evaluate(spark, values, kind, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row["r"] for row in df.orderBy("i").select(column(F.col("v")).alias("r")).collect()]


def test_round_scales_first(spark):
    values = [1.005, 0.285, -1.005, 2.5, 0.125, None]
    assert evaluate(spark, values, "double", lambda v: round_to(v, 2)) == [1.0, 0.28, -1.0, 2.5, 0.13, None]


def test_ratio_of_zero_is_null(spark):
    assert evaluate(spark, [0, 4], "int", lambda v: ratio(F.lit(1), v)) == [None, 0.25]


@pytest.mark.parametrize("digits", [1, 2])
def test_printf_round_equals_python_formatting(spark, digits):
    draw = random.Random(7)
    ties = [n / 1000 for n in range(0, 100_000, 5)]
    values = [12.25, 12.35, 37.65, 37.55, 0.05, 2.675, 99.95, -12.25, 0.0, *ties]
    values += [draw.uniform(0, 100) for _ in range(5000)] + [n / 10_000 * 100 for n in range(10_001)]
    found = evaluate(
        spark, values, "double", lambda v: F.format_string(f"%.{digits}f", printf_round(v, digits))
    )
    assert found == [f"{v:.{digits}f}" for v in values]


def python_action_items(answer):
    """The rule written the obvious way in Python."""
    lines = [line.strip() for line in answer.splitlines()]
    return [line[7:].strip() for line in lines if line.upper().startswith("ACTION:")][:4]


ANSWERS = [
    "ACTION: a\n  action: b \n• ACTION: c\nAction:d",
    "one\r\nACTION: two\r\n\r\nACTION:three",
    "\n".join(f"ACTION: {n}" for n in range(6)),
    "no items here",
    "",
    "ACTION:",
    "text ACTION: inside a line",
    "x\x0bACTION: vt\x0cACTION: ff\x1cACTION: fs\x1dACTION: gs\x1eACTION: rs",
    "x\u2028ACTION: ls\u2029ACTION: ps\u0085ACTION: nel",
    "\u00a0\u3000ACTION:\u00a0wide\u2003\t\x1f",
    "ACTıON: dotless i",
    "- ACTION: dash",
]


def test_action_items_equal_the_python_rule(spark):
    found = evaluate(spark, ANSWERS, "string", action_items)
    assert found == [python_action_items(answer) for answer in ANSWERS]


def test_action_items_of_random_text(spark):
    draw = random.Random(11)
    pieces = ["ACTION:", "action: ", " ", "\t", "\n", "\r\n", "\r", "\x0b", "\x1c", "\u2028", "word", "•", "\xa0", "é"]
    answers = ["".join(draw.choices(pieces, k=draw.randint(0, 12))) for _ in range(3000)]
    found = evaluate(spark, answers, "string", action_items)
    assert found == [python_action_items(answer) for answer in answers]


REPLIES = {
    '["a","b"]': ["a", "b"],
    '  ["a", "b"]\n': ["a", "b"],
    "[]": [],
    "[1,": DEFAULT,
    '["a"] and more': DEFAULT,
    '["a"]]': DEFAULT,
    '["a"],["b"]': DEFAULT,
    '["a"],"items":["b"]': DEFAULT,
    '["a"],"end"]': DEFAULT,
    "['a']": DEFAULT,
    "plain": DEFAULT,
    '{"a": 1}': DEFAULT,
    '["]", "[x\\n"]': ["]", "[x\n"],
    '["ü", "\\u00fc"]': ["ü", "ü"],
    "": DEFAULT,
}


def test_json_replies(spark):
    found = evaluate(spark, list(REPLIES), "string", json_string_items)
    assert found == list(REPLIES.values())
    for reply, items in REPLIES.items():
        if items is not DEFAULT:
            assert json.loads(reply.strip()) == items


def test_missing_reply_reads_as_default(spark):
    assert evaluate(spark, [None], "string", json_string_items) == [DEFAULT]


def test_reply_is_used_only_without_action_lines(spark):
    df = spark.createDataFrame([("ACTION: x", '["r"]'), ("none", '["r"]')], "answer string, reply string")
    rows = df.select(action_items_or_reply(F.col("answer"), F.col("reply")).alias("items")).collect()
    assert [row["items"] for row in rows] == [["x"], ["r"]]
