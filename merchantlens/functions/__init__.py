"""Column helpers built only from Spark's own expressions."""

from merchantlens.functions.numbers import printf_round, ratio, round_to
from merchantlens.functions.text import (
    action_items,
    action_items_or_reply,
    json_string_items,
    split_lines,
    strip,
)
from merchantlens.functions.times import as_timestamp, calendar_days

__all__ = [
    "action_items",
    "action_items_or_reply",
    "as_timestamp",
    "calendar_days",
    "json_string_items",
    "printf_round",
    "ratio",
    "round_to",
    "split_lines",
    "strip",
]
