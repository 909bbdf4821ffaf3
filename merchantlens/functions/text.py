"""Action items out of free text, as array expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text conventions the results are defined by.
ACTION_PREFIX = "ACTION:"
MAX_ACTION_ITEMS = 4
DEFAULT_ACTION_ITEM = "Review findings and prioritize remediation steps."

# Line ends: CR LF, LF, CR, VT, FF, FS, GS, RS, NEL, LINE SEPARATOR, PARAGRAPH SEPARATOR.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"
# Unicode white space plus the four separator control characters.
_SPACE = r"[\s\x1C-\x1F]"
OUTER_SPACE = rf"(?U)^{_SPACE}+|{_SPACE}+$"

# Only standard JSON counts as a reply: no single quotes.
_STRICT_JSON = {"allowSingleQuotes": "false"}


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def strip(text: Column) -> Column:
    """Trim all Unicode white space (``F.trim`` removes spaces only)."""
    return F.regexp_replace(text, OUTER_SPACE, "")


def action_items(answer: Column) -> Column:
    """The first four ``ACTION:`` lines of an answer without their prefix, in order.

    The prefix is matched in any case after stripping the line; a bulleted line does not match.
    """
    lines = F.transform(split_lines(answer), strip)
    marked = F.filter(lines, lambda line: F.upper(line).startswith(ACTION_PREFIX))
    bodies = F.transform(marked, lambda line: strip(F.substring(line, len(ACTION_PREFIX) + 1, 2**31 - 1)))
    return F.slice(bodies, 1, MAX_ACTION_ITEMS)


def json_string_items(reply: Column) -> Column:
    """A reply that is one JSON array, as array<string>; the default sentence for anything else.

    The JSON reader stops at the end of the first value, so text behind the array would go unseen.
    The reply is therefore read inside an object and inside an array: both must come out whole.
    """
    body = strip(reply)
    inside_object = F.from_json(
        F.concat(F.lit('{"items":'), body, F.lit("}")), "items array<string>", _STRICT_JSON
    )["items"]
    inside_array = F.from_json(F.concat(F.lit("["), body, F.lit(',"end"]')), "array<string>", _STRICT_JSON)
    whole = body.startswith("[") & (F.size(inside_array) == 2)
    return F.coalesce(F.when(whole, inside_object), F.array(F.lit(DEFAULT_ACTION_ITEM)))


def action_items_or_reply(answer: Column, reply: Column) -> Column:
    """Action items of the answer; where it has none, those of the follow-up reply."""
    found = action_items(answer)
    return F.when(F.size(found) > 0, found).otherwise(json_string_items(reply))
