"""Weighted token estimate as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codestrata.functions.text import WHITE_SPACE

# Token weight of special characters; every other white-space
# character weighs 0.3, everything else 0.8 in code and 0.25 in prose.
CHARS_BY_WEIGHT = {
    0.3: " .,-'",
    0.5: "\t\n():;=+*/\"`<>!?#",
    0.7: "[]{}\\&|@",
}
SPACE_WEIGHT = 0.3
CODE_WEIGHT = 0.8
TEXT_WEIGHT = 0.25

_SCALE = 20  # every weight is a whole number of twentieths

# Each weighted character is first translated to one mark per weight. The marks
# are control characters; where a text contains them, they become plain text.
_MARKS = {0.3: "\x01", 0.5: "\x02", 0.7: "\x03"}
_SPECIAL = "".join(CHARS_BY_WEIGHT.values())
_OTHER_SPACE = "".join(c for c in WHITE_SPACE if c not in _SPECIAL)
_FROM = _SPECIAL + _OTHER_SPACE + "".join(_MARKS.values())
_TO = (
    "".join(_MARKS[w] * len(chars) for w, chars in CHARS_BY_WEIGHT.items())
    + _MARKS[SPACE_WEIGHT] * len(_OTHER_SPACE) + "x" * len(_MARKS)
)


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once for all its uses inside ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _twentieths(marked: Column, other_weight: float) -> Column:
    other = round(other_weight * _SCALE)
    total = F.length(marked) * other
    for weight, mark in _MARKS.items():
        count = F.length(marked) - F.length(F.replace(marked, F.lit(mark), F.lit("")))
        total = total + count * (round(weight * _SCALE) - other)
    return total.cast("long")


def _summed_in_order(marked: Column, other_weight: float) -> Column:
    """The same sum in doubles, character by character."""

    def weigh(total: Column, ch: Column) -> Column:
        w = F.when(ch == "", 0.0)
        for weight, mark in _MARKS.items():
            w = w.when(ch == mark, weight)
        return total + w.otherwise(other_weight)

    return F.aggregate(F.split(marked, ""), F.lit(0.0), weigh)


def estimate(text: Column, is_code: bool = False) -> Column:
    """Truncated weighted count.

    The count is exact integer arithmetic, except where the exact sum is a
    whole number: only there can accumulated rounding of doubles truncate one
    lower, so only those rows repeat the sum in doubles.
    """
    other = CODE_WEIGHT if is_code else TEXT_WEIGHT

    def of_marked(marked: Column) -> Column:
        return _bind(
            _twentieths(marked, other),
            lambda exact: F.when(
                exact % _SCALE == 0, F.floor(_summed_in_order(marked, other)).cast("long")
            ).otherwise(F.floor(exact / _SCALE).cast("long")),
        )

    return _bind(F.translate(text, _FROM, _TO), of_marked)


def basic_estimate(chars: Column) -> Column:
    """Four characters per token, rounded down."""
    return F.floor(chars / 4).cast("long")
