"""Ordered state over the lines of one file, inside the file's own row.

Each line contributes one mark: ``.`` for "no change" or a state letter. The
marks are joined into one string, a single regex pass cuts it into runs that
start with a state letter, and each run is filled with that letter. Linear in
the number of lines, and no shuffle or sort of the lines is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NO_CHANGE = "."


def carry_forward(marks: Column) -> Column:
    """State after each line (array of one-letter strings, ``.`` = none yet)."""
    runs = F.regexp_extract_all(F.array_join(marks, ""), F.lit(r"[^.]\.*|\.+"), F.lit(0))
    filled = F.transform(runs, lambda r: F.repeat(F.left(r, F.lit(1)), F.length(r)))
    text = F.array_join(filled, "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def carry_before(marks: Column) -> Column:
    """State in force when each line begins (one entry longer than the input)."""
    return carry_forward(F.concat(F.array(F.lit(NO_CHANGE)), marks))
