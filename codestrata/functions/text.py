"""String helpers with the line, trim and path rules the analyses rely on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Code points with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ASCII word boundaries: the JVM's \w is ASCII, its \b is Unicode-aware.
WORD_START = r"(?<!\w)"
WORD_END = r"(?!\w)"


def rx(pattern: str, ignore_case: bool = False) -> str:
    """Only ``\\n`` ends a line; case folding covers Unicode."""
    return ("(?diu)" if ignore_case else "(?d)") + pattern


def trim(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def extension(path: Column) -> Column:
    """Last dot of the last component to the end, '' if there is none."""
    return F.regexp_extract(path, r"\.[^./]*\z", 0)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def any_of(tests) -> Column:
    tests = list(tests)
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def contains_any(col: Column, needles) -> Column:
    return any_of(col.contains(n) for n in needles)


def ends_with_any(col: Column, suffixes) -> Column:
    return any_of(col.endswith(s) for s in suffixes)


def lookup(col: Column, table: dict) -> Column:
    """Value of a small fixed table, null if the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[col]


def count_char(col: Column, char: str) -> Column:
    return (F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))).cast("long")


def scan_lines(content: Column) -> Column:
    """Lines without terminators: no line after a final newline, none for ''."""
    body = F.regexp_replace(content, r"\n\z", "")
    lines = F.split(body, "\n", -1)
    stripped = F.transform(lines, lambda x: F.regexp_replace(x, r"\r\z", ""))
    return (
        F.when(content == "", F.array().cast("array<string>"))
        .when(content.contains("\r"), stripped)
        .otherwise(lines)
    )


def split_lines(content: Column) -> Column:
    """Pieces between newlines, including the one after a final newline."""
    return F.split(content, "\n", -1)
