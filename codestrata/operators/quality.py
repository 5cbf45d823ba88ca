"""Line classes, complexity, nesting, smells and their roll-ups.

Block-comment state and nesting depth are computed inside the file's row, so
the only shuffles are final sums over narrow numeric rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import rules
from codestrata.functions.carry import NO_CHANGE, carry_before
from codestrata.functions.text import (
    WORD_END, WORD_START, basename, contains_any, count_char, extension,
    lookup, rx, scan_lines, trim,
)

OPEN, CLOSE = "o", "c"


def language_of(path: Column, extended: bool = False) -> Column:
    table = rules.LANGUAGE_EXTENDED if extended else rules.LANGUAGE_BASIC
    return F.coalesce(lookup(F.lower(extension(path)), table), F.lit(rules.LANGUAGE_DEFAULT))


# --- facts about one line ---------------------------------------------------


def comment_test(language: Column, text: Column, in_block: Column) -> Column:
    """Is the trimmed non-blank line a comment?"""
    return (
        F.when(
            language.isin(rules.BLOCK_COMMENT_LANGUAGES),
            text.startswith("//") | text.startswith("/*") | in_block,
        )
        .when(language.isin(rules.HASH_COMMENT_LANGUAGES), text.startswith("#"))
        .when(language.isin(rules.MARKUP_COMMENT_LANGUAGES), text.startswith("<!--"))
        .when(language == "CSS", text.startswith("/*"))
        .otherwise(False)
    )


_TOKEN = rx(
    WORD_START + "(?:" + "|".join(rules.COMPLEXITY_WORDS) + ")" + WORD_END
    + r"|(?<=\w)(?:" + "|".join(rules.COMPLEXITY_SIGNS) + r")(?=\w)"
)


def complexity_of(line: Column) -> Column:
    """Control-flow tokens in the line, one regex pass for all of them."""
    return F.regexp_count(line, F.lit(_TOKEN)).cast("long")


_SPACE = r"[\t\n\f\r ]"
_WORD = r"\w"
_BRACED_CALL = rx(rf"{_WORD}{_SPACE}*\([^)]*\){_SPACE}*\{{")
_ARROW_BODY = rx(rf"=>{_SPACE}*\{{")
_TYPED_CALL = rx(rf"{_WORD}{_SPACE}+{_WORD}+{_SPACE}*\([^)]*\){_SPACE}*\{{")


def function_test(language: Column, line: Column, text: Column) -> Column:
    return (
        F.when(language == "Go", text.startswith("func "))
        .when(
            language.isin("JavaScript", "TypeScript"),
            line.contains("function ") | line.rlike(_ARROW_BODY) | line.rlike(_BRACED_CALL),
        )
        .when(language.isin("Python", "Ruby"), text.startswith("def "))
        .when(language.isin("Java", "C", "C++", "C#"), line.rlike(_TYPED_CALL))
        .when(language == "Rust", text.startswith("fn "))
        .otherwise(False)
    )


def class_test(language: Column, text: Column) -> Column:
    plain = text.startswith("class ")
    return (
        F.when(language == "Go", text.startswith("type ") & text.contains("struct"))
        .when(language.isin("JavaScript", "TypeScript", "Python", "Ruby"), plain)
        .when(
            language.isin("Java", "C++", "C#"),
            plain | text.startswith("public class ") | text.startswith("private class "),
        )
        .when(language == "Rust", text.startswith("struct ") | text.startswith("impl "))
        .otherwise(False)
    )


def nesting_change(language: Column, line: Column, text: Column) -> Column:
    colon = language.isin(rules.COLON_NESTING_LANGUAGES) & text.endswith(":")
    return count_char(line, "{") - count_char(line, "}") + colon.cast("long")


# \w, \d and \W are ASCII in the JVM and far cheaper than spelled-out ranges
_MAGIC = rx(r"\W\d{2,}+\W")


def smell_tests(language: Column, line: Column, text: Column) -> dict[str, Column]:
    """Smell name to test, in reporting order."""
    upper = F.upper(line)
    indent = F.length(line) - F.length(F.ltrim(line, F.lit(" \t")))
    return {
        rules.SMELL_LONG: F.octet_length(line) > rules.LONG_LINE_BYTES,
        rules.SMELL_MULTI: ~language.isin(rules.COLON_NESTING_LANGUAGES) & (count_char(line, ";") > 1),
        rules.SMELL_TODO: upper.contains("TODO"),
        rules.SMELL_FIXME: upper.contains("FIXME"),
        rules.SMELL_HACK: upper.contains("HACK"),
        rules.SMELL_DEBUG: contains_any(line, rules.DEBUG_MARKS),
        rules.SMELL_MAGIC: ~contains_any(text, ["const", "final"]) & line.rlike(_MAGIC),
        rules.SMELL_DEEP: indent > rules.DEEP_INDENT,
    }


# --- lines of the analysed files ---------------------------------------------


def _block_state(lines: Column) -> Column:
    def mark(line: Column) -> Column:
        text = trim(line)
        return F.when(text.endswith("*/"), CLOSE).when(text.startswith("/*"), OPEN).otherwise(NO_CHANGE)

    return carry_before(F.transform(lines, mark))


def _max_nesting(language: Column, lines: Column) -> Column:
    def step(acc: Column, line: Column) -> Column:
        now = acc["now"] + nesting_change(language, line, trim(line))
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    zero = F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("top"))
    return F.aggregate(lines, zero, step)["top"]


def _with_lines(files: DataFrame, extended: bool) -> DataFrame:
    """Files with their line array; lines of any length count."""
    return files.select(
        "repo", "path", "content",
        language_of(F.col("path"), extended).alias("language"),
        scan_lines(F.col("content")).alias("_lines"),
    )


def _explode(with_lines: DataFrame, keep: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """One row per line with ``line_no``, ``line``, ``in_block``.

    With ``outer`` a file without lines yields one row of null line.
    """
    stateful = F.col("language").isin(rules.BLOCK_COMMENT_LANGUAGES) & F.col("content").contains("/*")
    states = F.when(stateful, F.slice(_block_state(F.col("_lines")), F.lit(1), F.size("_lines")))
    zipped = F.arrays_zip(
        F.col("_lines").alias("line"),
        F.coalesce(states, F.array().cast("array<string>")).alias("state"),
    )
    explode = F.posexplode_outer if outer else F.posexplode
    return with_lines.select(
        "repo", "path", "language", *keep, explode(zipped).alias("_pos", "_at")
    ).select(
        "repo", "path", "language", *keep,
        (F.col("_pos") + 1).cast("long").alias("line_no"),
        F.col("_at.line").alias("line"),
        F.coalesce(F.col("_at.state") == OPEN, F.lit(False)).alias("in_block"),
        trim(F.col("_at.line")).alias("text"),
    )


def _lines(files: DataFrame, extended: bool = False, **kwargs) -> DataFrame:
    return _explode(_with_lines(files, extended), **kwargs)


def _kind() -> Column:
    comment = comment_test(F.col("language"), F.col("text"), F.col("in_block"))
    return F.when(F.col("text") == "", "blank").when(comment, "comment").otherwise("code")


def classify_lines(files: DataFrame, extended: bool = False) -> DataFrame:
    """blank / comment / code for every scanned line."""
    return _lines(files, extended).select("repo", "path", "language", "line_no", _kind().alias("kind"))


def line_complexity(files: DataFrame) -> DataFrame:
    """Control-flow tokens per non-blank line, comments included."""
    return (
        _lines(files).filter(F.col("text") != "")
        .select("repo", "path", "line_no", complexity_of(F.col("line")).alias("complexity"))
    )


def declarations(files: DataFrame, extended: bool = False) -> DataFrame:
    """Lines that declare a function or a class."""
    lang, line, text = F.col("language"), F.col("line"), F.col("text")
    return (
        _lines(files, extended).filter(text != "")
        .select(
            "repo", "path", "language", "line_no",
            function_test(lang, line, text).alias("is_function"),
            class_test(lang, text).alias("is_class"),
        )
        .filter("is_function or is_class")
    )


def nesting_depth(files: DataFrame, extended: bool = False) -> DataFrame:
    """Deepest running brace (or colon) level per file, at least 0."""
    return _with_lines(files, extended).select(
        "repo", "path", "language",
        _max_nesting(F.col("language"), F.col("_lines")).alias("max_nesting"),
    )


def line_smells(files: DataFrame, extended: bool = False) -> DataFrame:
    """One row per (line, smell)."""
    tests = smell_tests(F.col("language"), F.col("line"), F.col("text"))
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    return (
        _lines(files, extended).filter(F.col("text") != "")
        .select("repo", "path", "language", "line_no", F.explode(found).alias("smell"))
    )


_SMELLS = [
    rules.SMELL_LONG, rules.SMELL_MULTI, rules.SMELL_TODO, rules.SMELL_FIXME,
    rules.SMELL_HACK, rules.SMELL_DEBUG, rules.SMELL_MAGIC, rules.SMELL_DEEP,
]


def _line_facts(files: DataFrame, extended: bool, keep: tuple[str, ...] = (), with_lines=None) -> DataFrame:
    """Numbers per line, ready to be summed; one null line stands for an empty file."""
    lang, line, text = F.col("language"), F.col("line"), F.col("text")
    if with_lines is None:
        with_lines = _with_lines(files, extended)
    rows = _explode(with_lines, keep=keep, outer=True)
    first = F.coalesce(F.col("line_no"), F.lit(1)) == 1
    kind = F.when(line.isNull(), None).otherwise(_kind())
    busy = F.coalesce(text != "", F.lit(False))

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("long")

    smells = smell_tests(lang, line, text)
    return rows.select(
        "repo", "path", "language", *keep,
        flag(first).alias("files"),
        flag(first & is_test_file(F.col("path"))).alias("test_files"),
        flag(line.isNotNull()).alias("lines"),
        flag(kind == "code").alias("code_lines"),
        flag(kind == "comment").alias("comment_lines"),
        flag(kind == "blank").alias("blank_lines"),
        F.when(busy, complexity_of(line)).otherwise(0).alias("complexity"),
        flag(busy & function_test(lang, line, text)).alias("functions"),
        flag(busy & class_test(lang, text)).alias("classes"),
        *[flag(busy & smells[name]).alias(f"smell_{i}") for i, name in enumerate(_SMELLS)],
    )


_SMELL_COLUMNS = [f"smell_{i}" for i in range(len(_SMELLS))]
_SUM_COLUMNS = ["lines", "code_lines", "comment_lines", "blank_lines", "complexity", "functions", "classes"]


def _total_smells() -> Column:
    return reduce(add, [F.col(c) for c in _SMELL_COLUMNS])


def file_metrics(files: DataFrame, extended: bool = False) -> DataFrame:
    """Per-file roll-up. The lines of a file sit in one task, so the partial sum
    already reduces each file to one narrow row before the exchange."""
    nested = _with_lines(files, extended).withColumn(
        "max_nesting", _max_nesting(F.col("language"), F.col("_lines"))
    )
    facts = _line_facts(files, extended, keep=("max_nesting",), with_lines=nested)
    return facts.groupBy("repo", "path", "language", "max_nesting").agg(
        *[F.sum(c).alias(c) for c in _SUM_COLUMNS], F.sum(_total_smells()).alias("smells")
    )


def language_metrics(files: DataFrame, extended: bool = False) -> DataFrame:
    """Files and lines per (repo, language), straight from the line facts."""
    return _language_totals(files, extended).filter("files > 0").select(
        "repo", "language", F.col("files").alias("file_count"),
        "lines", "code_lines", "comment_lines", "blank_lines",
        (F.col("complexity") / F.col("files")).alias("avg_complexity"),
    )


def _language_totals(files: DataFrame, extended: bool = False) -> DataFrame:
    sums = ["files", "test_files", *_SUM_COLUMNS, *_SMELL_COLUMNS]
    return _line_facts(files, extended).groupBy("repo", "language").agg(*[F.sum(c).alias(c) for c in sums])


def is_test_file(path: Column) -> Column:
    return contains_any(F.lower(basename(path)), ["test", "spec"])


def test_coverage(files: DataFrame) -> DataFrame:
    """Test files over all files, in percent."""
    analysed = F.count(F.lit(1)).alias("analysed_files")
    return (
        files.groupBy("repo")
        .agg(analysed, F.count_if(is_test_file(F.col("path"))).alias("test_files"))
        .withColumn(
            "test_coverage",
            F.when(F.col("analysed_files") > 0, F.col("test_files") / F.col("analysed_files") * 100).otherwise(0.0),
        )
    )


def _floor_log2(x: Column) -> Column:
    whole = F.floor(x).cast("long")
    return F.when(whole < 2, 0).otherwise(F.length(F.bin(whole)) - 1)


def maintainability(code: Column, total: Column, comment: Column, avg_complexity: Column, smells: Column) -> Column:
    """Index in 0..100 from project totals."""
    volume = code.cast("double") * 1.2
    index = (
        171.0 - 5.2 * _floor_log2(volume) - 0.23 * (avg_complexity * 2.0) - 16.2 * _floor_log2(code)
        + F.when(total > 0, comment / total).otherwise(0.0) * 20.0 - smells * 0.5
    )
    return F.when(code == 0, 100.0).otherwise(F.least(F.greatest(index, F.lit(0.0)), F.lit(100.0)))


def project_metrics(files: DataFrame, extended: bool = False) -> DataFrame:
    """Totals, averages, coverage and index per repository."""
    return _project_totals(_language_totals(files, extended)).select(
        "repo", "total_files", "total_lines", "code_lines", "comment_lines", "blank_lines",
        "avg_complexity", "smells", "test_files",
        "test_coverage", "maintainability",
    )


def _project_totals(by_language: DataFrame) -> DataFrame:
    language = F.struct("language", "files", "lines")
    totals = by_language.groupBy("repo").agg(
        F.sum("files").alias("total_files"),
        F.sum("test_files").alias("test_files"),
        F.sum("lines").alias("total_lines"),
        *[F.sum(c).alias(c) for c in ("code_lines", "comment_lines", "blank_lines", "complexity")],
        F.sum(_total_smells()).alias("smells"),
        *[F.sum(c).alias(c) for c in _SMELL_COLUMNS],
        # one entry per known language, so bounded by the language table
        F.array_sort(F.collect_list(F.when(F.col("files") > 0, language))).alias("languages"),
    )
    counted = F.col("total_files") > 0
    totals = totals.withColumns({
        "avg_complexity": F.when(counted, F.col("complexity") / F.col("total_files")).otherwise(0.0),
        "test_coverage": F.when(counted, F.col("test_files") / F.col("total_files") * 100).otherwise(0.0),
    })
    return totals.withColumn(
        "maintainability",
        maintainability(
            F.col("code_lines"), F.col("total_lines"), F.col("comment_lines"),
            F.col("avg_complexity"), F.col("smells"),
        ),
    )


def truncated(x: Column, digits: int) -> Column:
    """Decimal text cut, not rounded, digit by digit."""
    frac = x - F.floor(x)
    parts, scaled = [F.floor(x).cast("string"), F.lit(".")], frac
    for _ in range(digits):
        scaled = scaled * 10
        parts.append((F.floor(scaled).cast("long") % 10).cast("string"))
    return F.concat(*parts)


def quality_summary(files: DataFrame, extended: bool = False) -> DataFrame:
    """Report lines per repository: (section, key, value)."""
    totals = _project_totals(_language_totals(files, extended))

    def share(c: str) -> Column:
        percent = truncated(F.col(c) / F.col("total_lines") * 100, 1)
        return F.concat(
            F.col(c).cast("string"),
            F.when(F.col("total_lines") > 0, F.concat(F.lit(" ("), percent, F.lit("%)"))).otherwise(""),
        )

    def entry(section: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), key.alias("key"), value.cast("string").alias("value"))

    coverage = F.col("test_coverage")
    fixed = [
        entry("totals", F.lit(k), v) for k, v in {
            "Total Files": F.col("total_files"),
            "Total Lines": F.col("total_lines"),
            "Code Lines": share("code_lines"),
            "Comment Lines": share("comment_lines"),
            "Blank Lines": F.col("blank_lines"),
            "Average Cyclomatic Complexity": truncated(F.col("avg_complexity"), 2),
            "Test Coverage Estimate": F.concat(
                truncated(coverage, 1), F.lit("% ("), F.col("test_files").cast("string"), F.lit(" test files)")
            ),
            "Maintainability Index": F.concat(truncated(F.col("maintainability"), 1), F.lit("/100")),
        }.items()
    ] + [F.when(F.col("smells") > 0, entry("totals", F.lit("Code Smells Detected"), F.col("smells")))]
    smells = [
        F.when(F.col(c) > 0, entry("smell", F.lit(name), F.col(c))) for c, name in zip(_SMELL_COLUMNS, _SMELLS)
    ]
    languages = F.transform(
        F.col("languages"),
        lambda x: entry(
            "language", x["language"],
            F.concat(x["files"].cast("string"), F.lit(" files, "), x["lines"].cast("string"), F.lit(" lines")),
        ),
    )
    rows = F.concat(F.array_compact(F.array(*fixed, *smells)), languages)
    return totals.select("repo", F.inline(rows))
