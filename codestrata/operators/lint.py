"""Lint rules on source lines and ingestion of lint reports.

Issue columns: repo, path, line, column, severity, message, rule, linter, fixable.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.functions.text import any_of, split_lines, trim
from codestrata.session import stage

COLUMNS = ["repo", "path", "line", "column", "severity", "message", "rule", "linter", "fixable"]

# Rule name, severity, message, fixable.
JS_RULES = {
    "console.log": ("no-console", "warning", "Unexpected console statement", False),
    "debugger": ("no-debugger", "error", "Unexpected debugger statement", True),
    " var ": ("no-var", "warning", "Unexpected var, use let or const instead", True),
}
GO_RULE = ("no-commented-code", "info", "Commented code should be removed", True)
PY_RULE = ("use-logging", "info", "Consider using logging instead of print", False)


def _rule(test: Column, rule: tuple, seq: int) -> Column:
    name, severity, message, fixable = rule
    return F.when(test, F.struct(
        F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(name).alias("rule"),
        F.lit(fixable).alias("fixable"), F.lit(seq).cast("long").alias("seq"),
    ))


@dataclass(frozen=True)
class RuleSet:
    """Rules of the files with some suffix; ``hint`` skips whole files that hold no issue."""

    suffixes: tuple[str, ...]
    linter: str
    stage: int
    hint: Column
    rules: list[Column]

    def wanted(self) -> Column:
        return any_of(F.col("path").endswith(s) for s in self.suffixes) & self.hint


def _lint(files: DataFrame, sets: list[RuleSet]) -> DataFrame:
    """Rules on the split lines of matching files, all sets in one pass.

    A suffix belongs to one set only, so a file has at most one.
    """
    def by_set(value) -> Column:
        first, *rest = sets
        return reduce(lambda cases, s: cases.when(F.col("stage") == s.stage, value(s)), rest, F.when(F.col("stage") == first.stage, value(first)))

    stage_of = F.coalesce(*[F.when(s.wanted(), s.stage) for s in sets]).cast("long")
    return (
        files.filter(any_of(s.wanted() for s in sets))
        .select("repo", "path", stage_of.alias("stage"), F.posexplode(split_lines(F.col("content"))).alias("_pos", "_line"))
        .select("repo", "path", "stage", "_pos", "_line", trim(F.col("_line")).alias("_text"))
        .select(
            "repo", "path", "stage", (F.col("_pos") + 1).cast("long").alias("line"),
            F.inline(by_set(lambda s: F.array_compact(F.array(*s.rules)))),
        )
        .select(
            "repo", "path", "line", F.lit(0).cast("long").alias("column"), "severity", "message", "rule",
            by_set(lambda s: F.lit(s.linter)).alias("linter"), "fixable", "stage", "seq",
        )
    )


def _js() -> RuleSet:
    line, content = F.col("_line"), F.col("content")
    quiet = ~line.contains("//")
    rules = [_rule(line.contains(m) & quiet, r, i) for i, (m, r) in enumerate(JS_RULES.items())]
    return RuleSet((".js", ".ts"), "basic-js", 1, any_of(content.contains(m) for m in JS_RULES), rules)


def _go() -> RuleSet:
    text = F.col("_text")
    rest = F.substring(text, F.lit(4), F.length(text))
    test = text.startswith("// ") & (rest.contains("func ") | rest.contains("if "))
    return RuleSet((".go",), "basic-go", 2, F.col("content").contains("// "), [_rule(test, GO_RULE, 0)])


def _py() -> RuleSet:
    return RuleSet((".py",), "basic-py", 3, F.col("content").contains("print("), [_rule(F.col("_text").startswith("print("), PY_RULE, 0)])


def lint_js(files: DataFrame) -> DataFrame:
    return _lint(files, [_js()]).select(*COLUMNS)


def lint_go(files: DataFrame) -> DataFrame:
    return _lint(files, [_go()]).select(*COLUMNS)


def lint_py(files: DataFrame) -> DataFrame:
    return _lint(files, [_py()]).select(*COLUMNS)


def lint(files: DataFrame) -> DataFrame:
    """All rule sets in one pass over the contents; (stage, path, line, seq) is the reporting order."""
    return _lint(files, [_js(), _go(), _py()])


# --- reports of external linters ---------------------------------------------------


def _relative(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def ingest_eslint(reports: DataFrame, root: str) -> DataFrame:
    """(repo, report JSON) to issues; a report that does not parse gives none."""
    schema = (
        "array<struct<filePath:string,messages:array<struct<line:bigint,column:bigint,severity:int,"
        "message:string,ruleId:string,fix:struct<text:string>>>>>"
    )
    return (
        reports.select("repo", F.inline(F.from_json("report", schema)))
        .select("repo", _relative(F.col("filePath"), root).alias("path"), F.inline("messages"))
        .select(
            "repo", "path", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("column", F.lit(0)).alias("column"),
            F.when(F.col("severity") == 2, "error").otherwise("warning").alias("severity"),
            F.coalesce("message", F.lit("")).alias("message"), F.coalesce("ruleId", F.lit("")).alias("rule"),
            F.lit("eslint").alias("linter"), F.col("fix").isNotNull().alias("fixable"),
        )
    )


def ingest_pylint(reports: DataFrame, root: str) -> DataFrame:
    schema = "array<struct<type:string,path:string,line:bigint,column:bigint,message:string,symbol:string>>"
    kind = F.col("type")
    return reports.select("repo", F.inline(F.from_json("report", schema))).select(
        "repo", _relative(F.col("path"), root).alias("path"),
        F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("column", F.lit(0)).alias("column"),
        F.when(kind.isin("error", "fatal"), "error").when(kind == "warning", "warning").otherwise("info").alias("severity"),
        F.coalesce("message", F.lit("")).alias("message"), F.coalesce("symbol", F.lit("")).alias("rule"),
        F.lit("pylint").alias("linter"), F.lit(False).alias("fixable"),
    )


def _report_fields(reports: DataFrame) -> DataFrame:
    """Up to four ``:``-separated fields of each line, at least three."""
    fields = F.split("_line", ":", 4)
    return reports.select("repo", F.explode(split_lines(F.col("report"))).alias("_line")).select(
        "repo", fields.alias("_f")
    ).filter(F.size("_f") >= 3)


def _number(text: Column) -> Column:
    """Digits only, anything else is 0."""
    t = trim(text)
    return F.when(t.rlike(r"\A[0-9]+\z"), t.try_cast("long")).otherwise(0).cast("long")


def ingest_golint(reports: DataFrame, linter: str = "golint") -> DataFrame:
    f = F.col("_f")
    return _report_fields(reports).select(
        "repo", F.get(f, F.lit(0)).alias("path"), _number(F.get(f, F.lit(1))).alias("line"),
        _number(F.get(f, F.lit(2))).alias("column"), F.lit("warning").alias("severity"),
        F.coalesce(trim(F.get(f, F.lit(3))), F.lit("")).alias("message"), F.lit("").alias("rule"),
        F.lit(linter).alias("linter"), F.lit(False).alias("fixable"),
    )


def ingest_govet(reports: DataFrame) -> DataFrame:
    """The column text stays part of the message."""
    f = F.col("_f")
    return _report_fields(reports).select(
        "repo", F.get(f, F.lit(0)).alias("path"), _number(F.get(f, F.lit(1))).alias("line"),
        F.lit(0).cast("long").alias("column"), F.lit("error").alias("severity"),
        trim(F.array_join(F.slice(f, 3, 2), ":")).alias("message"), F.lit("go-vet").alias("rule"),
        F.lit("go-vet").alias("linter"), F.lit(False).alias("fixable"),
    )


def lint_summary(issues: DataFrame, n: int = 10) -> DataFrame:
    """Report rows (repo, section, key, count): totals by severity, fixable, by
    linter, by file and the first ``n`` issues in reporting order.

    Totals, linters and files are grouping sets of one aggregate. The issues are
    written once, so contents are not read again for the first ones.
    """
    issues = stage(issues)
    counts = (
        issues.groupingSets([["repo"], ["repo", "linter"], ["repo", "path"]], "repo", "linter", "path")
        .agg(
            F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")],
            F.count_if("fixable").alias("fixable"),
        )
    )

    def entry(section: str, key: Column, count: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), key.alias("key"), count.alias("count"))

    totals = F.array(*[
        entry("totals", F.lit(c), F.col(c)) for c in ("total", "error", "warning", "info", "fixable")
    ])
    by_linter = F.array(entry("linter", F.col("linter"), F.col("total")))
    by_file = F.array(entry("file", F.col("path"), F.col("total")))
    grouped = counts.select(
        "repo", F.inline(F.when(F.col("_g") == 3, totals).when(F.col("_g") == 1, by_linter).otherwise(by_file))
    )
    order = Window.partitionBy("repo").orderBy("stage", "path", "line", "seq")
    top = (
        issues.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)
        .select(
            "repo", F.lit("top").alias("section"),
            F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "rule").alias("key"),
            F.col("rank").alias("count"),
        )
    )
    return grouped.unionByName(top)
