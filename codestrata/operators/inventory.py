"""Languages, file types, technologies, key files and project issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import rules
from codestrata.functions.text import basename, contains_any, extension, lookup
from codestrata.operators.quality import language_of


def with_language(files: DataFrame, extended: bool = False) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path"), extended))


def file_types(files: DataFrame) -> DataFrame:
    """Files per extension, case kept."""
    ext = extension(F.col("path"))
    return (
        files.select("repo", F.when(ext == "", "(no extension)").otherwise(ext).alias("extension"))
        .groupBy("repo", "extension").agg(F.count(F.lit(1)).alias("file_count"))
    )


def _technologies(files: DataFrame, suffixes: dict, names: dict) -> DataFrame:
    path = F.col("path")
    hits = F.array_compact(F.array(lookup(extension(path), suffixes), lookup(basename(path), names)))
    return files.select("repo", F.explode(hits).alias("technology")).distinct()


def technologies(files: DataFrame) -> DataFrame:
    return _technologies(files, rules.TECH_SUFFIX_BASIC, rules.TECH_BASENAME_BASIC)


def technologies_ext(files: DataFrame) -> DataFrame:
    return _technologies(files, rules.TECH_SUFFIX_EXTENDED, rules.TECH_BASENAME_EXTENDED)


def key_files(files: DataFrame) -> DataFrame:
    return files.filter(basename(F.col("path")).isin(rules.KEY_FILES_BASIC)).select("repo", "path")


def key_files_ext(files: DataFrame) -> DataFrame:
    return files.filter(basename(F.col("path")).isin(rules.KEY_FILES_EXTENDED)).select("repo", "path")


def _missing(files: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row per (repo, issue) whose test holds for no file."""
    found = files.groupBy("repo").agg(*[F.bool_or(t).alias(f"_{i}") for i, t in enumerate(tests.values())])
    issues = [F.when(~F.col(f"_{i}"), name) for i, name in enumerate(tests)]
    return found.select("repo", F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def _issue_tests() -> dict[str, Column]:
    name = F.lower(basename(F.col("path")))
    return {
        rules.ISSUE_README: name.contains("readme"),
        rules.ISSUE_LICENSE: contains_any(name, ["license", "licence"]),
        rules.ISSUE_GITIGNORE: name == ".gitignore",
        rules.ISSUE_TESTS: contains_any(name, ["test", "spec"]),
    }


def project_issues(files: DataFrame) -> DataFrame:
    return _missing(files, {rules.ISSUE_README: _issue_tests()[rules.ISSUE_README]})


def project_issues_ext(files: DataFrame) -> DataFrame:
    return _missing(files, _issue_tests())


def repo_size(files: DataFrame) -> DataFrame:
    """Bytes per repository outside ``.git`` directories."""
    parts = F.split(F.col("path"), "/")
    inside = F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), ".git")
    return files.groupBy("repo").agg(F.sum(F.when(~inside, F.col("size")).otherwise(0)).alias("size"))
