"""Prompt text, report rows and documents, memory-bounded batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.operators import inventory, tree
from codestrata.operators.ordering import prefix
from codestrata.operators.quality import language_of
from codestrata.operators.tokens import project_stats

# Headings of the text form.
_RULE, _BAR = "-" * 53, "=" * 48
STRUCTURE_HEAD = f"\nPROJECT STRUCTURE:\n{_RULE}\n"
CONTENTS_HEAD = f"\nFILE CONTENTS:\n{_RULE}"


def prompt_text(files: DataFrame) -> DataFrame:
    """The text document of each repository as rows in (section, line_no, path, part) order.

    Every row is one line-terminated piece, so writing the ordered rows as text
    gives the document; a repository is never gathered into one value.
    """
    def row(section: int, text: Column, part: int = 0) -> Column:
        return F.struct(
            F.lit(section).cast("long").alias("section"), F.lit(part).cast("long").alias("part"), text.alias("text")
        )

    repos = files.select("repo").distinct()
    heads = repos.select(
        "repo", F.inline(F.array(row(1, F.lit(STRUCTURE_HEAD)), row(3, F.lit(CONTENTS_HEAD))))
    ).select("repo", "section", F.lit(0).cast("long").alias("line_no"), F.lit("").alias("path"), "part", "text")
    structure = tree.tree_text(tree.tree_nodes(files)).select(
        "repo", F.lit(2).cast("long").alias("section"), "line_no", F.lit("").alias("path"),
        F.lit(0).cast("long").alias("part"), "text",
    )
    title = F.concat(F.lit(f"\n{_BAR}\nFile: "), F.col("path"), F.lit(f"\n{_BAR}"))
    bodies = files.filter(F.octet_length("content") > 0).select(
        "repo", "path", F.inline(F.array(row(4, title), row(4, F.col("content"), 1)))
    ).select("repo", "section", F.lit(0).cast("long").alias("line_no"), "path", "part", "text")
    return heads.unionByName(structure).unionByName(bodies)


PROMPT_ORDER = ["section", "line_no", "path", "part"]


def project_report(files: DataFrame) -> DataFrame:
    """Report rows (repo, section, key, value): statistics, technologies, key
    files, issues, file types and the file list."""
    def rows(df: DataFrame, section: str, key: Column, value: Column) -> DataFrame:
        return df.select("repo", F.lit(section).alias("section"), key.alias("key"), value.cast("string").alias("value"))

    stats = project_stats(files)
    numbers = ["file_count", "total_size", "avg_file_size", "token_count", "char_count"]
    unpivoted = stats.select("repo", F.inline(F.array(*[
        F.struct(F.lit(n).alias("_k"), F.col(n).alias("_v")) for n in numbers
    ])))
    parts = [
        rows(unpivoted, "statistics", F.col("_k"), F.col("_v")),
        rows(inventory.technologies(files), "technologies", F.col("technology"), F.lit("")),
        rows(inventory.key_files(files), "key_files", F.col("path"), F.lit("")),
        rows(inventory.project_issues(files), "issues", F.col("issue"), F.lit("")),
        rows(inventory.file_types(files), "file_types", F.col("extension"), F.col("file_count")),
        rows(
            files.filter(F.octet_length("content") > 0), "files", F.col("path"),
            F.concat(F.col("size").cast("string"), F.lit(" "), language_of(F.col("path"))),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


SECTIONS = ["statistics", "technologies", "key_files", "issues", "file_types", "files"]


def render_report(report: DataFrame, fmt: str, part_rows: int | None = None) -> DataFrame:
    """(repo, part, document): report documents as values.

    One document per repository. With ``part_rows`` a document holds at most so
    many report rows and a larger repository continues in further parts.
    """
    if fmt not in ("json", "xml", "txt"):
        raise ValueError(f"unknown report format: {fmt}")
    part = F.lit(0) if part_rows is None else F.floor((F.col("rank") - 1) / part_rows)
    numbered = prefix(report, ["repo"], ["section", "key"]).withColumn("part", part.cast("long"))
    parts = numbered.groupBy("repo", "part").agg(
        F.array_sort(F.collect_list(F.struct("rank", "section", "key", "value"))).alias("_rows")
    )

    def section(name: str) -> Column:
        mine = F.filter("_rows", lambda r: r["section"] == name)
        return F.transform(mine, lambda r: F.struct(r["key"].alias("key"), r["value"].alias("value"))).alias(name)

    document = F.struct(F.col("repo").alias("name"), F.col("part").alias("part"), *[section(s) for s in SECTIONS])
    if fmt == "json":
        text = F.to_json(document)
    elif fmt == "xml":
        text = F.to_xml(document, {"rowTag": "report"})
    else:
        lines = F.transform("_rows", lambda r: F.concat(r["section"], F.lit(": "), r["key"], F.lit(" "), r["value"]))
        text = F.concat_ws("\n", F.concat(F.lit("PROJECT: "), F.col("repo")), F.array_join(lines, "\n"))
    return parts.select("repo", "part", text.alias("document"))
