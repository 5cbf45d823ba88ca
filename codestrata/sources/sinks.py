"""Writers. One folder per report, partitioned by repository, no driver copy."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codestrata.operators.advisories import vuln_counts


def write_report(rows: DataFrame, fmt: str, location: str, order: list[str] = ()) -> None:
    """Rows of one report per repository as json, xml or txt.

    ``txt`` expects a ``text`` column. Rows are range-partitioned by
    (repo, order), so a very large repository is written by many tasks and its
    part files, read in name order, are the document in order.
    """
    order = list(order)
    placed = rows.repartitionByRange("repo", *order).sortWithinPartitions("repo", *order)
    if fmt == "txt":
        placed.select("repo", "text").write.partitionBy("repo").text(location)
    elif fmt == "json":
        placed.write.partitionBy("repo").json(location)
    elif fmt == "xml":
        placed.write.partitionBy("repo").format("xml").option("rootTag", "report").option("rowTag", "row").save(location)
    else:
        raise ValueError(f"unknown report format: {fmt}")


def write_graph(lines: DataFrame, location: str) -> None:
    """Graph or tree lines (repo, line_no, text)."""
    write_report(lines, "txt", location, ["line_no"])


def write_vuln_report(findings: DataFrame, old: DataFrame, location: str) -> None:
    """Three JSON tables: summary, vulnerabilities, outdated_packages."""
    findings.write.json(f"{location}/vulnerabilities")
    old.write.json(f"{location}/outdated_packages")
    # the summary counts what was written instead of computing it again
    spark = findings.sparkSession
    written = spark.read.schema(findings.schema).json(f"{location}/vulnerabilities")
    listed = spark.read.schema(old.schema).json(f"{location}/outdated_packages")
    vuln_counts(written, listed).write.json(f"{location}/summary")
