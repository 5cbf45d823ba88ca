"""Package manifests: JSON sections and line-oriented section files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions.carry import NO_CHANGE, carry_forward
from codestrata.functions.text import split_lines, trim


def json_maps(content: Column, fields: list[str]) -> Column:
    """Struct of map<string,variant>, one per field; null where a field is
    missing, is no object, or the document does not parse."""
    schema = ", ".join(f"`{f}` map<string,variant>" for f in fields)
    return F.from_json(content, schema)


def string_values(section: Column) -> Column:
    """Only the entries whose value is a string, as map<string,string>."""
    texts = F.map_filter(section, lambda _, v: F.schema_of_variant(v) == "STRING")
    return F.transform_values(texts, lambda _, v: F.variant_get(v, "$", "string"))


def json_section(files: DataFrame, field: str) -> DataFrame:
    """(repo, path, name, version) of one object section."""
    section = string_values(json_maps(F.col("content"), [field])[field])
    return files.select("repo", "path", F.explode(section).alias("name", "version"))


def numbered_lines(content: Column) -> Column:
    """Trimmed lines as array<struct<line_no, line>>."""
    return F.transform(
        split_lines(content),
        lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), trim(x).alias("line")),
    )


def section_lines(content: Column, marker) -> Column:
    """Trimmed lines with the section they are in, without the header lines.

    ``marker(line)`` gives a one-letter state for a section header, or null for
    any other line. Result: array<struct<line_no, line, section>>.
    """
    lines = F.transform(split_lines(content), trim)
    marks = F.transform(lines, lambda x: F.coalesce(marker(x), F.lit(NO_CHANGE)))
    rows = F.transform(
        F.arrays_zip(lines.alias("line"), marks.alias("mark"), carry_forward(marks).alias("section")),
        lambda x, i: F.struct(
            (i + 1).cast("long").alias("line_no"), x["line"].alias("line"),
            x["mark"].alias("mark"), x["section"].alias("section"),
        ),
    )
    return F.filter(rows, lambda x: x["mark"] == NO_CHANGE)
