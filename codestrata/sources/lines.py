"""Content exploded to numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codestrata.functions.text import scan_lines, split_lines


def explode_lines(files: DataFrame, model: str = "scan") -> DataFrame:
    """``files`` to ``lines(..., line_no, line)``; one row per line, no shuffle.

    ``scan`` strips terminators and knows no line after a final newline;
    ``split`` keeps carriage returns and the empty piece after a final newline.
    """
    array = {"scan": scan_lines, "split": split_lines}[model](F.col("content"))
    keep = [c for c in files.columns if c != "content"]
    return (
        files.select(*keep, F.posexplode(array).alias("_pos", "line"))
        .withColumn("line_no", (F.col("_pos") + 1).cast("long"))
        .drop("_pos")
    )
