"""Token estimates per text and file, and project statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions.text import scan_lines
from codestrata.functions.tokens import basic_estimate, estimate


def with_tokens(df: DataFrame, text_col: str, is_code: bool = False) -> DataFrame:
    return df.withColumn("tokens", estimate(F.col(text_col), is_code))


def with_basic_tokens(df: DataFrame, length_col: str) -> DataFrame:
    return df.withColumn("basic_tokens", basic_estimate(F.col(length_col)))


def _tokens_of(content: Column) -> Column:
    """Truncated estimate of each line plus one for its end."""
    per_line = F.transform(scan_lines(content), lambda x: estimate(x, is_code=True) + 1)
    return F.aggregate(per_line, F.lit(0).cast("long"), lambda a, n: a + n)


def file_tokens(files: DataFrame) -> DataFrame:
    """(repo, path, tokens), inside the file's row."""
    return files.select("repo", "path", _tokens_of(F.col("content")).alias("tokens"))


def project_stats(files: DataFrame) -> DataFrame:
    """Counts, sizes, tokens and bytes per repository.

    Size, tokens and bytes cover files with content; the file count covers all.
    """
    filled = F.octet_length("content") > 0
    facts = files.select(
        "repo", F.when(filled, F.col("size")).otherwise(0).alias("_size"),
        F.when(filled, _tokens_of(F.col("content"))).otherwise(0).alias("_tokens"),
        F.octet_length("content").cast("long").alias("_bytes"),
    )
    return facts.groupBy("repo").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("_size").alias("total_size"),
        F.sum("_tokens").alias("token_count"), F.sum("_bytes").alias("char_count"),
    ).withColumn("avg_file_size", F.floor(F.col("total_size") / F.greatest(F.col("file_count"), F.lit(1))).cast("long"))
