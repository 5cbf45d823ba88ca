"""Ranks and running sums over groups of any size.

A window per group would put a whole group into one task. Here the rows are
range-partitioned by (group, order), so a large group spreads over many
partitions; each partition numbers its own rows and a small table of
per-partition totals supplies the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.session import stage

_PARTITION_BITS = 33  # rows of one partition share the upper bits of the id


def prefix(df: DataFrame, by: list[str], order: list[str], value: Column | None = None) -> DataFrame:
    """Add ``rank`` (1-based) and, with ``value``, the inclusive ``running`` sum.

    ``order`` must make rows unique within a group. The ordered rows are staged
    once, because the offsets and the rows must come from the same partitioning.
    """
    numbered = df.withColumn("_value", F.lit(1).cast("long") if value is None else value.cast("long"))
    numbered = stage(
        numbered.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", _PARTITION_BITS))

    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = numbered.groupBy(*by, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_sum")
    )
    # at most one row per (group, partition)
    offsets = pieces.select(
        *by, "_part", "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_before"),
    )
    out = numbered.join(offsets, [*by, "_part"]).withColumn(
        "rank", F.col("_rows_before") + F.col("_at") - F.col("_first") + 1
    )
    if value is not None:
        inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("running", F.col("_sum_before") + F.sum("_value").over(inside))
    return out.drop("_value", "_at", "_part", "_first", "_rows_before", "_sum_before")


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``.

    For small ``n`` Spark limits every partition before the exchange; larger
    ``n`` uses the range-partitioned rank.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n <= limit:
        window = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= n)
    keys = [f"_key{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order)))
    return prefix(keyed, by, keys).filter(F.col("rank") <= n).drop(*keys)
