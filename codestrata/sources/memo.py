"""Detection memo: a table keyed by path, size and modification time.

The table is bucketed and sorted by its key, so neither the check for repeated
keys nor a join by the key moves memo rows: only the files of a run are
exchanged, to the memo's buckets.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

MEMO_SCHEMA = "repo string, path string, size bigint, mtime timestamp, is_binary boolean"
_KEY = ["repo", "path", "size", "mtime"]
#: Buckets of a memo; for a thousand million files a thousand or more are better.
BUCKETS = 64


def _memo_table(spark: SparkSession, location: str, buckets: int) -> str:
    """Name of the external table over ``location``, known to the session from here on.

    A memo with another number of buckets lies in another folder, so it is not seen.
    """
    folder = f"{location.rstrip('/')}/by_key_{buckets}"
    name = f"memo_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"
    key, quoted = ", ".join(_KEY), folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"create table if not exists {name} ({MEMO_SCHEMA}) using parquet "
        f"clustered by ({key}) sorted by ({key}) into {buckets} buckets location '{quoted}'"
    )
    # files of another session, and a relation of its own: frames loaded earlier keep their files
    spark.catalog.refreshTable(name)
    return name


def load_memo(spark: SparkSession, location: str, buckets: int = BUCKETS) -> DataFrame:
    """The memo with one row per key, empty where none was saved yet."""
    saved = spark.table(_memo_table(spark, location, buckets))
    # an append that ran twice leaves a key twice
    return saved.groupBy(*_KEY).agg(F.max("is_binary").alias("is_binary"))


def save_memo(fresh: DataFrame, location: str, buckets: int = BUCKETS) -> None:
    """Append newly classified files, one file per bucket."""
    name = _memo_table(fresh.sparkSession, location, buckets)
    rows = fresh.select(*(F.col(c).cast(t) for c, t in (field.split() for field in MEMO_SCHEMA.split(", "))))
    rows.repartition(buckets, *_KEY).write.insertInto(name)
