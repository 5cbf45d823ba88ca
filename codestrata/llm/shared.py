"""Helpers of several operators: sorted groups in tasks, components of a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codestrata.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_place(rows: DataFrame) -> DataFrame:
    """(row, file, at): each row as one struct, with a place that is the same at every reading.

    Rows of files are known by a hash of the file's path and their index in it;
    rows that come from elsewhere are written first. Rows that a join makes from
    one row of a file share its place.
    """
    def placed(given: DataFrame) -> DataFrame:
        file = given.metadataColumn("_metadata")
        columns = [F.col("`" + c.replace("`", "``") + "`") for c in given.columns]
        return given.select(F.struct(*columns).alias("row"), F.xxhash64(file["file_path"]).alias("file"), file["row_index"].alias("at"))

    try:
        return placed(rows)
    except AnalysisException:
        return placed(stage(rows))


#: Bits of the table that tells which keys certainly have no partner; its size does not grow with the data.
MARKS = 1 << 25


def split_marked(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(may, not): the rows that may have a partner in ``keys``, and those that certainly have none.

    Each key sets one of MARKS bits, kept as at most MARKS / 64 words, which are
    broadcast. So rows without partner are told apart before an exchange, except
    the share whose bit is set by another key. ``rows`` is read once for each part.
    """
    def word(k: Column) -> Column:
        return F.shiftright(F.pmod(F.xxhash64(k), F.lit(MARKS)), 6)

    def bit(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(k), F.lit(64)).cast("int"))

    marks = stage(keys.groupBy(word(F.col(key)).alias("_word")).agg(F.bit_or(bit(F.col(key))).alias("_bits")))
    checked = rows.withColumn("_at", word(F.col(key))).join(F.broadcast(marks), F.col("_at") == F.col("_word"), "left")
    met = F.coalesce(F.col("_bits").bitwiseAND(bit(F.col(key))) != 0, F.lit(False))
    return checked.filter(met).select(*rows.columns), checked.filter(~met).select(*rows.columns)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys``, over batch borders.

    The input is sorted by its keys within the task. Keys are longs without
    nulls. At most one group and one batch are held.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def split_large(rows: DataFrame, keys: list[str], limit: int, order: Column, weight: Column | None = None) -> DataFrame:
    """Deal groups of more than ``limit`` rows over several tasks without losing a pair.

    A group of n rows is cut by the hash of ``order`` into c = ceil(n / limit)
    chunks; each unordered pair of chunks becomes a group of its own. Adds
    ``chunk_a`` <= ``chunk_b`` (both 0 for small groups) and ``chunk``, the
    chunk of the row: pairs inside a chunk are looked at where chunk_a = chunk_b,
    pairs across chunks where they differ. Given ``weight``, its sum counts
    instead of rows.
    """
    large = (
        rows.groupBy(*keys).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n")).filter(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_c"))
    )
    joined = rows.join(large, keys, "left")
    chunk = F.when(F.col("_c").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(order, F.lit(7)), F.col("_c"))).cast("int")
    others = F.when(F.col("_c").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_c") - 1))
    return (
        joined.withColumn("chunk", chunk)
        .withColumn("_other", F.explode(others))
        .withColumn("chunk_a", F.least("chunk", "_other"))
        .withColumn("chunk_b", F.greatest("chunk", "_other"))
        .drop("_c", "_other")
    )


#: A key with more than this share of the rows is joined by broadcast; there are fewer than 1 / share of them.
HOT_SHARE = 0.001


def join_counted(rows: DataFrame, facts: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Left join of ``rows`` to one row of ``facts`` per key, whatever share of the rows a key holds.

    ``facts`` has every ``key`` of the rows (null is a key like any other),
    ``values`` and ``_rows``, the number of rows with that key. Keys above HOT_SHARE of all
    rows are fewer than a thousand by that definition and are broadcast; all other
    keys meet in an exchange, where none can be hot. Both inputs should be
    written tables: they are read twice.
    """
    total = facts.agg(F.sum("_rows")).first()[0] or 0
    known = facts.select(F.col(key).alias("_key"), *values, (F.col("_rows") > HOT_SHARE * total).alias("_hot"))
    hot = known.filter("_hot").select(F.col("_key").alias("_hot_key"), F.struct(*values).alias("_facts"))
    marked = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left")
    found = marked.filter("_facts is not null").select(*rows.columns, *[F.col("_facts")[v].alias(v) for v in values])
    rest = marked.filter("_facts is null").select(*rows.columns)
    joined = rest.join(known.filter("not _hot"), F.col(key).eqNullSafe(F.col("_key")), "left").select(*rows.columns, *values)
    return found.unionByName(joined)


#: Narrow rows that make a task of their own in steps that follow each other; fewer rows have FEW_TASKS tasks at most.
TASK_ROWS, FEW_TASKS = 50_000, 12


def tasks_for(rows: int) -> int:
    """Tasks that steps over so many narrow rows need, however many shuffle partitions the session has."""
    return max(FEW_TASKS, -(-rows // TASK_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has long columns a and b. Rounds of hooking to the smallest
    neighbouring label and pointer jumping; each needs joins on a node and
    minima per node only, so no node's neighbours meet in one task. Every round
    is written to the shared folder; the last looks only whether a label has a
    smaller neighbour. Tasks follow the number of edges, not the session's number
    of shuffle partitions, since the driver keeps something of each task of each
    round. Returns (node, component).
    """
    both = stage(
        edges.filter("a is not null and b is not null and a != b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b").distinct()
    )
    tasks = tasks_for(both.count())
    labels = stage(
        both.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("_least"))
        .select("node", F.least("node", "_least").alias("label")).coalesce(tasks)
    )
    while True:
        nearest = (
            both.join(labels, both.a == labels.node).coalesce(tasks).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("_near"))
        )
        now = stage(labels.join(nearest, "node").select("node", "label", "_near").coalesce(tasks))
        if not now.agg(F.max(F.col("_near") < F.col("label"))).first()[0]:
            return labels.withColumnRenamed("label", "component")
        least = F.least("label", "_near").alias("label")
        hooked = (
            now.select(F.explode(F.array(F.struct("node", least), F.struct(F.col("label").alias("node"), least))).alias("e"))
            .groupBy("e.node").agg(F.min("e.label").alias("label"))
        )
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        labels = stage(hooked.coalesce(tasks).join(up, "label").select("node", F.col("_up").alias("label")).coalesce(tasks))
