"""Token ids as Parquet files that can be read in part.

One row per document, in ascending doc_id order over the files:

    doc_id      long
    n_tokens    long           with the end id
    start       long           ids of all documents before, in a table beside (see ``Layout``)
    ids         array<int>     dictionary or delta encoded

Row groups and pages are small enough that Parquet's column and offset indexes
let a reader fetch the metadata alone, or the ids of few documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codestrata.llm.tokens import encoder

#: Bytes of a row group and of a page, rows of a page.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 2000
_FILE_BITS = 33


@dataclass(frozen=True)
class Layout:
    """Where a token table lies: ids by file, and the ids before each file."""

    root: str

    @property
    def ids(self) -> str:
        return f"{self.root}/ids"

    @property
    def offsets(self) -> str:
        return f"{self.root}/offsets"


def write_ids(documents: DataFrame, tokenizer: str, root: str, end: int = 0, encoding: str = "dictionary") -> Layout:
    """Encode whole texts and write them in ascending doc_id order.

    Texts are range-partitioned and sorted before encoding, so ids do not move.
    Ties of doc_id are ordered by text; null ids come first; null texts are the
    end id alone. ``encoding`` is dictionary (bit-packed codes) or delta. A task
    that runs again rewrites its own file.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)
    layout, last = Layout(root), end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                made = [encode(t.as_py()) + last for t in b.column("text")]
                sizes = np.array([len(m) // 4 for m in made])
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(made), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("at"), pa.array(sizes, pa.int64()), ids], ["doc_id", "at", "n_tokens", "ids"]
                )

    ordered = (
        documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange("doc_id", F.crc32(F.col("text").cast("binary"))).sortWithinPartitions("doc_id", "text")
        .withColumn("at", F.monotonically_increasing_id())
    )
    (
        ordered.mapInArrow(run, "doc_id long, at long, n_tokens long, ids array<int>")
        .write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.dictionary.page.size", 1 << 20).option("compression", "zstd")
        .parquet(layout.ids)
    )
    files = documents.sparkSession.read.parquet(layout.ids).select("at", "n_tokens")
    per_file = files.groupBy(F.shiftright("at", _FILE_BITS).alias("file")).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    per_file.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.parquet(layout.offsets)
    return layout


def read_metadata(spark: SparkSession, layout: Layout) -> DataFrame:
    """(doc_id, start, n_tokens) of every document without reading ids."""
    rows = spark.read.parquet(layout.ids).select("doc_id", "at", "n_tokens").withColumn("file", F.shiftright("at", _FILE_BITS))
    inside = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(spark.read.parquet(layout.offsets), "file")
        .select("doc_id", "at", (F.col("before") + F.col("_in")).alias("start"), "n_tokens")
    )


def read_ids(spark: SparkSession, layout: Layout, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, at, ids) of the documents with first <= doc_id <= last; pages outside are skipped."""
    rows = spark.read.parquet(layout.ids)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.select("doc_id", "at", "ids")


def checksums(ids: DataFrame) -> DataFrame:
    """(at, ids_crc32, read_tokens) of rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [crc32(flat[a:z].tobytes()) for a, z in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("at"), pa.array(sums, pa.int64()), pa.array(np.diff(ends), pa.int64())], ["at", "ids_crc32", "read_tokens"]
            )

    return ids.select("at", "ids").mapInArrow(run, "at long, ids_crc32 long, read_tokens long")


def digests(spark: SparkSession, layout: Layout) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the written files."""
    return (
        read_metadata(spark, layout).join(checksums(read_ids(spark, layout)), "at")
        .select("doc_id", "start", F.col("read_tokens").alias("n_tokens"), "ids_crc32")
    )
