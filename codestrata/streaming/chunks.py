"""Fixed-size chunks of files, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

CHUNK = 10 * 2**20          # fixed value: default chunk size
LARGE_FILE = 100 * 2**20    # usual value: files above this are counted as large


def chunk_files(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunks(repo, path, chunk_no, offset, total, data).

    An empty file gives one empty chunk. The chunks of a file are cut as one
    array before the explode, so the content is not copied once per chunk.
    """
    data = F.col("content").cast("binary")
    total = F.octet_length(data).cast("long")
    numbers = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(total - 1, F.lit(0)) / size).cast("long"))
    cut = F.transform(
        numbers,
        lambda n: F.struct(
            n.alias("chunk_no"), (n * size).alias("offset"),
            F.substring(data, (n * size + 1).cast("int"), F.lit(size)).alias("data"),
        ),
    )
    return files.select("repo", "path", total.alias("total"), F.inline(cut)).select(
        "repo", "path", "chunk_no", "offset", "total", "data"
    )


def checked_chunks(files: DataFrame, size: int = CHUNK, limit: int | None = None) -> DataFrame:
    """``chunk_files`` with a column ``error``; a file without content or above ``limit`` bytes is one row with its error."""
    data = F.col("content").cast("binary")
    total = F.octet_length(data).cast("long")
    error = F.when(data.isNull(), "no content")
    if limit is not None:
        error = error.when(total > limit, F.format_string(f"%d bytes are above the limit of {limit}", total))
    known = files.select("repo", "path", "content", total.alias("total"), error.alias("error"))
    last = F.floor(F.greatest(F.col("total") - 1, F.lit(0)) / size).cast("long")
    numbers = F.when(F.col("error").isNull(), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array(F.lit(0).cast("long")))
    cut = F.transform(numbers, lambda n: F.struct(
        n.alias("chunk_no"), (n * size).alias("offset"),
        F.when(F.col("error").isNull(), F.substring(data, (n * size + 1).cast("int"), F.lit(size))).alias("data"),
    ))
    return known.select("repo", "path", "total", "error", F.inline(cut)).select(
        "repo", "path", "chunk_no", "offset", "total", "data", "error"
    )


def streaming_stats(chunks: DataFrame, large: int = LARGE_FILE) -> DataFrame:
    """Running totals per repository; works on a batch and on a stream."""
    first = F.col("chunk_no") == 0
    return chunks.groupBy("repo").agg(
        F.count_if(first).alias("files"),
        F.sum(F.octet_length("data").cast("long")).alias("bytes"),
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(first & (F.col("total") > large)).alias("large_files"),
    )


def stream_chunks(
    files: DataFrame, location: str, checkpoint: str, size: int = CHUNK, on_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Process the files available now, in micro-batches, and stop.

    ``files`` is a streaming table of files. Chunks go to ``location`` as
    Parquet; ``on_batch`` gets each micro-batch of chunks instead. Running it
    again with the same checkpoint picks up only files that arrived since.
    """
    writer = chunk_files(files, size).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if on_batch is not None:
        return writer.foreachBatch(on_batch).start()
    return writer.format("parquet").outputMode("append").start(location)


def stream_stats(
    files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, size: int = CHUNK, large: int = LARGE_FILE,
) -> StreamingQuery:
    """Running totals of a streaming table of files; ``sink`` gets the changed rows
    of each micro-batch."""
    return (
        streaming_stats(chunk_files(files, size), large).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    )
