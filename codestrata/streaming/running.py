"""Running statistics of a stream of chunks, kept as state per repository."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from codestrata.streaming.chunks import LARGE_FILE

#: Errors that a summary shows (fixed value), and slices of a repository's state.
SHOWN, SLICES = 5, 32
_NUMBERS = ["files", "bytes", "chunks", "large_files", "errors"]
_EVENT = "at timestamp, text string"
_OUT = (
    "repo string, slice int, files long, bytes long, chunks long, large_files long, errors long, "
    f"first_at timestamp, last_at timestamp, first_errors array<struct<at:timestamp,text:string>>, large_names array<string>"
)


class _Keeper(StatefulProcessor):
    """State of one slice of a repository: sums, times, the first errors and the names of large files."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", ", ".join(f"{n} long" for n in _NUMBERS) + ", first_at timestamp, last_at timestamp")
        self.failed = handle.getListState("failed", _EVENT)
        self.large = handle.getListState("large", "path string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.sums.get() if self.sums.exists() else None
        sums, times = list(held[:5]) if held else [0] * 5, list(held[5:]) if held else []
        failed = [(r[0], r[1]) for r in self.failed.get()] if self.failed.exists() else []
        fresh: list[str] = []
        for pdf in rows:
            good, bad = pdf[pdf["error"].isna()], pdf[pdf["error"].notna()]
            first = good[good["first"]]
            large = first[first["large"]]
            for i, n in enumerate((len(first), int(good["bytes"].sum()), len(good), len(large), len(bad))):
                sums[i] += n
            fresh += large["path"].tolist()
            failed += zip(bad["at"], bad["path"] + ": " + bad["error"])
            times += [pdf["at"].min(), pdf["at"].max()]
        failed = sorted(failed)[:SHOWN]
        times = [min(times), max(times)]
        self.sums.update((*sums, *times))
        if failed:
            self.failed.put(failed)
        if fresh:
            self.large.appendList([(p,) for p in fresh])
        names = sorted(r[0] for r in self.large.get()) if self.large.exists() else []
        yield pd.DataFrame({
            "repo": [key[0]], "slice": [key[1]], **{n: [v] for n, v in zip(_NUMBERS, sums)},
            "first_at": [times[0]], "last_at": [times[1]],
            "first_errors": [[{"at": a, "text": t} for a, t in failed]], "large_names": [names],
        })

    def close(self) -> None:
        pass


def running_stats(chunks: DataFrame, at: Column | None = None, large: int = LARGE_FILE, slices: int = SLICES) -> DataFrame:
    """Changed rows (repo, slice, sums, times, errors, names) of each micro-batch.

    ``chunks`` is a stream (repo, path, chunk_no, offset, total, data, error); ``at``
    is the time of a row, by default when it is processed. State is kept per slice
    of a repository (by path), so a repository of any size spreads over the
    cluster; ``newest`` and ``merged`` put slices together. Only lengths and names
    reach the state, never data. An error is a row, not a file or a chunk. A file
    counts, and is large or not, with the row of its beginning; a chunk that arrives
    in two ranges counts twice.
    """
    spark = chunks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    narrow = chunks.select(
        "repo", F.pmod(F.xxhash64("path"), F.lit(slices)).cast("int").alias("slice"), "path",
        F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("bytes"), (F.col("offset") == 0).alias("first"),
        F.coalesce(F.col("total") > large, F.lit(False)).alias("large"), "error",
        (F.current_timestamp() if at is None else at).alias("at"),
    )
    return narrow.groupBy("repo", "slice").transformWithStateInPandas(
        statefulProcessor=_Keeper(), outputStructType=_OUT, outputMode="Update", timeMode="None"
    )


def newest(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The last row of each slice, of rows collected from many micro-batches."""
    kept = [c for c in rows.columns if c not in ("repo", "slice", batch)]
    return rows.groupBy("repo", "slice").agg(F.max_by(F.struct(*kept), batch).alias("_s")).select("repo", "slice", "_s.*")


def merged(rows: DataFrame) -> DataFrame:
    """One row per repository: sums, elapsed seconds, bytes per second, the first errors, names of large files."""
    whole = rows.groupBy("repo").agg(
        *[F.sum(n).alias(n) for n in _NUMBERS], F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.slice(F.array_sort(F.flatten(F.collect_list("first_errors"))), 1, SHOWN).alias("_errors"),
        F.array_sort(F.flatten(F.collect_list("large_names"))).alias("large_names"),
    )
    elapsed = (F.unix_micros("last_at") - F.unix_micros("first_at")) / 1e6
    return whole.select(
        "repo", *_NUMBERS, elapsed.alias("elapsed_sec"),
        F.when(elapsed > 0, F.col("bytes") / elapsed).otherwise(0.0).alias("bytes_per_sec"),
        F.transform("_errors", lambda e: e["text"]).alias("first_errors"), "large_names",
    )


def summary_text(stats: DataFrame) -> DataFrame:
    """(repo, text): the statistics as a short report."""
    megabyte = 1024.0 * 1024.0
    lines = [
        F.lit("Streaming Analysis Summary:\n"),
        F.format_string("  Files Processed: %d\n", "files"),
        F.format_string("  Bytes Processed: %d (%.2f MB)\n", F.col("bytes"), F.col("bytes") / megabyte),
        F.format_string("  Chunks Processed: %d\n", "chunks"),
        F.format_string("  Large Files: %d\n", "large_files"),
        F.format_string("  Elapsed Time: %.3fs\n", "elapsed_sec"),
        F.format_string("  Throughput: %.2f MB/s\n", F.col("bytes_per_sec") / megabyte),
        F.when(F.col("errors") > 0, F.concat(
            F.format_string("\nErrors (%d):\n", "errors"),
            F.array_join(F.transform("first_errors", lambda e: F.concat(F.lit("  - "), e, F.lit("\n"))), ""),
            F.when(F.col("errors") > SHOWN, F.format_string("  ... and %d more\n", F.col("errors") - SHOWN)).otherwise(""),
        )).otherwise(""),
    ]
    return stats.select("repo", F.concat(*lines).alias("text"))


def stream_running_stats(
    stats: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
) -> StreamingQuery:
    """Run ``running_stats`` over what is there now; ``sink`` gets the changed rows of each micro-batch."""
    return (
        stats.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(sink).start()
    )
