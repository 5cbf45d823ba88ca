"""Files of any length as byte ranges, in batch and as a stream that follows growing files.

A data source for ``spark.read`` and ``spark.readStream``:

    spark.dataSource.register(ByteRanges)
    spark.readStream.format("byte_ranges").option("chunk", 10485760).load(root)

Each row is one chunk, read by its own seek, so no file is ever one value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from codestrata.session import ship_package
from codestrata.streaming.chunks import CHUNK

#: Bytes and files that one task reads by default, and tasks; above them a task reads more.
SPLIT_BYTES, SPLIT_FILES, MOST_TASKS = 128 * 2**20, 1000, 256
#: Bytes and rows that a task hands over at once.
BATCH_BYTES, BATCH_ROWS = 2**20, 1000
_SCHEMA = "repo string, path string, chunk_no long, offset long, total long, data binary, error string"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]


@dataclass
class Ranges(InputPartition):
    """(file, from, to, size) ranges of one task."""

    ranges: list[tuple[str, int, int, int]] = field(default_factory=list)


class _Layout:
    """Options of the source and what both readers share."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.chunk = int(options.get("chunk", CHUNK))
        self.split = int(options.get("split", SPLIT_BYTES))
        self.repo = options.get("repo")
        if self.chunk < 1 or self.split < 1:
            raise ValueError("chunk and split are sizes in bytes, at least 1")

    def sizes(self) -> dict[str, int]:
        """Present size of every file below the root, by its path from there."""
        store, base = fs.FileSystem.from_uri(self.root)
        base = base.rstrip("/")
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return {x.path[len(base) + 1 :]: x.size for x in found if x.type == fs.FileType.File}

    def deal(self, ranges: Iterable[tuple[str, int, int, int]]) -> list[Ranges]:
        """Ranges cut where chunks begin and dealt to tasks of about ``split`` bytes.

        A file is read by several tasks from ``split`` bytes on. Of many files a task
        gets as many pieces as keep the tasks within MOST_TASKS, a large file apart.
        """
        ranges = list(ranges)
        step = max(1, self.split // self.chunk) * self.chunk
        whole = sum(end - start for _, start, end, _ in ranges)
        most_bytes = max(self.split, -(-whole // MOST_TASKS))
        most_files = max(SPLIT_FILES, -(-len(ranges) // MOST_TASKS))
        step = max(step, most_bytes // step * step)
        out, held = [], 0
        for file, start, end, size in ranges:
            while True:
                stop = min(end, (start // step + 1) * step)
                if not out or held + (stop - start) > most_bytes or len(out[-1].ranges) >= most_files:
                    out.append(Ranges())
                    held = 0
                out[-1].ranges.append((file, start, stop, size))
                held += stop - start
                start = stop
                if start >= end:
                    break
        return out or [Ranges()]

    def rows(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(self.root)
        held, bytes_held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), _KINDS)], _NAMES)

        for row in self._chunks(store, base.rstrip("/"), part):
            held.append(row)
            bytes_held += len(row[5] or b"")
            if bytes_held >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield batch()
                held, bytes_held = [], 0
        if held:
            yield batch()

    def _chunks(self, store: fs.FileSystem, base: str, part: Ranges) -> Iterator[tuple]:
        for file, start, end, size in part.ranges:
            repo, _, path = (self.repo, "", file) if self.repo is not None else file.partition("/")
            at = start
            try:
                with store.open_input_file(f"{base}/{file}") as f:
                    while at < end or at == start == end:
                        stop = min(end, (at // self.chunk + 1) * self.chunk)
                        data = f.read_at(stop - at, at)
                        if len(data) < stop - at:
                            raise OSError(f"{stop - at - len(data)} bytes are gone")
                        yield repo, path, at // self.chunk, at, size, data, None
                        at = stop
                        if at >= end:
                            break
            except OSError as e:
                yield repo, path, at // self.chunk, at, size, None, str(e)


class _Batch(DataSourceReader):
    def __init__(self, layout: _Layout):
        self.layout = layout

    def partitions(self) -> list[Ranges]:
        return self.layout.deal((f, 0, n, n) for f, n in sorted(self.layout.sizes().items()))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return self.layout.rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are the bytes known of every file, so each range is read once.

    A file that became shorter was replaced and is read from its beginning.
    """

    def __init__(self, layout: _Layout):
        self.layout = layout

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": dict(sorted(self.layout.sizes().items()))}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        before = start["files"]

        def fresh() -> Iterator[tuple[str, int, int, int]]:
            for file, size in end["files"].items():
                known = before.get(file, -1)
                if size != known:
                    yield file, known if 0 <= known < size else 0, size, size

        return self.layout.deal(fresh())

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return self.layout.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held between batches."""


class ByteRanges(DataSource):
    """Options: path, chunk (bytes), split (bytes of a task), repo (else the first folder names it).

    Rows (repo, path, chunk_no, offset, total, data, error). An empty file has one
    empty chunk; a range that cannot be read is a row with ``error`` and no data.
    The driver holds a path and a size for each file: the source is meant for large
    files; trees of very many small ones are listed in parallel by ``scan_chunks``.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Layout(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Layout(self.options))


def _options(root: str, chunk: int, split: int | None, repo: str | None) -> dict[str, str]:
    given = {"path": root, "chunk": str(chunk), "split": None if split is None else str(split), "repo": repo}
    return {k: v for k, v in given.items() if v is not None}


def read_ranges(spark: SparkSession, root: str, chunk: int = CHUNK, split: int | None = None, repo: str | None = None) -> DataFrame:
    """Chunks of every file below ``root``."""
    ship_package(spark)
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").options(**_options(root, chunk, split, repo)).load()


def stream_ranges(spark: SparkSession, root: str, chunk: int = CHUNK, split: int | None = None, repo: str | None = None) -> DataFrame:
    """Streaming chunks of the files below ``root``: what is there, then what is appended."""
    ship_package(spark)
    spark.dataSource.register(ByteRanges)
    return spark.readStream.format("byte_ranges").options(**_options(root, chunk, split, repo)).load()
