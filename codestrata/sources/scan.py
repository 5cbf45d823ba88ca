"""Directory trees as a table of files."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.operators.ordering import prefix
from codestrata.session import ship_package, stage

#: Folders that a task remembers to have made.
MOST_FOLDERS = 10_000
_ENTRY = "location string, folder boolean, size long, mode int, mtime timestamp, error string"
_ENTRY_KINDS = [pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.timestamp("us", "UTC"), pa.string()]
_ENTRY_NAMES = ["location", "folder", "size", "mode", "mtime", "error"]


def _list(root: str):
    """Entries of each folder; what cannot be listed is a row with its error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        local = isinstance(store, fs.LocalFileSystem)
        for b in batches:
            rows = []
            for folder in b.column("location").to_pylist():
                try:
                    entries = store.get_file_info(fs.FileSelector(folder))
                except OSError as e:
                    rows.append((folder, False, None, None, None, str(e)))
                    continue
                for x in entries:
                    mode, folder_inside = None, x.type == fs.FileType.Directory
                    if local:
                        found = os.lstat(x.path)
                        mode = stat.S_IMODE(found.st_mode)
                        if stat.S_ISLNK(found.st_mode) and folder_inside:
                            continue  # linked folders may lead back up
                    size = None if folder_inside else x.size
                    rows.append((x.path, folder_inside, size, mode, None if folder_inside else x.mtime, None))
            columns = zip(*rows) if rows else [[]] * len(_ENTRY_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _ENTRY_KINDS)], _ENTRY_NAMES)

    return run


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: hidden, underscore and empty ones too.

    Folders are listed level by level, each level in parallel.
    """
    ship_package(spark)
    _, base = fs.FileSystem.from_uri(root)
    level = spark.createDataFrame([(base,)], "location string")
    files = None
    while True:
        found = stage(level.repartition(F.col("location")).mapInArrow(_list(root), _ENTRY))
        here = found.filter("not folder").drop("folder")
        files = here if files is None else files.unionByName(here)
        level = found.filter("folder").select("location")
        if level.limit(1).count() == 0:
            return files


def _named(files: DataFrame, root: str, repo: str | None) -> DataFrame:
    _, base = fs.FileSystem.from_uri(root)
    relative = F.substring("location", F.lit(len(base.rstrip("/")) + 2), F.length("location"))
    if repo is not None:
        return files.withColumn("repo", F.lit(repo)).withColumn("path", relative)
    inner = F.instr(relative, "/")
    return files.withColumn("repo", F.left(relative, inner - 1)).withColumn(
        "path", F.substring(relative, inner + 1, F.length(relative))
    )


def scan_files(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """All files below ``root`` as ``files(repo, path, size, mode, mtime, content, error)``.

    With ``repo`` the whole tree is one repository; otherwise the first folder
    below ``root`` names it. ``mode`` is null where the store has none. Files and
    folders that cannot be read are rows with an ``error``. A content is one
    value; trees with files above 2 GiB are read with ``scan_chunks``.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                data, error = None, row.column("error")[0].as_py()
                if error is None:
                    try:
                        with store.open_input_stream(row.column("location")[0].as_py()) as f:
                            data = f.read()
                    except OSError as e:
                        error = str(e)
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in ("repo", "path", "size", "mode", "mtime")), pa.array([data], pa.binary()), pa.array([error], pa.string())],
                    ["repo", "path", "size", "mode", "mtime", "content", "error"],
                )

    named = _named(list_files(spark, root), root, repo).repartition(F.col("location"))
    return named.mapInArrow(
        read, "repo string, path string, size long, mode int, mtime timestamp, content binary, error string"
    ).withColumn("content", F.col("content").cast("string"))


def scan_chunks(spark: SparkSession, root: str, size: int, repo: str | None = None) -> DataFrame:
    """chunks(repo, path, chunk_no, offset, total, data, error) of all files, of any length.

    Each chunk is a range of its own that a task reads; an empty file has one
    empty chunk.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                data, error = None, row.column("error")[0].as_py()
                if error is None:
                    try:
                        with store.open_input_file(row.column("location")[0].as_py()) as f:
                            data = f.read_at(size, row.column("offset")[0].as_py())
                    except OSError as e:
                        error = str(e)
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in ("repo", "path", "chunk_no", "offset", "total")), pa.array([data], pa.binary()), pa.array([error], pa.string())],
                    ["repo", "path", "chunk_no", "offset", "total", "data", "error"],
                )

    last = F.floor(F.greatest(F.coalesce("size", F.lit(0)) - 1, F.lit(0)) / size).cast("long")
    ranges = (
        _named(list_files(spark, root), root, repo)
        .select("repo", "path", "location", "error", F.col("size").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_no"))
        .withColumn("offset", F.col("chunk_no") * size).repartition(F.col("location"), F.col("chunk_no"))
    )
    return ranges.mapInArrow(
        read, "repo string, path string, chunk_no long, offset long, total long, data binary, error string"
    )


def write_tree(files: DataFrame, root: str) -> None:
    """Write ``files(repo, path, content)`` as a directory tree, task by task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for b in batches:
            for repo, path, content in zip(*(b.column(c).to_pylist() for c in ("repo", "path", "content"))):
                target = f"{base}/{repo}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder)
                    if len(made) < MOST_FOLDERS:
                        made.add(folder)
                with store.open_output_stream(target) as f:
                    f.write(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    written = files.select("repo", "path", F.coalesce("content", F.lit("")).alias("content"))
    written.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def walk_positions(files: DataFrame) -> DataFrame:
    """Position of each file in its repository's walk (lexical per component)."""
    keyed = files.select("repo", "path", "size", F.split("path", "/").alias("_walk"))
    return prefix(keyed, ["repo"], ["_walk"]).withColumnRenamed("rank", "position").drop("_walk")
