"""The entries of one large JSON object, split over tasks.

A byte range alone cannot tell whether it starts inside a string or how deep it
is nested. Each range is therefore summarised first by what it does to both
possible states (quotes change sides, brackets change depth); prefix sums over
the ranges give every range its true start, and a second pass cuts the entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codestrata.session import ship_package, stage

SPLIT = 64 * 2**20
_BLOCK = 1 << 22
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
_OPEN, _CLOSE = np.frombuffer(b"{[", np.uint8), np.frombuffer(b"}]", np.uint8)


def _slashes_before(f: pa.NativeFile, at: int) -> int:
    """Length of the run of backslashes that ends in front of ``at``."""
    run = 0
    while at > 0:
        back = f.read_at(min(4096, at), max(0, at - 4096))
        kept = len(back.rstrip(b"\\"))
        run += len(back) - kept
        if kept:
            break
        at -= len(back)
    return run


def _marks(f: pa.NativeFile, start: int, stop: int, block: int = _BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and codes of quotes, brackets and commas that no backslash escapes, block by block."""
    run = _slashes_before(f, start)
    while start < stop:
        codes = np.frombuffer(f.read_at(min(block, stop - start), start), np.uint8)
        if not len(codes):
            return
        # length of the run of backslashes in front of every byte
        at = np.arange(len(codes))
        other = np.maximum.accumulate(np.where(codes != _BACKSLASH, at, -1))
        before = np.r_[-1, other[:-1]]
        length = at - 1 - before + np.where(before < 0, run, 0)
        wanted = np.isin(codes, [_QUOTE, _COMMA, *_OPEN, *_CLOSE]) & (length % 2 == 0)
        run = int(len(codes) - 1 - other[-1] + (run if other[-1] < 0 else 0))
        where = np.flatnonzero(wanted)
        yield where + start, codes[where]
        start += len(codes)


def _turns(codes: np.ndarray) -> np.ndarray:
    return np.isin(codes, _OPEN).astype(np.int64) - np.isin(codes, _CLOSE)


def _summary(f: pa.NativeFile, start: int, stop: int) -> tuple[int, int, int]:
    """Quotes, and change of depth if the range starts outside or inside a string."""
    quotes, depth = 0, [0, 0]
    for _, codes in _marks(f, start, stop):
        side = quotes + np.cumsum(codes == _QUOTE)
        turns = _turns(codes)
        for state in (0, 1):
            depth[state] += int(turns[(side + state) % 2 == 0].sum())
        quotes = int(side[-1]) if len(side) else quotes
    return quotes, depth[0], depth[1]


def _cuts(f: pa.NativeFile, start: int, stop: int, size: int, side: int, depth: int) -> Iterator[tuple[int, bool]]:
    """Positions that part entries, and whether an entry may begin behind them, from ``start`` on.

    The last entry may end far behind ``stop``; no more is read at a time than the range is long.
    """
    for where, codes in _marks(f, start, size, min(_BLOCK, max(1, stop - start))):
        sides = side + np.cumsum(codes == _QUOTE)
        turns = np.where(sides % 2 == 0, _turns(codes), 0)
        depths = depth + np.cumsum(turns)
        plain = sides % 2 == 0
        begins = plain & (depths == 1) & ((codes == _COMMA) | (turns == 1))
        ends = plain & (depths == 0) & (turns == -1)
        for i in np.flatnonzero(begins | ends):
            yield int(where[i]), bool(begins[i])
        if len(codes):
            side, depth = int(sides[-1]), int(depths[-1])


def _entries(f: pa.NativeFile, start: int, stop: int, size: int, side: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """Entries that begin in the range, each read as far as it goes."""
    begun = None
    for at, begins in _cuts(f, start, stop, size, side, depth):
        if begun is not None:
            yield begun, f.read_at(at - begun - 1, begun + 1)
        begun = at if begins and at < stop else None
        if begun is None and at >= stop:
            return


def json_entries(spark: SparkSession, path: str, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Entries (file, at, entry) of the JSON object in each file, and (file, whole) of all files.

    ``path`` is a file or a folder of files, those that begin with ``_`` or ``.``
    left out. An entry is its text ``"key": value``;
    one entry is held at a time, never the object. ``whole`` tells whether quotes
    and brackets of the file are balanced; a file that does not start with ``{``
    is not whole. Text behind the object is not looked at.
    """
    ship_package(spark)
    store, base = fs.FileSystem.from_uri(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [
        x for x in store.get_file_info(fs.FileSelector(base, recursive=True))
        if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))
    ]
    # narrow rows that stand for much work: a given number of tasks is not joined to fewer
    pieces, cores = sum(max(1, -(-x.size // split)) for x in found), spark.sparkContext.defaultParallelism
    tasks = max(1, min(pieces, max(4 * cores, sum(x.size for x in found) // SPLIT)))
    files = spark.createDataFrame([(x.path, x.size) for x in found], "file string, size long")
    ranges = files.select(
        "file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start")
    ).withColumn("stop", F.least(F.col("start") + split, "size"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_file(row["file"]) as f:
                    made = _summary(f, row["start"], row["stop"])
                    # white space in front of the object
                    opens = row["start"] > 0 or f.read_at(min(row["size"], 4096), 0).lstrip().startswith(b"{")
                yield pa.RecordBatch.from_pylist([{**row, **dict(zip(("quotes", "outside", "inside"), made)), "opens": opens}])

    kinds = "file string, size long, start long, stop long, quotes long, outside long, inside long, opens boolean"
    summaries = stage(ranges.repartition(tasks, "file", "start").mapInArrow(summarise, kinds))
    # one row per range: a file of a terabyte has some ten thousand
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sided = summaries.withColumn("side", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).withColumn(
        "turn", F.when(F.col("side") == 0, F.col("outside")).otherwise(F.col("inside"))
    )
    placed = sided.withColumn("depth", F.coalesce(F.sum("turn").over(earlier), F.lit(0)))
    whole = placed.groupBy("file").agg((
        (F.sum("quotes") % 2 == 0) & (F.sum("turn") == 0) & F.bool_and("opens")
    ).alias("whole"))

    def batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["file", "at", "entry"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for b in batches:
            for row in b.to_pylist():
                held: list[tuple[str, int, str]] = []
                bytes_held = 0
                with store.open_input_file(row["file"]) as f:
                    for at, text in _entries(f, row["start"], row["stop"], row["size"], row["side"], row["depth"]):
                        if text.strip():
                            held.append((row["file"], at, text.decode("utf-8", "replace")))
                            bytes_held += len(text)
                        if bytes_held > _BLOCK:
                            yield batch(held)
                            held, bytes_held = [], 0
                yield batch(held)

    located = placed.select("file", "size", "start", "stop", "side", "depth").repartition(tasks, "file", "start")
    return located.mapInArrow(cut, "file string, at long, entry string"), whole
