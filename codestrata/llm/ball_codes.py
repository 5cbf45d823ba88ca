"""Vector codes by ball k-means, one codebook per part of the vectors, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codestrata.llm.shared import join_counted
from codestrata.session import scratch_path, stage

#: Vectors of a block, a row of the written tables.
BLOCK = 1 << 14
#: Distances of parts stay below it, so doubles hold them exactly.
_EXACT = 1 << 53
_BLOCKS = "size long, ids binary, known binary, labels binary, labelled binary, vectors binary, codes binary"


def kept_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, vector) of the rows that take part, and their length.

    Null vectors and those with null or non-finite components are dropped, so are
    vectors of another length than the most frequent one (of equally frequent
    lengths the longest). The length is 0 if nothing is left.
    """
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    ).filter("vector is not null and forall(vector, x -> x is not null and abs(x) < double('infinity'))")
    sizes = rows.groupBy(F.size("vector").alias("size")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    width = top["size"] if top else 0
    return rows.filter(F.size("vector") == width), width


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 32-bit integers."""
    y = np.floor(values * float(scale))
    if y.size and np.abs(y).max() >= 1 << 31:
        raise ArithmeticError("a scaled component leaves 32 bits; take a smaller scale")
    return y.astype("<i4")


def _padded(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(n, parts, size): equal consecutive parts, the last one filled with zeros if need be."""
    n, d = vectors.shape
    size = -(-d // parts)
    out = np.zeros((n, parts * size))
    out[:, :d] = vectors
    return out.reshape(n, parts, size)


def full_search(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Nearest entry of every row, the lowest of equally near ones."""
    code = np.empty(len(x), np.int64)
    squares = (book * book).sum(1)
    for at in range(0, len(x), 4096):
        code[at : at + 4096] = (squares - 2 * (x[at : at + 4096] @ book.T)).argmin(1)
    return code


def ball_search(x: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Nearest entry of every row, given any earlier assignment ``code``.

    The rows of an entry are its ball. With d the distance of a row to its entry,
    an entry farther than 2 d from that entry is farther from the row than d, so:
    entries beyond twice the ball's radius are no neighbours; rows whose 2 d does
    not reach the nearest neighbour are the stable core and keep their entry; the
    others lie in rings between the distances of successive neighbours and are
    compared with the neighbours up to their ring only. Ties go to the lower index.
    """
    out = code.copy()
    squares = (book * book).sum(1)
    between = squares[:, None] + squares[None, :] - 2 * (book @ book.T)
    own = ((x - book[code]) ** 2).sum(1)
    order = np.lexsort((own, code))
    edges = np.searchsorted(code[order], np.arange(len(book) + 1))
    for e in np.flatnonzero(np.diff(edges)):
        rows = order[edges[e] : edges[e + 1]]
        reach = 4 * own[rows]
        near = np.flatnonzero(between[e] <= reach[-1])
        near = near[near != e]
        if not len(near):
            continue
        near = near[np.argsort(between[e, near], kind="stable")]
        rings = np.searchsorted(between[e, near], reach, side="right")
        first = int(np.searchsorted(rings, 1))
        # rows come by distance, so slabs of them share a ring border
        while first < len(rows):
            last = min(len(rows), first + 256)
            some, others = rows[first:last], near[: rings[last - 1]]
            entries = np.sort(np.append(others, e))
            out[some] = entries[(squares[entries] - 2 * (x[some] @ book[entries].T)).argmin(1)]
            first = last
    return out


def _bits(column: pa.ChunkedArray | pa.Array) -> tuple[bytes, bytes]:
    """Values and validity of a column of longs."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), valid.astype(np.uint8).tobytes()


def _blocks(rows: DataFrame, width: int, book: list[np.ndarray], scale: int) -> DataFrame:
    """Blocks of the kept vectors, assigned to their first entries by full search."""
    parts = len(book)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        flat = [c.flatten().to_numpy(zero_copy_only=False) for c in t.column("vector").chunks]
        y = scaled(np.concatenate(flat).reshape(t.num_rows, width), scale)
        x = _padded(y.astype(np.float64), parts)
        _check(x, book)
        codes = np.stack([full_search(x[:, p], book[p]) for p in range(parts)], 1).astype("<u2")
        row = [t.num_rows, *_bits(t.column("vec_id")), *_bits(t.column("label")), y.tobytes(), codes.tobytes()]
        names = [f.split()[0] for f in _BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return rows.mapInArrow(run, _BLOCKS)


def _check(x: np.ndarray, book: list[np.ndarray]) -> None:
    most = max(np.abs(x).max(initial=0), *[np.abs(b).max(initial=0) for b in book])
    if 4 * most * most * x.shape[2] >= _EXACT:
        raise ArithmeticError("squared distances leave the exact range of doubles; take a smaller scale")


def _open(b: pa.RecordBatch, i: int, width: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    n = b.column("size")[i].as_py()
    x = np.frombuffer(b.column("vectors")[i].as_py(), "<i4").reshape(n, width).astype(np.float64)
    codes = np.frombuffer(b.column("codes")[i].as_py(), "<u2").reshape(n, parts).astype(np.int64)
    return _padded(x, parts), codes


def _assign(blocks: DataFrame, width: int, book: list[np.ndarray]) -> DataFrame:
    """The same blocks with codes moved to the nearest entries of ``book``."""
    parts = len(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = []
            for i in range(b.num_rows):
                x, old = _open(b, i, width, parts)
                new = [ball_search(x[:, p], book[p], old[:, p]) for p in range(parts)]
                codes.append(np.stack(new, 1).astype("<u2").tobytes())
            columns = [*[b.column(j) for j in range(b.num_columns - 1)], pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return blocks.mapInArrow(run, _BLOCKS)


def _updated(blocks: DataFrame, width: int, book: list[np.ndarray]) -> list[np.ndarray]:
    """Entries replaced by the floors of their parts' means; unused ones stay.

    Every task adds its blocks up first; what reaches the driver is one sum per
    component of the codebooks.
    """
    parts, entries, size = len(book), len(book[0]), book[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, size + 1), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                x, code = _open(b, i, width, parts)
                for p in range(parts):
                    order = np.argsort(code[:, p], kind="stable")
                    used, starts, counts = np.unique(code[order, p], return_index=True, return_counts=True)
                    sums[p, used, :size] += np.add.reduceat(x[order, p].astype(np.int64), starts, axis=0)
                    sums[p, used, size] += counts
        cell = np.flatnonzero(sums.any(2))
        flat = sums.reshape(parts * entries, size + 1)
        place = (cell[:, None] * (size + 1) + np.arange(size + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(flat[cell].ravel())], ["cell", "amount"])

    rows = blocks.select("size", "vectors", "codes").mapInArrow(run, "cell long, amount long")
    # exact beyond 64 bits; parts x entries x (size + 1) rows at most
    total = rows.groupBy("cell").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect()
    new = [b.copy() for b in book]
    found: dict[int, int] = {r["cell"]: int(r["amount"]) for r in total}
    for p in range(parts):
        for e in range(entries):
            at = (p * entries + e) * (size + 1)
            if count := found.get(at + size, 0):
                new[p][e] = [found[at + i] // count for i in range(size)]
    return new


def codebook_text(book: list[np.ndarray], width: int) -> str:
    """Components of all entries by part, entry and position, joined by commas; filled-up positions left out."""
    size, out = book[0].shape[1], []
    for p, entries in enumerate(book):
        used = max(0, min(size, width - p * size))
        out.extend(str(int(v)) for entry in entries for v in entry[:used])
    return ",".join(out)


def _drop(df: DataFrame, path: str) -> None:
    where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def train(embeddings: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> tuple[DataFrame, list[np.ndarray], int] | None:
    """Blocks with final codes, codebooks and vector length; None where no vector is kept.

    A round reads the blocks of the one before, moves codes and writes them anew;
    a round's folder goes when the next one is complete, so two are on disk at most.
    """
    spark = embeddings.sparkSession
    rows, width = kept_vectors(embeddings)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return None
    start = _padded(scaled(np.array([r["vector"] for r in first]), scale).reshape(len(first), width).astype(np.float64), parts)
    book = [start[:, p].copy() for p in range(parts)]

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "balls")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    blocks, path = written(_blocks(rows, width, book, scale))
    for _ in range(rounds):
        book = _updated(blocks, width, book)
        moved, fresh = written(_assign(blocks, width, book))
        _drop(blocks, path)
        blocks, path = moved, fresh
    return blocks, book, width


def ball_codes(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row per kept vector.

    Null vectors and vectors with null or non-finite components are dropped, so
    are vectors of another length than the most frequent one. Where the length is
    no multiple of ``parts`` the last part is filled up with zeros. Codebooks start
    from the rows with the smallest ids (nulls last, ties by vector) and have as
    many entries as there are rows, if fewer. Repeated rows count once each; rows
    with null id keep their row. Null labels form one group. No kept vector gives
    an empty result. Components beyond the exact range raise ArithmeticError.
    Entries are at most 65,536. Further columns are not read.
    """
    made = train(embeddings, parts, entries, rounds, scale)
    schema = "vec_id long, label long, code string, error long"
    if made is None:
        empty = embeddings.sparkSession.createDataFrame([], schema)
        return empty.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    blocks, book, width = made
    digits = max(2, len(f"{entries - 1:x}"))
    digest = hashlib.sha256(codebook_text(book, width).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{e:0{digits}x}" for e in range(len(book[0]))])
        for b in batches:
            for i in range(b.num_rows):
                x, code = _open(b, i, width, parts)
                error = sum(((x[:, p] - book[p][code[:, p]]) ** 2).sum(1).astype(np.int64) for p in range(parts))
                text = names[code[:, 0]]
                for p in range(1, parts):
                    text = np.char.add(text, names[code[:, p]])
                ids, known, labels, labelled = (b.column(c)[i].as_py() for c in ("ids", "known", "labels", "labelled"))
                columns = [
                    pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(known, np.uint8) == 0),
                    pa.array(np.frombuffer(labels, "<i8"), mask=np.frombuffer(labelled, np.uint8) == 0),
                    pa.array(text.tolist(), pa.string()), pa.array(error),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    coded = stage(blocks.mapInArrow(run, schema))
    sums = stage(coded.groupBy("label").agg(F.count(F.lit(1)).alias("_rows"), F.sum("error").alias("label_error")))
    return join_counted(coded, sums, "label", ["label_error"]).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
