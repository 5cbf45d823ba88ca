"""Packing of documents into sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from codestrata.llm.tokens import encoder
from codestrata.session import stage

SEQUENCE = 2048
END = 1
#: Bytes of the slot table that may be sent to every task.
MOST_SLOT_BYTES = 16 << 20


def cut(documents: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """Pieces of at most ``sequence`` ids of every document, its end id included.

    Whole sequences are cut from the front; what is left is the last piece. A
    piece carries the crc32 of its ids and ``nth``, its number among the pieces
    of its length in the task ``part`` that made it.
    """
    last = end.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = encode(text.as_py()) + last
                n = len(ids) // 4
                for at in range(0, n, sequence):
                    some = ids[at * 4 : (at + sequence) * 4]
                    length = len(some) // 4
                    rows.append((doc, at, length, crc32(some), n, part, seen[length]))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"
    )


def patterns(histogram: dict[int, int], sequence: int) -> list[tuple[list[int], int]]:
    """Packing patterns with their counts, by shortest-pack-first.

    Lengths are placed longest first. All packs of a pattern are handled at once:
    the pattern with the most room takes the length, as often as it has packs,
    and what does not fit anywhere opens new packs. The work depends on the
    number of lengths, not of pieces.
    """
    rooms: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    order: list[int] = []  # negative rooms, the largest first
    done: list[tuple[list[int], int]] = []

    def put(pattern: list[int], count: int, room: int) -> None:
        if room == 0:
            done.append((pattern, count))
            return
        if not rooms[room]:
            heappush(order, -room)
        rooms[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        n, opened = histogram[length], []
        while n:
            if order and -order[0] >= length:
                room = -order[0]
                pattern, count = rooms[room].pop()
                if not rooms[room]:
                    heappop(order)
                take = min(n, count)
                if count > take:
                    put(pattern, count - take, room)
            else:
                pattern, take, room = [], n, sequence
                most = sequence // length  # several in one new pack
                if most > 1 and n > most:
                    take = n // most
                    opened.append(([length] * most, take, sequence - length * most))
                    n -= take * most
                    continue
            put([*pattern, length], take, room - length)
            n -= take
        for o in opened:
            put(*o)
    return done + [x for room in sorted(rooms) for x in rooms[room]]


def slots(histogram: dict[int, int], sequence: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): where ranks of a length go."""
    out, used, first = [], defaultdict(int), 0
    for pattern, count in patterns(histogram, sequence):
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + count - 1, first, offset))
            used[length] += count
            offset += length
        first += count
    return out


def pack(documents: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece: where its ids lie in its document and in which sequence.

    Null and empty texts are documents of the end id alone. Repeated rows and
    null ids are packed as documents of their own; only doc_id and text are read.
    The histogram has at most ``sequence`` rows and is the only thing the driver
    sees; patterns go back to pieces by length and rank. An empty table gives an
    empty result.
    """
    spark = documents.sparkSession
    pieces = stage(cut(documents, tokenizer, sequence, end))
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(histogram, sequence)
    where = spark.createDataFrame(table, "length int, low long, high long, first long, offset long")
    if len(table) * 40 <= MOST_SLOT_BYTES:
        where = F.broadcast(where)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead, ["part", "length"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    return (
        ranked.join(where, (ranked.length == where.length) & F.col("rank").between(F.col("low"), F.col("high")))
        .select(
            "doc_id", "start", ranked.length.cast("long").alias("length"), "ids_crc32", "doc_tokens",
            (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset",
        )
    )
