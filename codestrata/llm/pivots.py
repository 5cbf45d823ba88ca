"""Near-duplicate vectors through an index of pivot permutations."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codestrata.llm.shared import components, groups, split_large
from codestrata.llm.vectors import matrix, number_kind, packed, unit, usual_size
from codestrata.session import stage

#: Pivots per cube root of the number of vectors, and their bounds.
PIVOTS_PER_ROOT, FEWEST, MOST = 4.0, 16, 4096
#: Pivots of a vector that are indexed, nearest first.
PREFIX = 6
#: Pivots are no nearer to each other than this cosine.
APART = 0.6


def choose_pivots(distinct: DataFrame, n: int, kind: str) -> np.ndarray:
    """Reference points, apart from each other, from a bounded sample by hash."""
    want = int(min(MOST, max(FEWEST, PIVOTS_PER_ROOT * n ** (1 / 3))))
    sample = distinct.orderBy(F.xxhash64("node"), "node").limit(8 * want).select("vector").toArrow()
    x = unit(matrix(sample.column("vector"), kind))
    chosen = np.zeros((0, x.shape[1]))
    for v in x:
        if len(chosen) < want and not (chosen @ v > APART).any():
            chosen = np.vstack([chosen, v])
    return chosen


def connect(hit: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of a symmetric relation."""
    left, out = np.flatnonzero(hit.any(1)), []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            got = hit[at, left]
            if got.any():
                out.extend((int(at), int(x)) for x in left[got])
                reached.extend(left[got].tolist())
                left = left[~got]
    return out


def near_duplicate_vectors(embeddings: DataFrame, cosine: float = 0.9, group_rows: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``embeddings``.

    Equal vectors are one representative with a weight. Each is described by its
    nearest pivots in order; the inverted lists are kept per pair of pivots, so
    what meets in a list shares two at least. Pairs of a list are verified by
    their cosine in double precision, and counted in the list of the two
    smallest pivots they share, so once. A list above ``group_rows`` is dealt out
    as pairs of chunks. From a list come link counts per vector and the edges of
    a spanning forest, never pairs.

    Vectors that take no part (see ``vectors.packed``) and those of another than
    the most frequent length have no links and are their own component; without
    vec_id the component is null and the row is not kept. Repeated vec_ids are
    vectors of their own with a common id.
    """
    kind = number_kind(embeddings)
    rows = stage(packed(embeddings))
    size = usual_size(rows)
    valid = rows.filter(F.octet_length("vector") == size)
    distinct = stage(valid.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")))
    n = distinct.count()
    if not n:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
        )
    pivots = choose_pivots(distinct, n, kind)
    prefix = min(PREFIX, len(pivots))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                near = unit(matrix(b.column("vector"), kind)) @ pivots.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * prefix, pa.int32()), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), b.column("weight"), b.column("vector"), flat], ["node", "weight", "vector", "nearest"]
                )

    indexed = stage(distinct.select("node", "weight", "vector").mapInArrow(index, "node long, weight long, vector binary, nearest array<int>"))
    pairs = list(combinations(range(prefix), 2)) or [(0, 0)]
    cells = F.transform(
        F.array(*[F.array(F.lit(i), F.lit(j)) for i, j in pairs]),
        lambda p: F.struct(
            F.least(F.get("nearest", p[0]), F.get("nearest", p[1])).cast("long").alias("low"),
            F.greatest(F.get("nearest", p[0]), F.get("nearest", p[1])).cast("long").alias("high"),
        ),
    )
    listed = indexed.withColumn("cell", F.explode(cells)).select("node", "weight", "vector", "nearest", "cell.low", "cell.high")
    dealt = split_large(listed, ["low", "high"], group_rows, F.col("node"))
    keys = ["low", "high", "chunk_a", "chunk_b"]
    count = len(pivots)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, keys):
            if g.num_rows < 2:
                continue
            raw = matrix(g.column("vector"), kind)
            x = unit(raw)
            cos = x @ x.T
            hit = cos >= cosine
            close = np.argwhere(np.abs(cos - cosine) < 1e-9)
            for i, j in close:
                a, b = raw[i] / np.abs(raw[i]).max(), raw[j] / np.abs(raw[j]).max()
                hit[i, j] = float(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine
            np.fill_diagonal(hit, False)
            low, high, ca, cb = (g.column(k)[0].as_py() for k in keys)
            if ca != cb:
                chunk = g.column("chunk").to_numpy()
                hit &= chunk[:, None] != chunk[None, :]
            some = np.flatnonzero(hit.any(1))
            if not len(some):
                continue
            hit = hit[np.ix_(some, some)]
            nearest = np.array(g.column("nearest").to_pylist())[some]
            has = np.zeros((len(some), count), np.float32)
            has[np.arange(len(some))[:, None], nearest] = 1
            has[:, low] = 0
            earlier = (has[:, :high] @ has[:, :high].T) > 0  # a smaller pivot is shared: counted there
            hit &= ~earlier
            node, weight = g.column("node").to_numpy()[some], g.column("weight").to_numpy()[some]
            links = hit @ weight
            at = np.flatnonzero(links)
            edges = np.array(connect(hit), int).reshape(-1, 2)
            blank = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), blank, pa.array(links[at].astype(np.int64))], ["a", "b", "links"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[edges[:, 0]]), pa.array(node[edges[:, 1]]), pa.nulls(len(edges), pa.int64())], ["a", "b", "links"]
            )

    found = stage(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "a long, b long, links long"))
    linked = found.filter("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(found.filter("b is not null").select("a", "b"))
    by_node = (
        distinct.join(linked, "node", "left").join(labels, "node", "left")
        .select(
            F.col("vector").alias("_vector"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    own = F.coalesce("component_id", "vec_id")
    return rows.join(by_node, F.col("vector") == F.col("_vector"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )
