"""Nearest neighbours by stable projections, a kd-tree and a chi-square stop."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.llm.shared import groups
from codestrata.llm.vectors import matrix, number_kind, packed, usual_size
from codestrata.session import stage

#: Projected dimensions (even), and the probability with which a neighbour is seen before the stop.
PROJECTED, CONFIDENCE = 8, 0.97
#: Rows of a cell, at most so many cells, rows of a leaf, queries of a group.
CELL_ROWS, MOST_CELLS, LEAF_ROWS, QUERY_ROWS = 4096, 16384, 128, 4096
#: Rows by hash that place the cuts of the upper tree.
SAMPLE_ROWS = 65536


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection."""
    def above(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > 1 - p else (low, mid)
    return high


def cuts(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Upper kd-tree in heap order: dimension of widest spread and its median, per node."""
    out: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for p in level:
            d = int(np.argmax(p.max(0) - p.min(0))) if len(p) else 0
            at = float(np.median(p[:, d])) if len(p) else 0.0
            out.append((d, at))
            left = p[:, d] < at
            below += [p[left], p[~left]]
        level = below
    return out


def cell_of(projected: np.ndarray, tree: list[tuple[int, float]], depth: int) -> np.ndarray:
    """Leaf number of the upper tree for each row."""
    node = np.zeros(len(projected), int)
    if depth:
        dims, at = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
        rows = np.arange(len(projected))
        for _ in range(depth):
            node = 2 * node + 1 + (projected[rows, dims[node]] >= at[node])
    return node - (2**depth - 1)


def leaves(projected: np.ndarray) -> list[np.ndarray]:
    """Row numbers by leaf of a kd-tree that halves the widest dimension."""
    open_, out = [np.arange(len(projected))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF_ROWS:
            out.append(rows)
            continue
        p = projected[rows]
        d = int(np.argmax(p.max(0) - p.min(0)))
        order = rows[np.argpartition(p[:, d], len(rows) // 2)]
        open_ += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return out


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row of q to each box."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - q[:, None, d], q[:, None, d] - high[None, :, d]), 0)
        out += gap * gap
    return out


class Space:
    """Inner products as distances: one more component lifts all rows to the same length.

    With rows scaled by the largest norm, |x'|^2 = 1 and q' = (q, 0), so that
    |q' - x'|^2 = |q|^2 + 1 - 2 q.x, nearest where the product is largest.
    """

    def __init__(self, size: int, scale: float, seed: int = 5):
        self.scale = scale
        self.axes = np.random.default_rng(seed).normal(size=(size + 1, PROJECTED))

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / self.scale
        if query:
            return x @ self.axes[:-1]
        rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
        return x @ self.axes[:-1] + rest[:, None] * self.axes[-1]

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Squared distance at an inner product of the original vectors."""
        with np.errstate(invalid="ignore", over="ignore"):
            return np.maximum(0.0, ((q / self.scale) ** 2).sum(1) + 1 - 2 * score / self.scale / self.scale)


def best_in_cell(
    q: np.ndarray, q_row: np.ndarray, bound: np.ndarray, x: np.ndarray, x_row: np.ndarray, x_id: np.ndarray,
    space: Space, k: int, stop: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of up to k candidates per query, ties kept by smaller id.

    ``q_row`` and ``x_row`` tell rows of the table apart: a query is no candidate of its own.

    Leaves are visited by growing projected distance, one per query and round,
    all queries of a leaf at once. A query ends when the next leaf's squared
    projected distance exceeds ``stop`` times its k-th squared distance so far.
    ``bound`` is a product that k candidates elsewhere are known to reach.
    """
    px, pq = space.project(x, False), space.project(q, True)
    parts = leaves(px)
    low = np.array([px[r].min(0) for r in parts])
    high = np.array([px[r].max(0) for r in parts])
    gaps = box_distance(pq, low, high)
    order = np.argsort(gaps, axis=1, kind="stable")
    n = len(q)
    top_score, top_row = np.full((n, k), -np.inf), np.full((n, k), -1)
    kth = bound.copy()
    active = np.arange(n)
    for step in range(len(parts)):
        leaf = order[active, step]
        limit = stop * space.distance(q[active], kth[active])
        limit[~np.isfinite(kth[active])] = np.inf
        go = gaps[active, leaf] <= limit
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(leaf[by]) != 0])
        for a, b in zip(starts, [*starts[1:], len(by)]):
            who, rows = active[by[a:b]], parts[leaf[by[a]]]
            score = q[who] @ x[rows].T
            score[q_row[who][:, None] == x_row[rows][None, :]] = -np.inf
            reach = (score >= np.maximum(kth[who], top_score[who, -1])[:, None] - 1e-9 * np.abs(score).max(initial=0)).any(1)
            if not reach.any():
                continue
            who, score = who[reach], score[reach]
            # exact scores, the same for equal vectors wherever they lie
            some = np.flatnonzero((score >= kth[who][:, None] - 1e-9 * np.abs(score).max(initial=0)).any(0))
            exact = np.stack([(q[w] * x[rows[some]]).sum(1) for w in who])
            exact[q_row[who][:, None] == x_row[rows[some]][None, :]] = -np.inf
            all_score = np.concatenate([top_score[who], exact], axis=1)
            all_row = np.concatenate([top_row[who], np.broadcast_to(rows[some], exact.shape)], axis=1)
            ids = np.where(all_row >= 0, x_id[all_row], np.iinfo(np.int64).max)
            best = np.lexsort((ids, -all_score), axis=1)[:, :k]
            top_score[who] = np.take_along_axis(all_score, best, 1)
            top_row[who] = np.take_along_axis(all_row, best, 1)
            kth[who] = np.maximum(kth[who], top_score[who, -1])
    use = (top_row >= 0) & (top_score > -np.inf) & (top_score >= bound[:, None])
    who, at = np.nonzero(use)
    return who, top_row[who, at], top_score[who, at]


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row.

    The index: rows are projected to a few Gaussian directions; an upper kd-tree,
    cut by a sample by hash, deals all rows into cells, and each cell has a
    kd-tree of its own. A query first searches its home cell; the k-th product
    found there bounds the other cells, which it visits unless the chi-square
    test already stops at their box. Cells and queries meet in groups of bounded
    size; a cell of many equal projections is dealt out by hash. Products are
    recomputed in double precision row by row, so equal vectors tie exactly and
    the smaller vec_id wins. Vectors that take no part are neither queries nor
    candidates; of several lengths only the most frequent takes part. Rows are
    told apart by a written key: of several rows with one vec_id each has its own
    result and is a candidate of the others. A cell with many queries is sent once
    for every QUERY_ROWS of them, a cell without queries not at all.
    """
    kind = number_kind(embeddings)
    rows = stage(packed(embeddings).withColumn("is_query", F.coalesce(is_query, F.lit(False))).withColumn("row", F.monotonically_increasing_id()))
    size = usual_size(rows)
    result = "query_id long, rank int, vec_id long, score double"
    if not size:
        return embeddings.sparkSession.createDataFrame([], result)
    valid = rows.filter(F.octet_length("vector") == size)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vector"), kind)
                most = np.abs(x).max()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([float(most * np.sqrt(((x / most) ** 2).sum(1).max()))]), pa.array([b.num_rows])], ["norm", "n"]
                )

    about = valid.select("vector").mapInArrow(norms, "norm double, n long").agg(F.max("norm").alias("norm"), F.sum("n").alias("n")).first()
    space = Space(size // np.dtype(kind).itemsize, min(about["norm"], 1e300))
    depth, target = 0, max(CELL_ROWS, about["n"] // MOST_CELLS)
    while (about["n"] >> depth) > target:
        depth += 1
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow()
    tree = cuts(space.project(matrix(sample.column("vector"), kind), False), depth)
    stop = chi_square_quantile(CONFIDENCE, PROJECTED)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                p = space.project(matrix(b.column("vector"), kind), False)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * PROJECTED, pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("vec_id"), b.column("vector"), pa.array(cell_of(p, tree, depth)), flat],
                    ["row", "vec_id", "vector", "cell", "at"],
                )

    points = stage(valid.select("row", "vec_id", "vector").mapInArrow(place, "row long, vec_id long, vector binary, cell long, at array<double>"))
    extent = [f(F.get("at", F.lit(d))).alias(f"{name}{d}") for name, f in (("low", F.min), ("high", F.max)) for d in range(PROJECTED)]
    # at most MOST_CELLS rows
    boxes = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *extent).orderBy("cell").collect()
    cell_ids = np.array([r["cell"] for r in boxes])
    low = np.array([[r[f"low{d}"] for d in range(PROJECTED)] for r in boxes])
    high = np.array([[r[f"high{d}"] for d in range(PROJECTED)] for r in boxes])
    parts = np.array([-(-r["n"] // target) for r in boxes])
    parts_of = F.create_map(*[F.lit(int(v)) for r in zip(cell_ids, parts) if r[1] > 1 for v in r]) if (parts > 1).any() else None
    many = F.coalesce(parts_of[F.col("cell")], F.lit(1)) if parts_of is not None else F.lit(1)
    dealt = points.select("row", "vec_id", "vector", "cell", F.pmod(F.xxhash64("row", F.lit(3)), many).cast("long").alias("part"))

    asked = stage(valid.filter("is_query").select("row", "vec_id", "vector"))
    keys = ["cell", "part", "chunk"]
    found_schema = "ask long, query_id long, vec_id long, score double"

    def route(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    q = matrix(b.column("vector"), kind)
                    gaps = box_distance(space.project(q, True), low, high)
                    first = gaps.argmin(1)
                    if home:
                        who, cell, part = np.arange(len(q)), first, np.zeros(len(q), int)
                    else:
                        bound = b.column("bound").to_numpy(zero_copy_only=False)
                        limit = stop * space.distance(q, bound)
                        limit[~np.isfinite(bound)] = np.inf
                        who, cell = np.nonzero(gaps <= limit[:, None])
                        again = parts[cell]
                        who, cell = np.repeat(who, again), np.repeat(cell, again)
                        part = np.arange(len(cell)) - np.repeat(np.cumsum(again) - again, again)
                        seen = (cell == first[who]) & (part == 0)
                        who, cell, part = who[~seen], cell[~seen], part[~seen]
                    take = pa.array(who)
                    names = ["row", "vec_id", "vector"] + ([] if home else ["bound"])
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(c).take(take) for c in names), pa.array(cell_ids[cell]), pa.array(part.astype(np.int64))], [*names, "cell", "part"]
                    )

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, keys):
            asks = g.column("asks").to_numpy()
            if asks.all() or not asks.any():
                continue
            x, q = (matrix(g.filter(pa.array(some)).column("vector"), kind) for some in (~asks, asks))
            ids, rows = g.column("vec_id").to_numpy(), g.column("row").to_numpy()
            bound = g.column("bound").to_numpy()[asks]
            who, at, score = best_in_cell(q, rows[asks], bound, x, rows[~asks], ids[~asks], space, k, stop)
            columns = [rows[asks][who], ids[asks][who], ids[~asks][at], score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["ask", "query_id", "vec_id", "score"])

    nothing = F.lit(float("-inf"))

    def searched(sent: DataFrame) -> DataFrame:
        columns = ["cell", "part", "chunk", "asks", "bound", "row", "vec_id", "vector"]
        # queries of a cell beyond QUERY_ROWS make further groups of that cell alone; a row per cell and part
        asking = F.broadcast(stage(
            sent.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("long").alias("chunks"))
        ))
        spread = dealt.join(asking, ["cell", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        routed = sent.join(asking, ["cell", "part"]).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(9)), F.col("chunks")))
        both = spread.withColumn("asks", F.lit(False)).withColumn("bound", nothing).select(*columns).unionByName(
            routed.withColumn("asks", F.lit(True)).select(*columns)
        )
        return stage(both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, found_schema))

    sent_schema = "row long, vec_id long, vector binary, {}cell long, part long"
    first = searched(asked.mapInArrow(route(True), sent_schema.format("")).withColumn("bound", nothing))
    bounds = first.groupBy("ask").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(nothing).alias("bound")
    )
    known = asked.join(bounds, asked.row == bounds.ask, "left").select(
        "row", "vec_id", "vector", F.coalesce("bound", nothing).alias("bound")
    )
    rest = searched(known.mapInArrow(route(False), sent_schema.format("bound double, ")))
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
