"""Memory-bounded batches: next-fit in path order, as a parallel prefix over step functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codestrata.operators.ordering import prefix
from codestrata.session import stage

BATCH_BYTES = 100 * 2**20  # usual size of a batch
#: Rows of a piece (a power of two) and pieces that are composed at once.
PIECE_BITS, FAN = 12, 32
_STEPS = "above array<long>, `left` array<long>, flushes array<long>, empty_left long, empty_flushes long, keep long"


@dataclass
class Steps:
    """How consecutive files map the bytes buffered before them to those buffered after them.

    More received bytes bring the first flush forward, so the map is a step
    function: more than ``above[i]`` (the largest such i, ``above`` falls) leaves
    ``left[i]`` after ``flushes[i]`` flushes; a buffer below all steps gains
    ``keep`` without a flush; an empty buffer never flushes at its first file and
    has a result of its own.
    """

    above: np.ndarray
    left: np.ndarray
    flushes: np.ndarray
    empty: tuple[int, int]
    keep: int

    def apply(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes buffered afterwards and flushes, for each of the received ``held``."""
        held = np.asarray(held, np.int64)
        at = len(self.above) - np.searchsorted(self.above[::-1], held, side="left")
        stepped = at < len(self.above)
        left, flushes = held + self.keep, np.zeros(len(held), np.int64)
        left[stepped], flushes[stepped] = self.left[at[stepped]], self.flushes[at[stepped]]
        none = held == 0
        left[none], flushes[none] = self.empty
        return left, flushes

    def then(self, after: Steps) -> Steps:
        """This map followed by ``after``."""
        lowest = self.above[-1] if len(self.above) else np.iinfo(np.int64).max
        shifted = after.above - self.keep
        # steps of the later map count where this one lets the buffer through
        use = shifted < lowest
        if len(self.above) and lowest <= 0:
            use[:] = False
        shifted = shifted[use]
        end = int(np.searchsorted(-shifted, 0)) + 1  # the first step at or below zero serves all smaller buffers
        left, more = after.apply(self.left)
        (empty_left,), (empty_more,) = after.apply(np.array([self.empty[0]]))
        return Steps(
            np.concatenate([self.above, np.maximum(shifted[:end], 0)]),
            np.concatenate([left, after.left[use][:end]]),
            np.concatenate([self.flushes + more, after.flushes[use][:end]]),
            (int(empty_left), self.empty[1] + int(empty_more)), self.keep + after.keep,
        ).merged()

    def merged(self) -> Steps:
        """Neighbouring steps with equal results as one."""
        if len(self.above) < 2:
            return self
        last = np.r_[(self.left[1:] != self.left[:-1]) | (self.flushes[1:] != self.flushes[:-1]), True]
        return Steps(self.above[last], self.left[last], self.flushes[last], self.empty, self.keep)


def _direct(sizes: np.ndarray, large: int | None) -> np.ndarray:
    return np.zeros(len(sizes), bool) if large is None else sizes > large


def _from_empty(sizes: np.ndarray, budget: int, large: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next-fit over one ordered piece, starting empty in front of every row.

    Returns for each row the bytes left at the end of the piece and the flushes
    on the way, and the bytes buffered by all rows in front of each row.
    """
    n = len(sizes)
    before = np.concatenate(([0], np.cumsum(np.where(_direct(sizes, large), 0, sizes))))
    reach = before[:-1] + sizes
    left, count = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    # rows behind j that exceed every nearer one, farthest first
    records: list[int] = []
    for j in range(n - 1, -1, -1):
        limit = before[j] + budget
        lo, hi, hit = 0, len(records) - 1, n
        while lo <= hi:
            mid = (lo + hi) // 2
            if reach[records[mid]] > limit:
                hit, lo = records[mid], mid + 1
            else:
                hi = mid - 1
        # nothing buffered yet: no flush at that row
        while hit < n and not (before[hit] > before[j] and reach[hit] > limit):
            hit += 1
        if hit == n:
            left[j] = before[n] - before[j]
        else:
            left[j], count[j] = left[hit], count[hit] + 1
        while records and reach[records[-1]] <= reach[j]:
            records.pop()
        records.append(j)
    return left, count, before


def steps_of(sizes: np.ndarray, budget: int, large: int | None = None) -> Steps:
    """The map of one ordered piece of files."""
    left, count, before = _from_empty(sizes, budget, large)
    slack = budget - (before[:-1] + sizes)
    first = np.flatnonzero(np.r_[True, slack[1:] < np.minimum.accumulate(slack)[:-1]])
    end = int(np.searchsorted(-slack[first], 0)) + 1
    first = first[:end]
    return Steps(
        np.maximum(slack[first], 0), left[first], count[first] + 1, (int(left[0]), int(count[0])), int(before[-1])
    ).merged()


def assign(sizes: np.ndarray, held: int, batch: int, budget: int, large: int | None = None) -> tuple[list[int], np.ndarray]:
    """Batch number of every file of a piece that starts with ``held`` bytes in ``batch``."""
    ids, direct = [], _direct(sizes, large)
    for size, alone in zip(sizes.tolist(), direct):
        if held + size > budget and held > 0:
            held, batch = 0, batch + 1
        if not alone:
            held += size
        ids.append(batch)
    return ids, direct


def _row(s: Steps) -> dict:
    return {
        "above": s.above.tolist(), "left": s.left.tolist(), "flushes": s.flushes.tolist(),
        "empty_left": s.empty[0], "empty_flushes": s.empty[1], "keep": s.keep,
    }


def _steps(row) -> Steps:
    arrays = [np.asarray(x, np.int64) for x in (row.above, row.left, row.flushes)]
    return Steps(*arrays, (int(row.empty_left), int(row.empty_flushes)), int(row.keep))


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """One map of up to FAN neighbours."""
    whole = reduce(Steps.then, [_steps(r) for r in pdf.sort_values("idx").itertuples()])
    return pd.DataFrame([{"repo": pdf["repo"].iloc[0], "idx": int(pdf["parent"].iloc[0]), **_row(whole)}])


def _push(pdf: pd.DataFrame) -> pd.DataFrame:
    """Start of each of up to FAN neighbours, from the start of their parent."""
    out, held, batch = [], int(pdf["held"].iloc[0]), int(pdf["batch"].iloc[0])
    for r in pdf.sort_values("idx").itertuples():
        out.append((r.repo, r.idx, held, batch))
        (held,), (more,) = (x.tolist() for x in _steps(r).apply(np.array([held])))
        batch += more
    return pd.DataFrame(out, columns=["repo", "idx", "held", "batch"])


def starts(pieces: DataFrame) -> DataFrame:
    """(repo, idx, held, batch): buffer and batch number in front of every piece.

    ``pieces`` has the map of piece ``idx`` (0, 1, ...) of each repo. Neighbours are
    composed FAN at a time, level by level, until a repository has one map; then
    starts are handed down the same levels. No task sees more than FAN maps.
    """
    def under(level: DataFrame) -> DataFrame:
        return level.withColumn("parent", F.expr(f"idx div {FAN}"))

    levels = [pieces]
    widest = pieces.agg(F.max("idx")).first()[0] or 0
    while widest:
        levels.append(stage(under(levels[-1]).groupBy("repo", "parent").applyInPandas(_compose, f"repo string, idx long, {_STEPS}")))
        widest //= FAN
    zero = F.lit(0).cast("long")
    known = levels[-1].select("repo", "idx", zero.alias("held"), zero.alias("batch"))
    for level in reversed(levels[:-1]):
        above = known.withColumnRenamed("idx", "parent")
        known = under(level).join(above, ["repo", "parent"]).groupBy("repo", "parent").applyInPandas(
            _push, "repo string, idx long, held long, batch long"
        )
    return known


def pack_batches(files: DataFrame, budget: int = BATCH_BYTES, large: int | None = None) -> DataFrame:
    """Next-fit batches in path order: (repo, path, size, batch_id, direct).

    With ``large``, files above it are written on their own (``direct``) and do
    not fill a batch.

    The assignment is sequential by nature. The ordered (path, size) rows are cut
    into pieces of at most 2 ** PIECE_BITS rows; each piece is summarised by how
    it maps the buffer it receives, the maps are composed in a tree (``starts``),
    and every piece then numbers its own rows.
    """
    ordered = stage(
        files.select("repo", "path", "size").repartitionByRange("repo", "path").sortWithinPartitions("repo", "path")
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_piece", F.shiftright("_at", PIECE_BITS))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        made = _row(steps_of(pdf["size"].to_numpy(np.int64), budget, large))
        return pd.DataFrame([{"repo": pdf["repo"].iloc[0], "_piece": int(pdf["_piece"].iloc[0]), **made}])

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        ids, direct = assign(pdf["size"].to_numpy(np.int64), int(pdf["held"].iloc[0]), int(pdf["batch"].iloc[0]), budget, large)
        return pd.DataFrame({"repo": pdf["repo"], "path": pdf["path"], "size": pdf["size"], "batch_id": ids, "direct": direct})

    maps = ordered.groupBy("repo", "_piece").applyInPandas(summary, f"repo string, _piece long, {_STEPS}")
    pieces = stage(prefix(maps, ["repo"], ["_piece"]).withColumn("idx", F.col("rank") - 1).drop("rank"))
    begun = pieces.select("repo", "_piece", "idx").join(starts(pieces.drop("_piece")), ["repo", "idx"]).drop("idx")
    return ordered.join(begun, ["repo", "_piece"]).groupBy("repo", "_piece").applyInPandas(
        numbered, "repo string, path string, size long, batch_id long, direct boolean"
    )
