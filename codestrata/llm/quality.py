"""Quality classifier: a factorisation machine over words and structure of a text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log, log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WORD_BUCKETS = 1 << 16
#: Bins of one structure statistic or metadata value.
BINS = 16
_MARKS = re.compile(r"[^\w\s]{2,}")
_STATISTICS = 14


@dataclass(frozen=True)
class Model:
    """Bias, weight per feature and low-rank factors per feature."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    metadata: tuple[str, ...]


def _share_bin(part: float, whole: float) -> int:
    return 0 if not part or not whole else max(1, BINS - 1 - int(-2 * log2(min(1.0, part / whole))))


def _size_bin(n: float) -> int:
    return min(BINS - 1, int(log2(1 + max(n, 0))))


def statistics(text: str, words: list[str]) -> list[int]:
    """Bin of each structure statistic of a whole text."""
    n, m = len(text), len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    kept = text.replace(" ", "").replace("\n", "")
    letters = sum(map(str.isalpha, words))
    upper = sum(map(str.isupper, words))
    marked = len(_MARKS.findall(text))
    digits = sum(text.count(d) for d in "0123456789")
    distinct = len(set(words))
    return [
        _size_bin(m), _size_bin(len(lines)), min(BINS - 1, int(len(kept) / m)) if m else 0, _share_bin(upper, m),
        _share_bin(letters, m), _share_bin(marked, m), _share_bin(digits, n), _share_bin(distinct, m),
        _share_bin(len(lines) - len(set(lines)), len(lines)), _share_bin(text.count("|"), m), _share_bin(text.count("."), m),
        _share_bin(text.count("!"), m), _size_bin(max(map(len, lines), default=0)),
        _share_bin(text.count("http") + text.count("<") + text.count("{"), m),
    ]


_BUCKETS: dict[str, int] = {}


def _bucket(word: str) -> int:
    at = _BUCKETS.get(word)
    if at is None:
        if len(_BUCKETS) > 300_000:
            _BUCKETS.clear()
        at = _BUCKETS[word] = crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
    return at


def _forget() -> None:
    """At the end of a task: the worker process serves later steps, which have their own to hold."""
    _BUCKETS.clear()


def features(text: str | None, metadata: Sequence[object]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one document.

    Words are lowered, split at white space and hashed; their values are
    1 + log of the count, scaled to length one. Each structure statistic and
    each metadata value (null has a bin of its own) is one feature of value 0.5.
    """
    text = text or ""
    words = text.split()
    counts = Counter(text.lower().split())
    at = np.fromiter((_bucket(w) for w in counts), np.int64, len(counts))
    value = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(value):
        value /= np.sqrt(value @ value)
    bins = statistics(text, words)
    for m in metadata:
        bins.append(0 if m is None else _size_bin(float(m) if isinstance(m, (int, float)) else len(str(m))))
    extra = WORD_BUCKETS + np.arange(len(bins)) * BINS + np.array(bins)
    return np.concatenate([at, extra]), np.concatenate([value, np.full(len(bins), 0.5)])


def scores(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log-odds of each row; interactions as half of (square of sum - sum of squares)."""
    if not rows:
        return np.zeros(0)
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
    linear = np.add.reduceat(model.weight[at] * value, starts)
    terms = model.factor[at] * value[:, None]
    sums = np.add.reduceat(terms, starts)
    squares = np.add.reduceat((terms * terms).sum(1), starts)
    return model.bias + linear + 0.5 * ((sums * sums).sum(1) - squares)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int, metadata: Sequence[str]) -> DataFrame:
    """At most ``rows`` labelled training rows, half of each class where there are as many.

    Chosen by hash of the id among labelled ids that are not held out. Only the
    chosen ids, of proven number, are sent to the scan of the texts.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id"), 3, 1))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    total = known.groupBy("quality").count()
    picked = [
        known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for q in (0, 1)
    ]
    chosen = picked[0].unionByName(picked[1]).join(F.broadcast(total), "quality")
    return documents.select(F.col("doc_id").cast("long"), "text", *metadata).join(F.broadcast(chosen), "doc_id")


def train(sample: DataFrame, metadata: tuple[str, ...], rank: int, epochs: int = 6, seed: int = 11) -> Model:
    """Logistic loss by AdaGrad over the sample's features, which the driver holds.

    The bias is moved to the class shares of all labelled training rows. Without
    rows of both classes the score is their share, or one half.
    """
    size = WORD_BUCKETS + BINS * (_STATISTICS + len(metadata))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            meta = [b.column(m).to_pylist() for m in metadata]
            made = [features(t.as_py(), [m[i] for m in meta]) for i, t in enumerate(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("quality"), b.column("count"),
                    pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())),
                    pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32())),
                ],
                ["doc_id", "quality", "count", "at", "value"],
            )
        _forget()

    got = sample.mapInArrow(run, "doc_id long, quality int, count long, at array<int>, value array<float>").toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    y = got.column("quality").to_numpy()
    rows = [(a.values.to_numpy(), v.values.to_numpy().astype(np.float64)) for a, v in zip(got.column("at"), got.column("value"))]
    rng = np.random.default_rng(seed)
    weight, factor, bias = np.zeros(size), rng.normal(0, 0.02, (size, rank)), 0.0
    share = dict(zip(got.column("quality").to_pylist(), got.column("count").to_pylist()))
    if len(share) < 2:
        odds = {(): 0.0, (0,): -4.0, (1,): 4.0}[tuple(share)]
        return Model(odds, weight, np.zeros((size, rank)), metadata)
    seen_w, seen_f = np.full(size, 1e-6), np.full((size, rank), 1e-6)
    for epoch in range(epochs):
        rate = 0.1 / (1 + epoch / 4)
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            f = factor[at]
            sums = v @ f
            z = bias + weight[at] @ v + 0.5 * (sums @ sums - np.einsum("i,ij,ij->", v * v, f, f))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            bias -= 0.02 * rate * g
            gw = g * v + 1e-5 * weight[at]
            gf = g * (v[:, None] * sums - (v * v)[:, None] * f) + 1e-4 * f
            np.add.at(seen_w, at, gw * gw)
            np.add.at(seen_f, at, gf * gf)
            np.add.at(weight, at, -rate * gw / np.sqrt(seen_w[at]))
            np.add.at(factor, at, -0.5 * rate * gf / np.sqrt(seen_f[at]))
    in_sample = (y == 1).sum() / max((y == 0).sum(), 1)
    bias += log(share[1] / share[0]) - log(in_sample)
    return Model(bias, weight, factor, metadata)


def score(documents: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``score`` (0 to 1) and ``predicted`` (score >= 0.5)."""
    metadata = model.metadata
    columns = [*dict.fromkeys([*keep, "text", *metadata])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                meta = [b.column(m).to_pylist() for m in metadata]
                odds = scores(model, [features(t.as_py(), [m[i] for m in meta]) for i, t in enumerate(b.column("text"))])
                p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k) for k in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    [*keep, "_score", "_predicted"],
                )
        _forget()

    source = documents.select(*columns)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "_score double", "_predicted int"])
    return source.mapInArrow(run, schema)


def quality(
    documents: DataFrame, labels: DataFrame, keep: Sequence[str] = ("doc_id",), sample_rows: int = 6000, rank: int = 8,
    metadata: tuple[str, ...] = ("n_chars",),
) -> DataFrame:
    """``keep`` columns, held_out, score and predicted of every row of ``documents``.

    Learns from at most ``sample_rows`` labelled rows whose crc32(doc_id) mod 3 is
    not 1. Null and empty texts are scored by their statistics; rows with null
    doc_id are scored and not held out; repeated rows are scored alike; several
    labels of one document count as the worst. Only ``keep``, text and
    ``metadata`` are read, so other columns may have any name.
    """
    metadata = tuple(m for m in metadata if m in documents.columns)
    model = train(labelled_sample(documents, labels, sample_rows, metadata), metadata, rank)
    out = score(documents, model, keep)
    return out.select(
        *keep, held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("_score").alias("score"),
        F.col("_predicted").alias("predicted"),
    )
