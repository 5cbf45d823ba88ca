"""Vectors of the embeddings table as bytes, and what makes one fit to take part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType


def number_kind(embeddings: DataFrame) -> str:
    """NumPy type that holds the components without loss."""
    kind = embeddings.schema["embedding"].dataType
    if not isinstance(kind, ArrayType):
        raise TypeError("embedding must be an array")
    return "<f4" if isinstance(kind.elementType, FloatType) else "<f8"


def packed(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector): components as bytes, null where a vector takes no part.

    That holds for null, empty and zero vectors, for null or non-finite
    components, and for rows without vec_id. Negative zero counts as zero.
    """
    kind = number_kind(embeddings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, out = b.column("embedding"), []
            known = b.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            for i in range(b.num_rows):
                v = lists[i].values if known[i] and lists[i].is_valid else None
                x = None if v is None or v.null_count or not len(v) else v.to_numpy(zero_copy_only=False).astype(kind)
                out.append((x + 0.0).astype(kind).tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "vector"])

    element = FloatType() if kind == "<f4" else DoubleType()
    chosen = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast(ArrayType(element)))
    return chosen.mapInArrow(run, "vec_id long, vector binary")


def usual_size(vectors: DataFrame) -> int:
    """The most frequent length in bytes, the longest of equally frequent ones; 0 if no vector takes part."""
    sizes = vectors.filter("vector is not null").groupBy(F.octet_length("vector").alias("size")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else 0


def matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Rows of equally long byte vectors as doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one without overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
