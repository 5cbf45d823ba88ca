"""Token counts of whole texts through a cache of content digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codestrata.llm.tokens import digest, encoder
from codestrata.session import stage

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def unchanged(text: Column) -> Column:
    """Normal form of tokenizers that see every character."""
    return text


def single_spaces(text: Column) -> Column:
    """Normal form for vocabularies that drop white space: runs of the ASCII kind are one space."""
    return F.regexp_replace(text, r"[ \t\n\r]+", " ")


def load_cache(spark: SparkSession, location: str) -> DataFrame:
    """Stored counts, one row per key; empty where none were stored yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(location)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
    # an append that ran twice leaves equal rows
    return stored.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def encode_counts(distinct: DataFrame, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of (content, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for b in batches:
            n = np.fromiter((len(encode(t.as_py())) // 4 for t in b.column("text")), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array(n)], ["content", "n_tokens"])

    return distinct.mapInArrow(run, "content string, n_tokens long")


def count_tokens(
    documents: DataFrame, tokenizer: str, cache: str, limit: int = 2048, normalise=unchanged,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``documents``.

    Texts are keyed by the SHA-256 of their normal form and of the tokenizer
    file. Keys that ``cache`` holds are looked up; of the others each distinct
    text is encoded once and its count appended to ``cache``. Copies meet before
    the exchange, task by task, so a text with any number of copies is one row
    per task at most. ``normalise`` must not change counts. Null texts are empty;
    repeated rows and null ids are kept; only doc_id and text are read.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = F.sha2(normalise(text).cast("binary"), 256)
    version = digest(tokenizer)
    keyed = documents.select(F.col("doc_id").cast("long"), text.alias("text"), content.alias("content"))
    narrow = stage(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"))
    known = load_cache(spark, cache).filter(F.col("tokenizer") == version).select("content")
    missing = (
        keyed.select("content", "text").groupBy("content").agg(F.first("text").alias("text")).join(known, "content", "left_anti")
    )
    encode_counts(missing, tokenizer).select(
        "content", F.lit(version).alias("tokenizer"), "n_tokens"
    ).write.mode("append").parquet(cache)
    counts = load_cache(spark, cache).filter(F.col("tokenizer") == version).select("content", "n_tokens")
    return narrow.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
