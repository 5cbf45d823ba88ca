"""Corpus pipeline: quality, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.llm.mixing import mix_rows
from codestrata.llm.packing import pack
from codestrata.llm.quality import quality
from codestrata.llm.shared import at_place, split_marked, table
from codestrata.llm.simhash import similar_rows
from codestrata.session import scratch_path, ship_package, stage

#: Columns of the documents table.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No source is repeated more than so many times as often as another.
REPEATS = 1.25
#: Words of a shingle; near duplicates have a similarity of 0.8 or more.
SHINGLE = 5
#: Fingerprints that differ in so many of 64 bits, or fewer, are candidates.
DISTANCE = 4


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.5 or more).

    Null and empty texts have a score like others, repeated rows are judged each,
    no rows give no rows, and further columns pass through.
    """
    scored = quality(docs, table(spark, sf_dir, "labels"), keep=docs.columns)
    return scored.filter("predicted = 1").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicate texts: the smallest doc_id, ids before nulls.

    SimHash fingerprints and bands of minima give the candidates, the exact
    similarity of their shingles decides (see ``similar_rows``).
    Rows are told apart by their place in the files, so repeated rows and rows
    without id are compared like others, and of one id with two texts each text is
    judged alone. Of rows with one doc_id, or none, the text with the smaller hash
    stays. Null texts count as empty, and all texts without words are copies of
    each other. No rows give no rows, and further columns may have any name.
    Texts that are no copy are not exchanged.
    """
    given = F.col("row")
    text, doc = given["text"].cast("string"), given["doc_id"].cast("long")
    missing = doc.isNull().alias("missing")
    key = F.struct(missing, F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64(text).alias("tie"), "file", "at")
    keyed = at_place(docs).select(key.alias("key"), "row")
    labels = stage(similar_rows(keyed.select(F.col("key").alias("row"), text.alias("text")), SHINGLE, distance=DISTANCE))
    first = labels.groupBy("component").agg(F.min("row").alias("row"))
    copies = stage(labels.join(first, "row", "left_anti").select(F.col("row").alias("key")))
    asked, free = split_marked(keyed, copies, "key")
    return asked.join(copies, "key", "left_anti").select("row.*").unionByName(free.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated so that small sources count for more; every document stays at least once.

    Rows are documents of their own, also with equal or null ids; null is a source;
    texts without words stay once; no rows give no rows.
    """
    return mix_rows(docs, repeats=REPEATS).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids.

    Null texts count as empty (one end id), repeated rows are packed each, no rows
    give no pieces, and further columns are left out.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        path = scratch_path(spark, "pipeline")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Training of the classifier and components of a graph have no SQL form.
ORACLE_SQL = None
