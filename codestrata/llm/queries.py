"""Registered queries of the numbered operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.llm.ball_codes import ball_codes
from codestrata.llm.host_rules import host_rules
from codestrata.llm.katz import language_model_scores
from codestrata.llm.mixing import mix, token_count
from codestrata.llm.neighbours import nearest
from codestrata.llm.oracles import audit_sql, ball_codes_sql, host_rules_sql, mixing_sql
from codestrata.llm.packing import pack
from codestrata.llm.pivots import near_duplicate_vectors
from codestrata.llm.quality import quality
from codestrata.llm.shared import table
from codestrata.llm.simhash import near_duplicates
from codestrata.llm.source_audit import audit
from codestrata.llm.style_tree import extract
from codestrata.llm.token_counts import count_tokens, single_spaces
from codestrata.llm.token_files import digests, write_ids
from codestrata.session import scratch_path

#: Share of the largest possible entropy that the mixture has.
ENTROPY = 0.92


def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))
    return mix(counted, entropy=ENTROPY)


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so the result never depends on an earlier call."""
    return count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token-cache"),
        normalise=single_spaces,
    )


def op8_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-files"))
    return digests(spark, layout)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents"))


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes(table(spark, sf_dir, "embeddings"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_style_tree, op2_quality, op3_mixing, op4_katz, op5_packing, op6_simhash, op7_token_counts, op8_pivots, op9_token_files, op10_neighbours,
        op11_host_rules, op12_ball_codes, op13_source_audit,
    )
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing_sql(ENTROPY),
    "op11_host_rules": host_rules_sql(),
    "op12_ball_codes": ball_codes_sql(),
    "op13_source_audit": audit_sql(),
}
