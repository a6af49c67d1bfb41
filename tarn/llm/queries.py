"""The queries of the operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import classifiers, grid_join, hilbert, hmm, mixing, ngram_join, repeats, templates, token_counts
from tarn.llm.shared import table


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = hilbert.hilbert_shards(table(spark, sf_dir, "documents"))
    return got.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifiers.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifiers.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.strip_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_hilbert_sharding": op2_hilbert_sharding,
    "op3_epsilon_grid_join": op3_epsilon_grid_join,
    "op4_token_counts": op4_token_counts,
    "op5_template_decontamination": op5_template_decontamination,
    "op6_mix_sources": op6_mix_sources,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_hmm_scores": op9_hmm_scores,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

ORACLE_SQL: dict[str, str] = {"op6_mix_sources": mixing.SQL}
