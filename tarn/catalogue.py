"""All queries of the library outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.plans import alike, oracle, project, streams, tables

Query = Callable[[SparkSession, str], DataFrame]

_TABLES = (
    "size_bands health_bands role_tally lang_stats scope_totals coverage_buckets even_sample timeline resolve_best unresolved line_owner touched_findings"
    " blast_callers reach nearest_guard depth_hist idf_weights word_jaccard twins contested neighbours first_n session_lease welch_t failure_bound"
    " stable_bench line_letters path_facts page_tags embedded_lang scatter press_score page_tree ui_depth trace_top setting_verdicts skeletons screen_share tag_rows"
)
_STREAMS = (
    "monobit block_freq runs longest_run cusum_z excursion_visits excursion_bins pattern_counts psi2 phi universal_fn overlapping_templates"
    " non_overlapping_templates rank_test linear_complexity spectral bit_suite bit_suite_full byte_bits sign_hashes band_pairs alike_pairs clusters dup_lcs"
)

QUERIES: dict[str, Query] = {n: getattr(m, n) for m, names in ((tables, _TABLES), (streams, _STREAMS)) for n in names.split()} | project.QUERIES | alike.QUERIES
ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL | project.ORACLE_SQL | alike.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alike items: pairs of vectors within a cosine distance, found through bands of their sign hashes."""
    return streams.alike_pairs(spark, sf_dir)
