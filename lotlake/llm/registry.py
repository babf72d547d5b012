"""The queries of this folder and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotlake.llm import ball_search, bpe_automaton, chat_format, decontamination, edit_counts, jaccard_tree, metric_join, ppm_language, rule_quality, sharding, substring_dedup, warc_revisits, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_revisits": warc_revisits.op1_warc_revisits,
        "op2_ppm_language": ppm_language.op2_ppm_language,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_jaccard_tree": jaccard_tree.op4_jaccard_tree,
        "op5_benchmark_leaks": decontamination.op5_benchmark_leaks,
        "op6_rendezvous_shards": sharding.op6_rendezvous_shards,
        "op7_metric_join": metric_join.op7_metric_join,
        "op8_bpe_automaton": bpe_automaton.op8_bpe_automaton,
        "op9_edit_counts": edit_counts.op9_edit_counts,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_cholesky_whitening": whitening.op11_cholesky_whitening,
        "op12_rule_quality": rule_quality.op12_rule_quality,
        "op13_ball_search": ball_search.op13_ball_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_revisits": warc_revisits.OP1_SQL,
        "op3_chat_format": chat_format.OP3_SQL,
        "op4_jaccard_tree": jaccard_tree.OP4_SQL,
        "op5_benchmark_leaks": decontamination.OP5_SQL,
        "op6_rendezvous_shards": sharding.OP6_SQL,
        "op7_metric_join": metric_join.OP7_SQL,
        "op10_substring_dedup": substring_dedup.OP10_SQL,
        "op13_ball_search": ball_search.OP13_SQL,
    }
