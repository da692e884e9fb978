"""The registered query of each operator, with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signaldesk.llm import alignment, bpe, chat_tools, decontam, licenses, phrases, quality_model, quality_rules, shards, simhash, token_counts, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": shards.shard_report,
    "op2_quality_rules": quality_rules.quality_report,
    "op3_toxicity": toxicity.toxicity_report,
    "op4_bpe": bpe.bpe_report,
    "op5_quality_classifier": quality_model.quality_scores,
    "op6_url_filters": url_filters.url_report,
    "op7_simhash": simhash.simhash_report,
    "op8_chat_formatting": chat_tools.tool_report,
    "op9_decontamination": decontam.leak_report,
    "op10_license_scans": licenses.license_report,
    "op11_phrases": phrases.collocation_report,
    "op12_token_counts": token_counts.count_report,
    "op13_alignment": alignment.alignment_report,
}
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality_rules.QUALITY_SQL,
    "op6_url_filters": url_filters.URL_SQL,
    "op11_phrases": phrases.COLLOCATION_SQL,
}
