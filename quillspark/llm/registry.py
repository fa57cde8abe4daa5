"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import decontam, divergence, fingerprint, langid, mixing, neardup, negatives, secretscan, sharding, tokencount, tokenfiles, toxicity, urlfilter


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_kk_shards": sharding.op2_kk_shards,
        "op3_url_templates": urlfilter.op3_url_templates,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_syncmer_fingerprints": fingerprint.op6_syncmer_fingerprints,
        "op7_jaccard_groups": neardup.op7_jaccard_groups,
        "op7_link_counts": neardup.op7_link_counts,
        "op8_decontaminate": decontam.op8_decontaminate,
        "op9_token_counts": tokencount.op9_token_counts,
        "op10_token_files": tokenfiles.op10_token_files,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_secret_spans": secretscan.op13_secret_spans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mix_sources": mixing.OP4_SQL,
        "op7_jaccard_groups": neardup.OP7_SQL,
        "op7_link_counts": neardup.OP7_LINKS_SQL,
        "op8_decontaminate": decontam.OP8_SQL,
        "op11_hard_negatives": negatives.OP11_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
    }
