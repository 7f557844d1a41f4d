"""The registered queries of this package and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from rosterlake.llm import chat, embed_dedup, hard_negatives, langid, lm_score, mixing, packing, quality, runs, shard, simhash, suffix, urlfilter


def queries() -> dict:
    return {
        "op1_embedding_near_dedup": embed_dedup.query,
        "op2_cost_balanced_packing": packing.query,
        "op3_backoff_automaton_scores": lm_score.query,
        "op4_label_propagation_sharding": shard.query,
        "op5_poisson_mixing": mixing.query,
        "op6_byte_cnn_language_id": langid.query,
        "op7_url_model_ratio": urlfilter.query,
        "op8_line_first_cleaning": quality.query,
        "op9_simhash_near_dedup": simhash.query,
        "op10_suffix_dedup": suffix.query,
        "op11_chat_formatting": chat.query,
        "op12_periodic_runs": runs.query,
        "op13_hard_negatives": hard_negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_poisson_mixing": mixing.SQL, "op11_chat_formatting": chat.SQL, "op13_hard_negatives": hard_negatives.SQL}
