"""The queries of this subpackage by name, and their SQL for the oracle where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import conversations, decontamination, htmltext, importance, mixing, neardup, packing, pii, quality, secrets, sharding, tokens, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_histogram_top_k": topk.op1_histogram_top_k,
        "op2_token_counts": tokens.op2_token_counts,
        "op3_quality_votes": quality.op3_quality_votes,
        "op4_poisson_mix": mixing.op4_poisson_mix,
        "op5_page_differencing": htmltext.op5_page_differencing,
        "op6_ngram_jaccard": neardup.op6_ngram_jaccard,
        "op7_pii_spans": pii.op7_pii_spans,
        "op8_secret_layers": secrets.op8_secret_layers,
        "op9_rendezvous_shards": sharding.op9_rendezvous_shards,
        "op10_winnowing": decontamination.op10_winnowing,
        "op11_shortest_pack_first": packing.op11_shortest_pack_first,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_importance_resampling": importance.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_histogram_top_k": topk.OP1_SQL,
        "op4_poisson_mix": mixing.OP4_SQL,
        "op6_ngram_jaccard": neardup.OP6_SQL,
        "op9_rendezvous_shards": sharding.OP9_SQL,
        "op10_winnowing": decontamination.OP10_SQL,
        "op13_importance_resampling": importance.OP13_SQL,
    }
