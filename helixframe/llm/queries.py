"""The queries of this subpackage and, where SQL can express them, what DuckDB must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, exact_dedup, jaccard_join, licenses, mixing, prefix_trie, quality, ranked_search, sharding, token_cache, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        decontaminate.op1_spaced_seed_decontamination,
        sharding.op2_label_propagation_sharding,
        ann.op3_block_knn,
        quality.op4_byte_cnn_quality,
        warc.op5_warc,
        toxicity.op6_blockmax_toxicity,
        token_cache.op7_token_cache,
        jaccard_join.op8_jaccard_join,
        mixing.op9_source_mixing,
        licenses.op10_license_scan,
        prefix_trie.op11_conversation_prefix_trie,
        exact_dedup.op12_content_sort_dedup,
        ranked_search.op13_tput_search,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_block_knn": ann.OP3_SQL,
        "op5_warc": warc.OP5_SQL,
        "op8_jaccard_join": jaccard_join.OP8_SQL,
        "op9_source_mixing": mixing.OP9_SQL,
        "op10_license_scan": licenses.OP10_SQL,
        "op11_conversation_prefix_trie": prefix_trie.OP11_SQL,
        "op12_content_sort_dedup": exact_dedup.OP12_SQL,
        "op13_tput_search": ranked_search.OP13_SQL,
    }
