"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from friction.llm import exact_dedup, kd_shards, language_id, merkle, mixing, packing, partenum, quotes, simhash, token_counts, top_k, toxicity, vector_codes
from friction.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": lambda s, d: language_id.identify(read_table(s, d, "documents")),
        "op2_mix_sources": lambda s, d: mixing.mix(read_table(s, d, "documents")),
        "op3_simhash_near_dedup": lambda s, d: simhash.near_duplicates(read_table(s, d, "documents")),
        "op4_best_fit_packing": lambda s, d: packing.pack(read_table(s, d, "documents")),
        "op5_quotation_linking": lambda s, d: quotes.link_conversations(read_table(s, d, "conversations")),
        "op6_token_counts": lambda s, d: token_counts.token_counts(read_table(s, d, "documents"), token_counts.document_fields()),
        "op7_kd_shards": lambda s, d: kd_shards.kd_shards(read_table(s, d, "documents")),
        "op8_toxicity": lambda s, d: toxicity.toxicity(read_table(s, d, "documents"), read_table(s, d, "labels")),
        "op9_top_k": lambda s, d: top_k.top_k(read_table(s, d, "embeddings")),
        "op10_exact_dedup": lambda s, d: exact_dedup.exact_dedup(read_table(s, d, "documents")),
        "op11_merkle_manifest": lambda s, d: merkle.manifest_check(read_table(s, d, "documents")),
        "op12_exponion_codes": lambda s, d: vector_codes.vector_codes(read_table(s, d, "embeddings")),
        "op13_partenum_join": lambda s, d: partenum.jaccard_components(read_table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_top_k": top_k.ORACLE_SQL, "op10_exact_dedup": exact_dedup.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op12_exponion_codes": vector_codes.ORACLE_SQL}
