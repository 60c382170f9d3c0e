"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import op1_warc, op2_url_filters, op3_line_dedup, op4_sharding, op5_embeddings, op6_langid, op7_packing, op8_minhash, op9_toxicity, op10_decontaminate

QUERIES = {
    "op1_warc_revisits": op1_warc.op1_warc_revisits,
    "op2_url_filters": op2_url_filters.op2_url_filters,
    "op3_line_dedup": op3_line_dedup.op3_line_dedup,
    "op4_minimax_sharding": op4_sharding.op4_minimax_sharding,
    "op5_embedding_near_dedup": op5_embeddings.op5_embedding_near_dedup,
    "op6_language_id": op6_langid.op6_language_id,
    "op7_lexical_packing": op7_packing.op7_lexical_packing,
    "op8_minhash_near_dedup": op8_minhash.op8_minhash_near_dedup,
    "op9_toxicity": op9_toxicity.op9_toxicity,
    "op10_decontamination": op10_decontaminate.op10_decontamination,
}
ORACLE = {"op1_warc_revisits": op1_warc.OP1_SQL, "op5_embedding_near_dedup": op5_embeddings.OP5_SQL, "op8_minhash_near_dedup": op8_minhash.OP8_SQL}
