"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from scriptorium.llm import embedding_dedup, exact_dedup, langid, licenses, line_dedup, mixing, ngram_join, packing, sharding, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_licenses": licenses.op2_licenses,
    "op3_langid": langid.op3_langid,
    "op4_mixing": mixing.op4_mixing,
    "op5_warc": warc.op5_warc,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_sharding": sharding.op8_sharding,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE_SQL = {
    "op2_licenses": licenses.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op8_sharding": sharding.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
