"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import (ann, bpe, embedding_dedup, html_extract, jaccard_join, langid, mixing, periodic_runs,
               pii, prefix_trie, sharding, substring_dedup, toxicity)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_ann": ann.op3_ann,
    "op4_sharding": sharding.op4_sharding,
    "op5_pii": pii.op5_pii,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_langid": langid.op8_langid,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_html_extract": html_extract.op11_html_extract,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

SQL = {
    "op9_mixing": mixing.OP9_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
