"""Queries of the corpus operators: one per operator, over whole tables."""

from __future__ import annotations

from raterkit.llm.bpe_tree import op9_bpe_tree
from raterkit.llm.collocations import op12_collocations
from raterkit.llm.language_id import op8_language_id
from raterkit.llm.line_dedup import op2_line_dedup
from raterkit.llm.lsh_forest import op4_lsh_forest
from raterkit.llm.nn_descent import op3_nn_descent
from raterkit.llm.packing import op10_best_fit_packing
from raterkit.llm.pii_crf import op1_pii_crf
from raterkit.llm.pivot_topk import op6_pivot_topk
from raterkit.llm.prefix_trie import op11_prefix_trie
from raterkit.llm.quality import op7_quality
from raterkit.llm.sharding import op13_sharding
from raterkit.llm.warc import op5_warc_transactions

QUERIES = {
    "op1_pii_crf": op1_pii_crf,
    "op2_line_dedup": op2_line_dedup,
    "op3_nn_descent": op3_nn_descent,
    "op4_lsh_forest": op4_lsh_forest,
    "op5_warc_transactions": op5_warc_transactions,
    "op6_pivot_topk": op6_pivot_topk,
    "op7_quality": op7_quality,
    "op8_language_id": op8_language_id,
    "op9_bpe_tree": op9_bpe_tree,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_sharding": op13_sharding,
}
