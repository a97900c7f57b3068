"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op12_alignment
from .bpe_automaton import op8_bpe
from .chat_format import op5_chat_format
from .html_extract import op3_html_extract
from .mixing import ORACLE_OP1, op1_mixing
from .quality_classifier import op4_quality_classifier
from .quality_rules import op7_quality_rules
from .sharding import op2_sharding
from .simhash import op10_simhash_dedup
from .token_files import op9_token_files
from .topk_search import ORACLE_OP6, op6_topk_search
from .toxicity import op13_toxicity
from .turn_repair import ORACLE_OP11, op11_turn_repair

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_sharding": op2_sharding,
    "op3_html_extract": op3_html_extract,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_chat_format": op5_chat_format,
    "op6_topk_search": op6_topk_search,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe": op8_bpe,
    "op9_token_files": op9_token_files,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_turn_repair": op11_turn_repair,
    "op12_alignment": op12_alignment,
    "op13_toxicity": op13_toxicity,
}

ORACLES = {"op1_mixing": ORACLE_OP1, "op6_topk_search": ORACLE_OP6, "op11_turn_repair": ORACLE_OP11}
