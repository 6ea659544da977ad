"""The registered queries of this subpackage and their SQL twins."""
from __future__ import annotations

from plaintide.llm.alignment import op12_alignment
from plaintide.llm.boosted import op10_boosted_rules
from plaintide.llm.langid import op5_language
from plaintide.llm.merkle import OP11_SQL, op11_witnesses
from plaintide.llm.mixing import op4_mix
from plaintide.llm.multiindex import op3_multi_index
from plaintide.llm.naming import OP13_SQL, op13_block_naming
from plaintide.llm.ngram import op2_trie_lm
from plaintide.llm.packing import op6_pack
from plaintide.llm.rulefit import op1_rule_quality
from plaintide.llm.simhash import op8_ball_simhash
from plaintide.llm.suffixes import op9_suffix_dedup
from plaintide.llm.urlrules import OP7_SQL, op7_url_rules

QUERIES = {
    "op1_rule_quality": op1_rule_quality,
    "op2_trie_lm": op2_trie_lm,
    "op3_multi_index": op3_multi_index,
    "op4_mix": op4_mix,
    "op5_language": op5_language,
    "op6_pack": op6_pack,
    "op7_url_rules": op7_url_rules,
    "op8_ball_simhash": op8_ball_simhash,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_boosted_rules": op10_boosted_rules,
    "op11_witnesses": op11_witnesses,
    "op12_alignment": op12_alignment,
    "op13_block_naming": op13_block_naming,
}
ORACLES = {"op7_url_rules": OP7_SQL.strip(), "op11_witnesses": OP11_SQL.strip(), "op13_block_naming": OP13_SQL.strip()}
