"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from leafmill.llm.brown_lm import op9_brown
from leafmill.llm.decontaminate import OP6_SQL, op6_suffix_automaton
from leafmill.llm.fair_mix import OP7_SQL, op7_fair_queue
from leafmill.llm.hilbert_shards import op3_hilbert
from leafmill.llm.jaccard_join import OP2_SQL, op2_links, op2_size_aware
from leafmill.llm.license_templates import op10_templates
from leafmill.llm.lsh_forest import OP13_SQL, op13_forest
from leafmill.llm.merkle import OP12_SQL, op12_merkle
from leafmill.llm.phrases import OP11_SQL, op11_phrases
from leafmill.llm.quality_forest import op5_forest
from leafmill.llm.sanitise import op8_disclosure
from leafmill.llm.suffix_dedup import OP1_SQL, op1_suffix_array
from leafmill.llm.url_rules import OP4_SQL, op4_url_rules

QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_size_aware": op2_size_aware,
    "op2_links": op2_links,
    "op3_hilbert": op3_hilbert,
    "op4_url_rules": op4_url_rules,
    "op5_forest": op5_forest,
    "op6_suffix_automaton": op6_suffix_automaton,
    "op7_fair_queue": op7_fair_queue,
    "op8_disclosure": op8_disclosure,
    "op9_brown": op9_brown,
    "op10_templates": op10_templates,
    "op11_phrases": op11_phrases,
    "op12_merkle": op12_merkle,
    "op13_forest": op13_forest,
}

ORACLES = {
    "op1_suffix_array": OP1_SQL,
    "op2_size_aware": OP2_SQL,
    "op2_links": OP2_SQL,
    "op4_url_rules": OP4_SQL,
    "op6_suffix_automaton": OP6_SQL,
    "op7_fair_queue": OP7_SQL,
    "op11_phrases": OP11_SQL,
    "op12_merkle": OP12_SQL,
    "op13_forest": OP13_SQL,
}
