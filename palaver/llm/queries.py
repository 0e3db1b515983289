"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from palaver.llm.cotraining import op1_cotraining
from palaver.llm.decontaminate import op3_decontaminate
from palaver.llm.html_text import op10_html_text
from palaver.llm.language_id import op6_language_id
from palaver.llm.link_graph import op4_link_graph
from palaver.llm.oracle import ORACLE as ORACLE
from palaver.llm.packing import op7_packing
from palaver.llm.quality_rules import op9_quality_rules
from palaver.llm.sharding import op5_sharding
from palaver.llm.simhash import op2_simhash
from palaver.llm.suffix_dedup import op8_suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (op1_cotraining, op2_simhash, op3_decontaminate, op4_link_graph, op5_sharding, op6_language_id, op7_packing, op8_suffix_dedup, op9_quality_rules, op10_html_text)
}
