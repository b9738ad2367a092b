"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from barweave.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from barweave.llm.html_text import op7_main_text
from barweave.llm.merkle import OP12_SQL, op12_merkle_manifest
from barweave.llm.mixing import op1_source_mixing
from barweave.llm.packing import op4_best_fit_packing
from barweave.llm.pii import op9_personal_data
from barweave.llm.prefix_tree import OP11_SQL, op11_prefix_tree_join
from barweave.llm.quality import op2_quality_divergence
from barweave.llm.runs import op13_periodic_runs
from barweave.llm.simhash import op5_simhash_golay
from barweave.llm.substrings import op6_paragraph_minhash
from barweave.llm.templates import op3_line_templates
from barweave.llm.token_files import op10_bit_packed_tokens

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op6_paragraph_minhash": op6_paragraph_minhash,
    "op7_main_text": op7_main_text,
    "op2_quality_divergence": op2_quality_divergence,
    "op3_line_templates": op3_line_templates,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_simhash_golay": op5_simhash_golay,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_personal_data": op9_personal_data,
    "op10_bit_packed_tokens": op10_bit_packed_tokens,
    "op11_prefix_tree_join": op11_prefix_tree_join,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL = {"op8_exact_dedup": OP8_SQL, "op11_prefix_tree_join": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
