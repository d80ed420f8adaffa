"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import alignment, binary_records, decontamination, html_extraction, near_dedup, nearest, packing, prefix_trie, private_data, quality, sharding, substring_dedup, warc

QUERIES = {
    "op1_warc": warc.op1,
    "op2_substring_dedup": substring_dedup.op2,
    "op3_quality": quality.op3,
    "op4_html_extraction": html_extraction.op4,
    "op5_best_fit_packing": packing.op5,
    "op6_decontamination": decontamination.op6,
    "op7_sharding": sharding.op7,
    "op8_binary_records": binary_records.op8,
    "op9_nearest": nearest.op9,
    "op10_near_dedup": near_dedup.op10,
    "op11_prefix_trie": prefix_trie.op11,
    "op12_alignment": alignment.op12,
    "op13_private_data": private_data.op13,
}

ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op10_near_dedup": near_dedup.OP10_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
}
