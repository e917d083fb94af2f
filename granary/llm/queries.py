"""The registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, chat, exact, html, licenses, lines, packing, passages, quality, repair, resample, search, simhash

QUERIES = {
    "op1_substring_dedup": passages.op1_substring_dedup,
    "op2_bit_sliced_top_k": search.op2_bit_sliced_top_k,
    "op3_sum_of_squares_packing": packing.op3_sum_of_squares_packing,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_html_extraction": html.op7_html_extraction,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_importance_resampling": resample.op12_importance_resampling,
    "op13_exact_dedup": exact.op13_exact_dedup,
}
SQL = {
    "op2_bit_sliced_top_k": search.OP2_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op8_license_scan": licenses.OP8_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
    "op11_conversation_repair": repair.OP11_SQL,
    "op12_importance_resampling": resample.OP12_SQL,
    "op13_exact_dedup": exact.OP13_SQL,
}
