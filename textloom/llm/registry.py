"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import op1_simhash, op10_urls, op2_substring, op3_secrets, op4_decontaminate, op5_html, op6_language, op7_lines, op8_neighbours, op9_mixing


def queries():
    return {
        "op1_simhash": op1_simhash.op1_simhash,
        "op2_substring": op2_substring.op2_substring,
        "op3_secrets": op3_secrets.op3_secrets,
        "op4_decontaminate": op4_decontaminate.op4_decontaminate,
        "op5_html": op5_html.op5_html,
        "op6_language": op6_language.op6_language,
        "op7_lines": op7_lines.op7_lines,
        "op8_neighbours": op8_neighbours.op8_neighbours,
        "op9_mixing": op9_mixing.op9_mixing,
        "op10_urls": op10_urls.op10_urls,
    }


def oracle_sql():
    return {"op9_mixing": op9_mixing.mixing_sql()}
