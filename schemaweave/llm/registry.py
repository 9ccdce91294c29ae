"""Queries of this subpackage and the DuckDB SQL of those that SQL expresses."""

from __future__ import annotations

from functools import wraps

from schemaweave.llm import (bit_sliced, brown_lm, cover_tree, divergence, html_text, language_id, mixing, order_minhash,
                             packing, quality, runs, tool_calls, toxicity)
from schemaweave.session import ship_package


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(query) for name, query in {
    "op1_language_id": language_id.op1_language_id,
    "op2_cover_tree": cover_tree.op2_cover_tree,
    "op3_tool_calls": tool_calls.op3_tool_calls,
    "op4_order_minhash": order_minhash.op4_order_minhash,
    "op5_quality": quality.op5_quality,
    "op6_bit_sliced_topk": bit_sliced.op6_bit_sliced_topk,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_curriculum_mixing": mixing.op8_curriculum_mixing,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_brown_lm": brown_lm.op10_brown_lm,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_html_extraction": html_text.op12_html_extraction,
    "op13_periodic_runs": runs.op13_periodic_runs,
}.items()}
ORACLES: dict[str, str] = {
    "op2_cover_tree": cover_tree.ORACLE,
    "op3_tool_calls": tool_calls.ORACLE,
    "op6_bit_sliced_topk": bit_sliced.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
}
