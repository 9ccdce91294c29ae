"""Rule-based column-type and error classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaweave.constants import COLUMN_TYPE_RULES
from schemaweave.functions.text import tokenize


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def classify_column(name) -> Column:
    """Substring rules tried in order; 'other' when none hits."""
    n = F.lower(_c(name).cast("string"))
    out = F.lit("other")
    for label, words in reversed(COLUMN_TYPE_RULES):
        hit = None
        for w in words:
            h = F.instr(n, w) > 0
            hit = h if hit is None else (hit | h)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def pair_column_type(left, right) -> Column:
    lt, rt = classify_column(left), classify_column(right)
    return F.when(lt == rt, lt).otherwise(F.lit("mixed"))


def classify_error(left, right, lexical, context, context_threshold: float = 0.6) -> Column:
    """structural_mismatch > abbreviation_or_token_overlap > semantic_near_miss > other."""
    overlap = F.arrays_overlap(tokenize(_c(left)), tokenize(_c(right)))
    return (F.when(classify_column(left) != classify_column(right), "structural_mismatch")
             .when(F.coalesce(overlap, F.lit(False)) & (_c(lexical) > 0), "abbreviation_or_token_overlap")
             .when(_c(context) >= context_threshold, "semantic_near_miss")
             .otherwise("other"))
