"""Column-expression functions (all JVM-side, codegen friendly)."""

from schemaweave.functions.casting import (bool_to_int, date_plus_hhmm, flag_from_text,
                                           parse_bool, parse_timestamp, to_float, to_int)
from schemaweave.functions.classify import classify_column, classify_error, pair_column_type
from schemaweave.functions.temporal import (day_of_week_mon0, fill_year, round_half_even,
                                            season, temporal_columns)
from schemaweave.functions.text import (alnum_key, clean_text, context_text, exact_match,
                                        expand_abbreviations, is_ambiguous, jaccard,
                                        normalize_name, pair_key, strip_ws, tfidf_terms,
                                        tokenize, with_expanded, with_normalized)

__all__ = [
    "alnum_key", "bool_to_int", "classify_column", "classify_error", "clean_text",
    "context_text", "date_plus_hhmm", "day_of_week_mon0", "exact_match",
    "expand_abbreviations", "fill_year", "flag_from_text", "is_ambiguous", "jaccard",
    "normalize_name", "pair_column_type", "pair_key", "parse_bool", "parse_timestamp",
    "round_half_even", "season", "strip_ws", "temporal_columns", "tfidf_terms", "to_float",
    "to_int", "tokenize", "with_expanded", "with_normalized",
]
