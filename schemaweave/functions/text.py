"""Text column functions: keys, name normalisation, expansion, tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweave.constants import ABBREVIATION_RULES


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def alnum_key(col) -> Column:
    """Keep letters and digits, lower-cased (metadata lookup key)."""
    return F.lower(F.regexp_replace(_c(col), r"[^\p{L}\p{N}]", ""))


def strip_ws(col) -> Column:
    """Strip leading and trailing whitespace of any kind (not only spaces)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def _trace(steps: Sequence[tuple[Column, str]]) -> Column:
    # concat_ws skips nulls, so only the steps that changed the value remain
    joined = F.concat_ws(" | ", *[F.when(changed, F.lit(name)) for changed, name in steps])
    return F.when(joined == "", F.lit("no_change")).otherwise(joined)


def normalize_name(col) -> tuple[Column, Column]:
    """Standard header normalisation and its step trace (as column expressions).

    trim -> lower -> runs of non [a-z0-9] become '_' -> collapse '_' -> strip '_'.
    Returns (normalized, steps).  Prefer :func:`with_normalized` on a
    DataFrame: it projects one step at a time, so no step is evaluated twice.
    """
    s0 = _c(col)
    s1 = strip_ws(s0)
    s2 = F.lower(s1)
    s3 = F.regexp_replace(s2, "[^a-z0-9]+", "_")
    s4 = F.regexp_replace(s3, "_+", "_")
    s5 = F.regexp_replace(s4, "^_+|_+$", "")
    steps = _trace([
        (s1 != s0, "trim_whitespace"),
        (s2 != s1, "lowercase"),
        (s3 != s2, "replace_special_chars"),
        (s4 != s3, "collapse_underscores"),
        (s5 != s4, "strip_edge_underscores"),
    ])
    return s5, steps


_NORMALIZE_STEPS = [
    ("trim_whitespace", lambda c: strip_ws(c)),
    ("lowercase", lambda c: F.lower(c)),
    ("replace_special_chars", lambda c: F.regexp_replace(c, "[^a-z0-9]+", "_")),
    ("collapse_underscores", lambda c: F.regexp_replace(c, "_+", "_")),
    ("strip_edge_underscores", lambda c: F.regexp_replace(c, "^_+|_+$", "")),
]


def with_normalized(df: DataFrame, src: str, out: str = "normalized_column_name",
                    steps_out: str = "normalization_steps") -> DataFrame:
    """Add the normalized name and its trace, one projection per step."""
    prev = "_n0"
    df = df.withColumn(prev, F.col(src))
    flags = []
    for i, (name, fn) in enumerate(_NORMALIZE_STEPS, start=1):
        cur = f"_n{i}"
        df = df.withColumn(cur, fn(F.col(prev)))
        df = df.withColumn(f"_nf{i}", F.when(F.col(cur) != F.col(prev), F.lit(name)))
        flags.append(f"_nf{i}")
        prev = cur
    joined = F.concat_ws(" | ", *[F.col(f) for f in flags])
    df = df.withColumn(out, F.col(prev)).withColumn(
        steps_out, F.when(joined == "", F.lit("no_change")).otherwise(joined))
    return df.drop("_n0", *[f"_n{i}" for i in range(1, 6)], *flags)


def expand_abbreviations(col, rules: Sequence[tuple[str, str]] = ABBREVIATION_RULES
                         ) -> tuple[Column, Column]:
    """Ordered substring replacement; each rule sees the already expanded text.

    (Column form; :func:`with_expanded` is the step-wise DataFrame form.)
    """
    text = _c(col)
    hits = []
    for pattern, replacement in rules:
        hits.append((F.instr(text, pattern) > 0, pattern))
        text = F.replace(text, F.lit(pattern), F.lit(replacement))
    return text, _trace(hits)


def with_expanded(df: DataFrame, src: str, out: str = "expanded_column_name",
                  trace_out: str = "abbreviation_rules_applied",
                  rules: Sequence[tuple[str, str]] = ABBREVIATION_RULES) -> DataFrame:
    """Add the expanded name and the rules that fired, one projection per rule."""
    prev = "_e0"
    df = df.withColumn(prev, F.col(src))
    flags = []
    for i, (pattern, replacement) in enumerate(rules, start=1):
        df = df.withColumn(f"_ef{i}", F.when(F.instr(F.col(prev), pattern) > 0, F.lit(pattern)))
        df = df.withColumn(f"_e{i}", F.replace(F.col(prev), F.lit(pattern), F.lit(replacement)))
        flags.append(f"_ef{i}")
        prev = f"_e{i}"
    joined = F.concat_ws(" | ", *[F.col(f) for f in flags])
    df = df.withColumn(out, F.col(prev)).withColumn(
        trace_out, F.when(joined == "", F.lit("no_change")).otherwise(joined))
    return df.drop("_e0", *[f"_e{i}" for i in range(1, len(rules) + 1)], *flags)


def is_ambiguous(col) -> Column:
    """Heuristic flag for abbreviated / ambiguous headers."""
    s = strip_ws(_c(col))
    compact = F.regexp_replace(s, r"[^\p{L}\p{N}]", "")
    return (
        (F.length(s) == 0)
        | (F.length(compact) <= 3)
        | ((F.upper(compact) == compact) & (F.lower(compact) != compact) & (F.length(compact) <= 6))
        | s.rlike("[0-9]")
        | (F.instr(s, "_") > 0)
    )


def tokenize(col) -> Column:
    """Lower-case, '_' as space, split on whitespace, distinct tokens."""
    parts = F.split(F.lower(F.translate(_c(col), "_", " ")), r"\s+")
    return F.array_distinct(F.array_remove(parts, ""))


def jaccard(left_tokens, right_tokens) -> Column:
    """|A n B| / |A u B| over token arrays; 0 when either side is empty."""
    a, b = _c(left_tokens), _c(right_tokens)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def exact_match(a, b) -> Column:
    return F.coalesce(_c(a) == _c(b), F.lit(False)).cast("int")


def clean_text(col) -> Column:
    """Drop backslashes and double quotes, dashes to '-', trim; 'nan'/'' -> null."""
    s = F.regexp_replace(_c(col), r'[\\"]', "")
    s = F.translate(s, "–—", "--")
    s = strip_ws(s)
    return F.when((s == "") | (s == "nan"), F.lit(None).cast("string")).otherwise(s)


def context_text(name, description) -> Column:
    """'name | description', or the name alone when there is no description."""
    d = _c(description)
    return F.when(d.isNull() | (d == ""), _c(name)).otherwise(F.concat_ws(" | ", _c(name), d))


def pair_key(a, b, sep: str = "__") -> Column:
    return F.concat_ws(sep, _c(a), _c(b))


def tfidf_terms(col) -> Column:
    """Unigrams of >=2 word characters ('_' is a word character) plus bigrams."""
    toks = F.regexp_extract_all(F.lower(_c(col)), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    bigrams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(toks) - 1, F.lit(1))),
        lambda i: F.when(i < F.size(toks), F.concat_ws(" ", F.get(toks, i - 1), F.get(toks, i))),
    )
    return F.concat(toks, F.filter(bigrams, lambda x: x.isNotNull()))
