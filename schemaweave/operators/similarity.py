"""Similarity scores: token Jaccard, TF-IDF cosine, best-match against targets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweave.constants import PAIR_KEY
from schemaweave.functions.text import exact_match, jaccard, tfidf_terms, tokenize


# --- Q1 + N22 ---------------------------------------------------------------------------
def lexical_scores(pairs: DataFrame, left: str = "left_header_only",
                   right: str = "right_header_only") -> DataFrame:
    """Jaccard and exact match of every pair's two headers."""
    return pairs.select(*PAIR_KEY, jaccard(tokenize(F.col(left)), tokenize(F.col(right))).alias("lexical_jaccard"),
                        exact_match(left, right).alias("exact_match"))


# --- Q2 + Q3 + U3 -----------------------------------------------------------------------
def tfidf_postings(docs: DataFrame, space: Sequence[str], key: str, max_features: int = 100) -> DataFrame:
    """Fit TF-IDF on weighted documents (``space`` columns, ``key``, text, occ) and return the L2-unit
    weights (space, term, ``key``, w) of every document; each space is a corpus with a vocabulary of its own.

    tf = raw count; idf = ln((1+n)/(1+df)) + 1 with ``occ`` occurrences of every document;
    the vocabulary is the ``max_features`` terms of highest corpus frequency, ties by term.  The fitted
    state, at most ``max_features`` terms a space, is joined as a broadcast.
    """
    by = list(space)
    tf = (docs.select(*by, key, "occ", F.explode(tfidf_terms(F.coalesce("text", F.lit("")))).alias("term"))
          .groupBy(*by, key, "occ", "term").agg(F.count(F.lit(1)).alias("tf")))
    stats = tf.groupBy(*by, "term").agg(F.sum(F.col("occ") * F.col("tf")).alias("freq"), F.sum("occ").alias("df"))
    best = Window.partitionBy(*by).orderBy(F.desc("freq"), F.asc("term"))
    top = stats.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= max_features)
    size = docs.groupBy(*by).agg(F.sum("occ").alias("_n"))
    idf = F.log((1.0 + F.col("_n")) / (1.0 + F.col("df").cast("double"))) + 1.0
    vocab = top.join(size, by).select(*by, "term", idf.alias("idf"))
    w = tf.join(F.broadcast(vocab), [*by, "term"]).select(*by, key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*by, key)))  # over one document's terms
    return w.select(*by, "term", key, (F.col("w") / norm).alias("w"))


def tfidf_vectors(docs: DataFrame, text_col: str, max_features: int = 100) -> DataFrame:
    """TF-IDF of a corpus of documents as one L2-unit vector per distinct text,
    ``(text, vec map<string,double>)``; see :func:`tfidf_postings`.  Documents are first
    collapsed to distinct texts with an occurrence count, so repeated texts cost nothing."""
    occ = docs.groupBy(F.col(text_col).alias("text")).agg(F.count(F.lit(1)).alias("occ"))
    # the text is its own key; a null text has no terms
    w = tfidf_postings(occ.where("text is not null").select(F.lit(0).alias("_s"), F.col("text").alias("_k"), "text", "occ").union(
        occ.where("text is null").select(F.lit(0), F.lit(""), F.lit(""), "occ")), ["_s"], "_k", max_features)
    vecs = w.groupBy(F.col("_k").alias("text")).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("vec"))
    return occ.select("text").join(vecs, "text", "left").select(
        "text", F.coalesce("vec", F.create_map().cast("map<string,double>")).alias("vec"))


def map_dot(a: Column, b: Column) -> Column:
    """Sum over a's entries of a[k] * b[k] (missing in b counts 0)."""
    prods = F.transform(F.map_entries(a), lambda e: e["value"] * F.coalesce(F.element_at(b, e["key"]), F.lit(0.0)))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def with_tfidf_cosines(pairs: DataFrame, spaces: Sequence[tuple[str, str, str]], max_features: int = 100) -> DataFrame:
    """``pairs`` with, per (left text, right text, out) of ``spaces``, the cosine of the two sides' TF-IDF
    vectors; a space's corpus is both sides of every pair (a text counts once per pair side).

    The vectors, one per distinct text, are looked up for each side, so a pair is
    scored in place; no join on the pair key is needed."""
    j = pairs
    for i, (left, right, out) in enumerate(spaces):
        corpus = pairs.select(F.col(left).alias("t")).unionAll(pairs.select(F.col(right).alias("t")))
        vecs = tfidf_vectors(corpus, "t", max_features)
        lv = vecs.select(F.col("text").alias(f"_lt{i}"), F.col("vec").alias(f"_lv{i}"))
        rv = vecs.select(F.col("text").alias(f"_rt{i}"), F.col("vec").alias(f"_rv{i}"))
        j = j.join(lv, F.col(left).eqNullSafe(F.col(f"_lt{i}")), "left").join(rv, F.col(right).eqNullSafe(F.col(f"_rt{i}")), "left")
    return j.select(*pairs.columns, *[F.coalesce(map_dot(F.col(f"_lv{i}"), F.col(f"_rv{i}")), F.lit(0.0)).alias(out)
                                      for i, (_, _, out) in enumerate(spaces)])


def tfidf_cosine(pairs: DataFrame, left_text: str, right_text: str, out_col: str,
                 max_features: int = 100) -> DataFrame:
    return with_tfidf_cosines(pairs, [(left_text, right_text, out_col)], max_features).select(*PAIR_KEY, out_col)


_SPACES = [("left_header_only", "right_header_only", "embedding_header_only_cosine"),
           ("left_header_with_context", "right_header_with_context", "embedding_header_context_cosine")]


def score_pairs(pairs_repr: DataFrame, max_features: int = 100) -> DataFrame:
    """All four scores (Q1 + Q2/Q3, as J2 merges them) of any given pairs with their texts.  For all pairs
    of a catalog use :mod:`sparse`, which fits and scores without the table of pairs."""
    lh, rh = "left_header_only", "right_header_only"
    j = with_tfidf_cosines(pairs_repr, _SPACES, max_features)
    return j.select(*PAIR_KEY, jaccard(tokenize(F.col(lh)), tokenize(F.col(rh))).alias("lexical_jaccard"),
                    exact_match(lh, rh).alias("exact_match"), "embedding_header_only_cosine",
                    "embedding_header_context_cosine")


def embedding_scores(pairs_repr: DataFrame, max_features: int = 100) -> DataFrame:
    """Header-only and header+context cosines (separate vocabularies)."""
    return with_tfidf_cosines(pairs_repr, _SPACES, max_features).select(*PAIR_KEY, *[out for _, _, out in _SPACES])


# --- bounded target lists ------------------------------------------------------------------
def collect_bounded(df: DataFrame, max_rows: int) -> list:
    """Collect a target list whose size is checked first (raise beyond the bound)."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"target list exceeds {max_rows} rows; use the joins of best_match")
    return rows


# --- Q4 / J8 (vector scorer) -----------------------------------------------------------------
def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def best_of(scores: Column, names: Column, keep) -> Column:
    """0 or 1 (target, score) entries: the best of ``scores`` (the first on ties)
    if ``keep(score)``.  Emitted with ``inline``, so the scores are evaluated
    once and no filter can be pushed below them."""
    top = F.array(scores)
    picked = F.transform(top, lambda s: F.struct(
        F.element_at(names, F.array_position(s, F.array_max(s)).cast("int")).alias("best_target"),
        F.array_max(s).alias("best_score")))
    return F.filter(picked, lambda e: keep(e["best_score"]))


def vector_best_match(src: DataFrame, vec_col: str, targets: Sequence[tuple[str, Sequence[float]]],
                      threshold: float = 0.7) -> DataFrame:
    """Argmax cosine target per source row, kept only when strictly above ``threshold``.

    ``targets`` is a bounded list (see :func:`collect_bounded`), scaled to unit
    length once and compiled into the projection, so sources stream through
    without a join or shuffle.
    """
    unit = []
    for n, v in targets:
        size = math.sqrt(sum(float(x) ** 2 for x in v))
        unit.append((n, [float(x) / size if size else None for x in v]))
    names = F.array(*[F.lit(n) for n, _ in unit])
    tvecs = F.array(*[F.array(*[F.lit(x).cast("double") for x in v]) for _, v in unit])
    scores = F.transform(tvecs, lambda t: F.aggregate(
        F.zip_with(F.col("_unit"), t, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x))
    v = F.col(vec_col)
    scaled = F.transform(F.array(_norm(v)), lambda n: F.transform(v, lambda a: F.try_divide(a.cast("double"), n)))
    with_unit = src.withColumn("_unit", F.explode(scaled))
    return with_unit.select(*src.columns, F.inline(best_of(scores, names, lambda s: s > threshold)))


# --- Q5 / J8 (string scorers) ----------------------------------------------------------------
def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on lower-cased text (1.0 for two empties)."""
    la, lb = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(la), F.length(lb))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(la, lb) / longest)


def fuzzy_best_match(src: DataFrame, text_col: str, targets: Sequence[str],
                     threshold: float = 0.6) -> DataFrame:
    """Best target per source by edit ratio: the highest score that is >=
    ``threshold`` and > 0; the first target wins ties.  Sources without a match
    are dropped.  Each distinct text is scored once and joined back."""
    tl = F.array(*[F.lit(t) for t in targets])
    scores = F.transform(tl, lambda t: levenshtein_ratio(F.col("_text"), t))
    texts = src.select(F.col(text_col).alias("_text")).where("_text is not null").distinct()
    best = texts.select("_text", F.inline(best_of(scores, tl, lambda s: (s >= threshold) & (s > 0))))
    return src.join(best, src[text_col] == best["_text"]).drop("_text")


def token_best_match(src: DataFrame, text_col: str, targets: Sequence[str], threshold: float) -> DataFrame:
    """As :func:`fuzzy_best_match` with the Jaccard similarity of the token sets."""
    tl = F.array(*[F.lit(t) for t in targets])
    scores = F.transform(tl, lambda t: jaccard(tokenize(F.col("_text")), tokenize(t)))
    texts = src.select(F.col(text_col).alias("_text")).where("_text is not null").distinct()
    best = texts.select("_text", F.inline(best_of(scores, tl, lambda s: (s >= threshold) & (s > 0))))
    return src.join(best, src[text_col] == best["_text"]).drop("_text")
