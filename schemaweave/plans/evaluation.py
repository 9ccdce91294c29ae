"""Evaluation plans over the part-name matching task and the other driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.constants import PAIR_KEY, SCORE_METHODS
from schemaweave.functions.classify import classify_column
from schemaweave.operators import evaluate as E
from schemaweave.operators import sparse as SP
from schemaweave.operators.modeling import class_report, roc_auc, stratified_split
from schemaweave.operators.pairs import candidate_pairs
from schemaweave.operators.sections import extract_sections, items_from_text
from schemaweave.operators.best_match import fuzzy_best_match_join, token_best_match_join, vector_best_match_join
from schemaweave.operators.keyed import dense_codes
from schemaweave.operators.similarity import fuzzy_best_match, token_best_match
from schemaweave.plans import matching as M
from schemaweave.plans.matching import table


def schema_pairs(spark: SparkSession, d: str) -> DataFrame:
    return candidate_pairs(M.part_catalog(spark, d))


def pair_context(spark: SparkSession, d: str) -> DataFrame:
    return M.pairs_repr(spark, d)


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = M.similarity_scores(spark, d)
    return s.select(*PAIR_KEY, "lexical_jaccard", "exact_match")


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    """N22 over every candidate pair: the pairs whose final names are equal,
    with their other scores."""
    s = M.sparse(spark, d)
    return SP.expand(s, s.pairs.where(F.col("exact_match") == 1)).select(*PAIR_KEY, "lexical_jaccard", "embedding_header_only_cosine")


def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    s = M.similarity_scores(spark, d)
    return s.select(*PAIR_KEY, "embedding_header_only_cosine", "embedding_header_context_cosine")


def merge_scores(spark: SparkSession, d: str) -> DataFrame:
    return M.similarity_scores(spark, d)


def merge_scores_join(spark: SparkSession, d: str) -> DataFrame:
    """The same score table through the J2 operator: the lexical and the embedding
    score table merged on the 4-column pair key."""
    from schemaweave.operators.pairs import merge_scores as j2
    scores = M.similarity_scores(spark, d)
    lex = scores.select(*PAIR_KEY, "lexical_jaccard", "exact_match").withColumnsRenamed(
        {"left_column_final": "left_column", "right_column_final": "right_column"})
    return j2(lex, scores.select(*PAIR_KEY, "embedding_header_only_cosine", "embedding_header_context_cosine"))


def top_n_template(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    return E.ground_truth_template(SP.top_per_grid(M.sparse(spark, d), "embedding_header_context_cosine", n), top_n=n)


def metrics_fixed(spark: SparkSession, d: str) -> DataFrame:
    return E.metrics_table(M.weighted(spark, d), weight="n")


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return E.threshold_sweep(M.weighted(spark, d), weight="n")


def f1_by_type(spark: SparkSession, d: str) -> DataFrame:
    return E.f1_by_type(M.weighted(spark, d), weight="n")


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    matches = M.weighted(spark, d).withColumnsRenamed({"u_final": "left_column_final", "v_final": "right_column_final"})
    return E.value_counts(E.true_match_column_types(matches, weight="n"), "column_type", weight="n")


def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    s = M.sparse(spark, d)
    return E.precision_at_k(lambda score, n: SP.top_pairs(s, score, n))


def histogram(spark: SparkSession, d: str) -> DataFrame:
    h = E.score_histogram(M.weighted(spark, d), weight="n")
    return h.select("method", "is_match", "bin", F.round("bin_lo", 9).alias("bin_lo"),
                    F.round("bin_hi", 9).alias("bin_hi"), "count", F.round("density", 6).alias("density"))


CONTEXT = "embedding_header_context_cosine"


def false_pos(spark: SparkSession, d: str) -> DataFrame:
    return E.top_false_positives(SP.top_pairs(M.sparse(spark, d), CONTEXT, 10, label=0), n=10)


def false_neg(spark: SparkSession, d: str) -> DataFrame:
    return E.top_false_negatives(SP.top_pairs(M.sparse(spark, d), CONTEXT, 10, label=1, ascending=True), n=10)


def error_types(spark: SparkSession, d: str) -> DataFrame:
    return E.error_types(SP.top_pairs(M.sparse(spark, d), CONTEXT, 200, label=0), n=200)


def match_pivot(spark: SparkSession, d: str) -> DataFrame:
    return E.match_pivot(SP.labels_per_grid(M.sparse(spark, d)), weight="n")


def curves(spark: SparkSession, d: str) -> DataFrame:
    return E.sweep_curves(threshold_sweep(spark, d))


# --- fixed values: presentation order and labels of the three methods ---
METHOD_ORDER = [m for _, m, _ in SCORE_METHODS]
METHOD_LABELS = {m: label for _, m, label in SCORE_METHODS}


def bars(spark: SparkSession, d: str) -> DataFrame:
    return E.metric_bars(metrics_fixed(spark, d), METHOD_ORDER, METHOD_LABELS)


def best_vs_lexical(spark: SparkSession, d: str) -> DataFrame:
    return E.best_challenger_vs_base(metrics_fixed(spark, d), "lexical_jaccard")


# --- mapping evaluation (Q4, Q5, Q6, A13, J7, A15-A23) -----------------------------------------
#: Up to so many targets are compiled into a projection over the sources; a longer list is joined.
INLINE_TARGETS = 64


def type_targets(spark: SparkSession, d: str) -> DataFrame:
    """Canonical targets (target, pos): the distinct part types, lower-cased, in their order."""
    types = table(spark, d, "part").select(F.lower("p_type").alias("target")).where("target is not null").distinct()
    return dense_codes(types, "target", "pos")


def best_by(src: DataFrame, text_col: str, targets: DataFrame, threshold: float, method: str) -> DataFrame:
    """``src`` with best_target and best_score by edit ratio ("lexical") or token Jaccard ("token")."""
    few = targets.limit(INLINE_TARGETS + 1).collect()
    if len(few) > INLINE_TARGETS:
        join = fuzzy_best_match_join if method == "lexical" else token_best_match_join
        return join(src, text_col, targets, threshold)
    listed = [r["target"] for r in sorted(few, key=lambda r: r["pos"])]
    return (fuzzy_best_match if method == "lexical" else token_best_match)(src, text_col, listed, threshold=threshold)


def mapping_sources(spark: SparkSession, d: str) -> DataFrame:
    cat = M.part_catalog(spark, d)
    return cat.select(F.col("city").alias("dataset"), F.col("column_original").alias("source"),
                      F.lower("description").alias("true_target"))


def predicted_mappings(spark: SparkSession, d: str) -> DataFrame:
    """(dataset, method, source, target): a lexical (edit-ratio) and a token method."""
    targets = type_targets(spark, d)
    src = mapping_sources(spark, d)
    lex, tok = (best_by(src, "source", targets, 0.3, m).select("dataset", F.lit(m).alias("method"), "source", F.col("best_target").alias("target"))
                for m in ("lexical", "token"))
    return lex.unionByName(tok)


def matching_results(spark: SparkSession, d: str) -> DataFrame:
    """A13 for every (dataset, method) in one grouped plan (Q6)."""
    src = mapping_sources(spark, d)
    pred = predicted_mappings(spark, d)
    true_map = src.select("dataset", "source", F.col("true_target").alias("target"))
    # one true mapping per method (two methods: a bounded literal list, no join)
    true_long = true_map.withColumn("method", F.explode(F.array(F.lit("lexical"), F.lit("token"))))
    q = E.match_quality(true_long, pred, group=("dataset", "method"))
    return q.select("dataset", "method", *[F.round(c, 9).alias(c) for c in ["accuracy", "precision", "recall", "f1"]])


def matching_eval(spark: SparkSession, d: str) -> DataFrame:
    return matching_results(spark, d)


def method_summary(spark: SparkSession, d: str) -> DataFrame:
    s = E.method_summary(E.results_long(matching_results(spark, d)))
    return s.select("method", "metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def win_loss(spark: SparkSession, d: str) -> DataFrame:
    return E.win_loss_tie(E.results_long(matching_results(spark, d)), challenger="token", base="lexical")


def improve(spark: SparkSession, d: str) -> DataFrame:
    i = E.improvement(E.results_long(matching_results(spark, d)), better="token", base="lexical")
    return i.select("dataset", "metric", F.round("improvement", 9).alias("improvement"))


def best_method(spark: SparkSession, d: str) -> DataFrame:
    return E.best_method_per_metric(E.results_long(matching_results(spark, d)), challenger="token", base="lexical")


def results_wide(spark: SparkSession, d: str) -> DataFrame:
    return E.results_wide(E.results_long(matching_results(spark, d)), ["lexical", "token"])


def cross_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(train, test, accuracy, f1) of every two datasets: the train dataset's
    mapping applied to the test dataset's sources (A13 counts from an equi-join on
    the source name; datasets that share no source have F1 0)."""
    src = mapping_sources(spark, d)
    tr = src.select(F.col("dataset").alias("train"), "source", F.col("true_target").alias("_p"))
    te = src.select(F.col("dataset").alias("test"), "source", F.col("true_target").alias("_t"))
    common = tr.join(te, "source").groupBy("train", "test").agg(
        F.count(F.lit(1)).alias("_common"), F.count_if(F.col("_p") == F.col("_t")).alias("_tp"))
    sizes = src.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    # every two datasets, from the list of datasets (the configuration's size)
    listed = sizes.agg(F.collect_list(F.struct("dataset", "_n")).alias("ds"))
    both = (listed.select("ds", F.explode("ds").alias("a")).select("a", F.explode("ds").alias("b"))
            .select(F.col("a.dataset").alias("train"), F.col("a._n").alias("_ntr"), F.col("b.dataset").alias("test"), F.col("b._n").alias("_nte")))
    j = both.join(common, ["train", "test"], "left").na.fill(0, ["_common", "_tp"])
    tp, fn = F.col("_tp"), F.col("_nte") - F.col("_tp")
    tn = F.col("_ntr") - F.col("_common")
    n = F.col("_nte") + F.col("_ntr") - F.col("_common")
    m = E.prf(tp, F.lit(0), fn)
    return j.select("train", "test", F.round((tp + tn) / n, 9).alias("accuracy"), F.round(m["f1"], 9).alias("f1"))


def cross_matrix(spark: SparkSession, d: str) -> DataFrame:
    return cross_pairs(spark, d)


def cross_matrix_wide(spark: SparkSession, d: str) -> DataFrame:
    """A21 pivoted: a row per train dataset, a column per test dataset."""
    return E.cross_matrix(cross_pairs(spark, d), "f1")


def generalise(spark: SparkSession, d: str) -> DataFrame:
    g = E.generalisation_summary(cross_pairs(spark, d), "f1")
    return g.select("train", *[F.round(c, 9).alias(c) for c in ["same_score", "mean_other", "drop"]])


def generalise_tests(spark: SparkSession, d: str) -> DataFrame:
    t = E.test_summary(cross_pairs(spark, d), "f1")
    return t.select("test", F.round("mean_from_others", 9).alias("mean_from_others"), "best_train", "worst_train")


def metric_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.metric_pairs(cross_pairs(spark, d), ["accuracy", "f1"])


def match_quality(spark: SparkSession, d: str) -> DataFrame:
    """A13 + J7 for the lexical method only."""
    r = matching_results(spark, d)
    return r.where(F.col("method") == "lexical")


# --- vector / fuzzy best match ----------------------------------------------------------------------
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Mean embedding per label: the targets (target, pos, vec), in label order."""
    e = table(spark, d, "embeddings")
    dims = F.posexplode("embedding").alias("i", "x")
    c = (e.select("label", dims).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
          .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")))
    return dense_codes(c, "label", "pos").join(c, "label").select(
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("target"), "pos", F.transform("v", lambda p: p["x"]).alias("vec"))


def best_match_vector(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    out = vector_best_match_join(e, "vec_id", "embedding", label_centroids(spark, d), threshold=0.3)
    return out.select("vec_id", "best_target", F.round("best_score", 6).alias("best_score"))


def best_match_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name")
    out = best_by(p, "p_name", type_targets(spark, d), 0.3, "lexical")
    return out.select("p_partkey", "best_target", F.round("best_score", 9).alias("best_score"))


def best_match_names(spark: SparkSession, d: str) -> DataFrame:
    """Every part's abbreviated text (vowels dropped) with its best match among all distinct (name, type)
    texts: a target list that grows with the table, so the sources meet it over q-grams."""
    full = F.concat_ws(" ", "p_name", F.lower("p_type"))
    p = table(spark, d, "part").select("p_partkey", full.alias("full"))
    targets = dense_codes(p.select(F.col("full").alias("target")).distinct(), "target", "pos")
    src = p.select("p_partkey", F.translate("full", "aeiou", "").alias("short"))
    out = fuzzy_best_match_join(src, "short", targets, 0.55)
    return out.select("p_partkey", "short", "best_target", F.round("best_score", 9).alias("best_score"))


# --- classification metrics on labels x documents ----------------------------------------------
LENGTH_THRESHOLD = 1000


def label_scores(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").select("doc_id", "quality")
    doc = table(spark, d, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id")
    return j.select("doc_id", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"),
                    (F.col("n_chars") >= LENGTH_THRESHOLD).cast("int").alias("prediction"))


def auc_exact(spark: SparkSession, d: str) -> DataFrame:
    a = roc_auc(label_scores(spark, d))
    return a.select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


def class_report_q(spark: SparkSession, d: str) -> DataFrame:
    r = class_report(label_scores(spark, d))
    return r.select("class", *[F.round(c, 9).alias(c) for c in ["precision", "recall", "f1"]], "support")


def stratified_split_q(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return stratified_split(o, "o_orderstatus", "o_orderkey", 0.2, 42).select("o_orderkey", "o_orderstatus", "is_test")


# --- code-book sections over document lines -----------------------------------------------------
# --- fixed values: section markers and rules for the documents table ---
DOC_HEADERS = {"All rights reserved.": "rights", "Licensed under CC BY-NC 4.0.": "licensed"}
DOC_RULES = {
    "body": ("next_not_code", r"[A-Z][A-Z!. ]{2,}"),
    "rights": ("pair", r"[A-Z][a-z]+\."),
    "licensed": ("inline", r"^([A-Z][a-z]+)\s+(.+)$"),
}


def section_extract(spark: SparkSession, d: str) -> DataFrame:
    items = items_from_text(table(spark, d, "documents"), "doc_id", "text")
    return extract_sections(items, DOC_HEADERS, DOC_RULES, default_section="body")


def column_types(spark: SparkSession, d: str) -> DataFrame:
    """N6 over every catalog column name."""
    cat = M.part_catalog(spark, d)
    return cat.select("city", "column_final", classify_column(F.col("column_final")).alias("column_type"))
