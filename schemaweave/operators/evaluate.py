"""Evaluation of scored pairs against labels, and of column mappings.

Every metric table is one aggregate pass: per method and threshold the
confusion counts are conditional counts in a single ``agg``, then unpivoted;
a sweep counts scores per bucket of the threshold grid and sums over buckets.
``weight`` names a column with the number of pairs that a row stands for.  Top-k views use ``orderBy().limit()`` (distributed top-k)
or a row_number filter that becomes a WindowGroupLimit below the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweave.constants import FIXED_THRESHOLDS, PAIR_KEY, SCORE_METHODS
from schemaweave.functions.classify import classify_column, classify_error, pair_column_type
from schemaweave.functions.text import pair_key
from schemaweave.operators.clean import clean_label, predict

SCORE_COLUMNS = [s for s, _, _ in SCORE_METHODS]


def _safe_div(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p = _safe_div(tp.cast("double"), (tp + fp).cast("double"))
    r = _safe_div(tp.cast("double"), (tp + fn).cast("double"))
    f1 = _safe_div(2 * p * r, p + r)
    return {"precision": p, "recall": r, "f1": f1}


# --- J5 + P10 ---------------------------------------------------------------------------
def labelled_scores(scores: DataFrame, truth: DataFrame,
                    score_cols: Sequence[str] = SCORE_COLUMNS) -> DataFrame:
    """Inner join of scores with the cleaned labels (columns pruned first)."""
    t = truth.select(*PAIR_KEY, clean_label("is_match").alias("is_match"))
    return scores.select(*PAIR_KEY, *score_cols).join(t, PAIR_KEY, "inner")


def _count(condition: Column, weight: str | None) -> Column:
    return F.count_if(condition) if weight is None else F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))


def _rows(weight: str | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def _confusion_aggs(df_label: str, specs: Sequence[tuple[str, str, float]], weight: str | None = None) -> list[Column]:
    y = F.col(df_label)
    out = []
    for i, (_, score, t) in enumerate(specs):
        p = predict(score, t)
        out += [_count((p == 1) & (y == 1), weight).alias(f"tp{i}"),
                _count((p == 1) & (y == 0), weight).alias(f"fp{i}"),
                _count((p == 0) & (y == 1), weight).alias(f"fn{i}")]
    return out


def _unpivot_confusion(agg: DataFrame, specs: Sequence[tuple[str, str, float]],
                       extra: dict[str, Sequence] | None = None, group: Sequence[str] = ()) -> DataFrame:
    extra = extra or {}
    rows = F.array(*[F.struct(
        F.lit(m).alias("method"), F.lit(s).alias("score_column"), F.lit(float(t)).alias("threshold"),
        *[F.lit(v[i]).alias(k) for k, v in extra.items()],
        F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"))
        for i, (m, s, t) in enumerate(specs)])
    long = agg.select(*group, F.inline(rows))
    m = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return long.select(*group, "method", "score_column", *extra.keys(), "threshold",
                       m["precision"].alias("precision"), m["recall"].alias("recall"), m["f1"].alias("f1"),
                       F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
                       F.col("fn").cast("bigint").alias("fn"))


# --- A7 + A8 ---------------------------------------------------------------------------------
def metrics_table(labelled: DataFrame, methods: Sequence[tuple[str, str, float]] | None = None,
                  weight: str | None = None) -> DataFrame:
    """Confusion metrics for (method, score column, threshold) triples in one pass."""
    if methods is None:
        methods = [(m, s, FIXED_THRESHOLDS[s]) for s, m, _ in SCORE_METHODS]
    agg = labelled.agg(*_confusion_aggs("is_match", methods, weight))
    return _unpivot_confusion(agg, methods)


# --- A9 ----------------------------------------------------------------------------------------
def threshold_grid(start: float = 0.1, end: float = 0.9, step: float = 0.1) -> list[float]:
    out, t = [], start
    while t <= end + 1e-9:
        out.append(round(t, 2))
        t += step
    return out


def thresholds_reached(score: Column, grid: Sequence[float]) -> Column:
    """How many thresholds of the ascending ``grid`` are <= ``score`` (a null score reaches none):
    a binary search whose steps are powers of two, so its cost is the logarithm of the grid."""
    steps, step = [], 1
    while step <= len(grid):
        steps.insert(0, step)
        step *= 2
    listed = F.array(*[F.lit(float(t)) for t in grid])
    search = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, x: F.when(
        (at + x <= len(grid)) & (F.get(listed, F.least(at + x, F.lit(len(grid))) - 1) <= score), at + x).otherwise(at))
    return F.coalesce(search, F.lit(0)) if steps else F.lit(0)


def threshold_sweep(labelled: DataFrame, start: float = 0.1, end: float = 0.9, step: float = 0.1,
                    weight: str | None = None, grid: Sequence[float] | None = None) -> DataFrame:
    """Metrics for every (threshold, method): rows are counted once per method, label and number of
    thresholds that they reach; a threshold's predictions are the sum over the buckets from it on."""
    grid = sorted(set(threshold_grid(start, end, step) if grid is None else map(float, grid)))
    long = labelled.select("is_match", F.lit(1).alias("_w") if weight is None else F.col(weight).alias("_w"), F.inline(F.array(*[
        F.struct(F.lit(label).alias("method"), F.lit(s).alias("score_column"), F.col(s).cast("double").alias("score"))
        for s, _, label in SCORE_METHODS])))
    buckets = (long.withColumn("bucket", thresholds_reached(F.col("score"), grid)).groupBy("method", "score_column", "bucket")
               .agg(_count(F.col("is_match") == 1, "_w").alias("m"), _count(F.col("is_match") == 0, "_w").alias("o")))
    # one bucket per threshold and one below the first, also where nothing lies in it
    every = F.explode(F.sequence(F.lit(0), F.lit(len(grid)))).alias("bucket")
    methods = labelled.sparkSession.createDataFrame([(label, s) for s, _, label in SCORE_METHODS], "method string, score_column string")
    full = methods.select("method", "score_column", every).join(buckets, ["method", "score_column", "bucket"], "left").na.fill(0, ["m", "o"])
    above = Window.partitionBy("method").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy("method")
    n = (full.withColumn("tp", F.sum("m").over(above)).withColumn("fp", F.sum("o").over(above)).withColumn("fn", F.sum("m").over(total) - F.col("tp"))
         .where(F.col("bucket") > 0).withColumn("threshold", F.get(F.array(*[F.lit(t) for t in grid]), F.col("bucket") - 1)))
    m = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.select("method", "score_column", "threshold", m["precision"].alias("precision"), m["recall"].alias("recall"), m["f1"].alias("f1"),
                    *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])


# --- A10 ---------------------------------------------------------------------------------------
def f1_by_type(labelled: DataFrame, weight: str | None = None) -> DataFrame:
    """F1 per pair column type (side types, or 'mixed') and method, with n; a ``column_type``
    column is taken as it is."""
    specs = [(m, s, FIXED_THRESHOLDS[s]) for s, m, _ in SCORE_METHODS]
    typed = labelled if "column_type" in labelled.columns else labelled.withColumn(
        "column_type", pair_column_type(F.col("left_column_final"), F.col("right_column_final")))
    agg = typed.groupBy("column_type").agg(_rows(weight).alias("_n"), *_confusion_aggs("is_match", specs, weight)).withColumnRenamed("_n", "n")
    out = _unpivot_confusion(agg, specs, group=["column_type", "n"])
    return out.select("column_type", "method", "f1", F.col("n").cast("bigint").alias("n"))


# --- U4 + N6 + A5 --------------------------------------------------------------------------------
def true_match_column_types(labelled: DataFrame, weight: str | None = None) -> DataFrame:
    """Each true match gives two rows: (left name, type), (right name, type)."""
    t = labelled.where(F.col("is_match") == 1)
    kept = [] if weight is None else [weight]
    sides = F.array(F.struct(F.col("left_column_final").alias("column_name")),
                    F.struct(F.col("right_column_final").alias("column_name")))
    return (t.select(*kept, F.inline(sides))
             .select("column_name", classify_column(F.col("column_name")).alias("column_type"), *kept))


def value_counts(df: DataFrame, col: str, weight: str | None = None) -> DataFrame:
    return df.groupBy(col).agg(_rows(weight).alias("count")).orderBy(F.desc("count"), col)


# --- W3 + W4 + N21 -------------------------------------------------------------------------------
def ground_truth_template(scores: DataFrame, top_n: int = 300,
                          by: str = "embedding_header_context_cosine") -> DataFrame:
    """Top-n pairs per dataset pair by ``by`` (ties by key), empty label columns."""
    w = Window.partitionBy("_pk").orderBy(F.desc(by), *[F.asc(k) for k in PAIR_KEY])
    keep = [*PAIR_KEY, *[c for c in ["lexical_jaccard", "exact_match", *SCORE_COLUMNS[1:]] if c in scores.columns]]
    ranked = scores.withColumn("_pk", pair_key("left_city", "right_city")).withColumn("_rn", F.row_number().over(w))
    return (ranked.where(F.col("_rn") <= top_n)
                  .select(*keep, F.lit(None).cast("int").alias("is_match"), F.lit("").alias("match_notes")))


# --- W5 ------------------------------------------------------------------------------------------
def precision_at_k(labelled: DataFrame | Callable[[str, int], DataFrame], ks: Sequence[int] = (10, 20, 50, 100)) -> DataFrame:
    """Share of true matches among the k best pairs per method (ties by key).

    Each method's top max(k) is a distributed top-k (TakeOrderedAndProject) of the
    labelled pairs, or what a function of (score column, n) returns; only those <=
    3*max(k) rows are ranked."""
    kmax = max(ks)
    tops = None
    for score, _, label in SCORE_METHODS:
        best = (labelled.orderBy(F.desc(score), *[F.asc(k) for k in PAIR_KEY]).limit(kmax) if isinstance(labelled, DataFrame)
                else labelled(score, kmax))
        top = best.select(*PAIR_KEY, F.col(score).alias("score"), "is_match").withColumn("method", F.lit(label))
        tops = top if tops is None else tops.unionByName(top)
    ranked = tops.withColumn("_rn", F.row_number().over(
        Window.partitionBy("method").orderBy(F.desc("score"), *[F.asc(k) for k in PAIR_KEY])))
    aggs = []
    for k in ks:
        aggs.append(F.struct(F.lit(k).alias("k"), _safe_div(
            F.sum(F.when(F.col("_rn") <= k, F.col("is_match")).otherwise(0)).cast("double"),
            F.least(F.lit(k), F.count(F.lit(1))).cast("double")).alias("precision_at_k")))
    per = ranked.groupBy("method").agg(F.array(*aggs).alias("_a"))
    return per.select("method", F.inline("_a")).select("method", F.col("k").cast("bigint").alias("k"),
                                                       "precision_at_k")


# --- A14 -----------------------------------------------------------------------------------------
def score_histogram(labelled: DataFrame, bins: int = 20, weight: str | None = None) -> DataFrame:
    """Density histogram per (method, label): range = the group's min..max
    (a constant group uses [v-0.5, v+0.5]); the maximum falls in the last bin;
    every bin is reported, empty ones with 0."""
    long = labelled.select("is_match", F.lit(1).alias("_w") if weight is None else F.col(weight).alias("_w"), F.inline(F.array(*[
        F.struct(F.lit(label).alias("method"), F.col(s).cast("double").alias("score"))
        for s, _, label in SCORE_METHODS])))
    bounds = long.groupBy("method", "is_match").agg(F.min("score").alias("_mn"), F.max("score").alias("_mx"),
                                                   F.sum("_w").alias("_n"))
    lo = F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn"))
    hi = F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx"))
    bounds = bounds.select("method", "is_match", "_n", lo.alias("lo"), hi.alias("hi"))
    # one row per (method, label): bounded, so the broadcast is safe
    b = long.join(F.broadcast(bounds), ["method", "is_match"])
    idx = F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = b.groupBy("method", "is_match", idx.cast("int").alias("bin")).agg(F.sum("_w").alias("count"))
    grid = bounds.select("method", "is_match", "_n", "lo", "hi",
                         F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    out = grid.join(counts, ["method", "is_match", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.select("method", "is_match", F.col("bin").cast("bigint").alias("bin"),
                      (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                      (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.col("count").cast("bigint").alias("count"),
                      (F.col("count") / (F.col("_n") * width)).alias("density"))


# --- W6, W7, W8, N7 ---------------------------------------------------------------------------------
def _error_view(df: DataFrame) -> DataFrame:
    return df.select(*PAIR_KEY, *[F.round(s, 3).alias(s) for s in SCORE_COLUMNS],
                     "is_match", F.lit("").alias("note"))


def top_false_positives(labelled: DataFrame, n: int = 10,
                        by: str = "embedding_header_context_cosine") -> DataFrame:
    return _error_view(_first(labelled, 0, F.desc(by), n))


def top_false_negatives(labelled: DataFrame, n: int = 10,
                        by: str = "embedding_header_context_cosine") -> DataFrame:
    return _error_view(_first(labelled, 1, F.asc(by), n))


def error_types(labelled: DataFrame, n: int = 200, by: str = "embedding_header_context_cosine") -> DataFrame:
    typed = _first(labelled, 0, F.desc(by), n).select(classify_error(
        F.col("left_column_final"), F.col("right_column_final"), F.col("lexical_jaccard"), F.col(by)).alias("error_type"))
    return typed.groupBy("error_type").agg(F.count(F.lit(1)).alias("count"))


def _first(labelled: DataFrame, label: int, order: Column, n: int) -> DataFrame:
    """The first ``n`` pairs of a label, ties by key."""
    return labelled.where(F.col("is_match") == label).orderBy(order, *[F.asc(k) for k in PAIR_KEY]).limit(n)


# --- A6 --------------------------------------------------------------------------------------------
def match_pivot(labelled: DataFrame, weight: str | None = None) -> DataFrame:
    """Per dataset pair: count of label 0 and label 1 (missing -> 0)."""
    keyed = labelled.withColumn("city_pair", pair_key("left_city", "right_city", " — "))
    p = keyed.groupBy("city_pair").pivot("is_match", [0, 1]).agg(_rows(weight))
    return p.select("city_pair", F.coalesce(F.col("0"), F.lit(0)).cast("bigint").alias("non_match"),
                    F.coalesce(F.col("1"), F.lit(0)).cast("bigint").alias("match"))


# --- W11, W12, P15 ------------------------------------------------------------------------------------
def sweep_curves(sweep: DataFrame) -> DataFrame:
    return sweep.select("method", "threshold", "precision", "recall", "f1").orderBy("method", "threshold")


def metric_bars(metrics: DataFrame, methods: Sequence[str], labels: dict[str, str]) -> DataFrame:
    from schemaweave.operators.clean import label_map, presentation_rank
    kept = metrics.where(F.col("method").isin(list(methods)))
    return (kept.select(label_map("method", labels).alias("method_label"),
                        presentation_rank("method", list(methods)).alias("rank"),
                        "f1", "precision", "recall", "tp", "fp", "fn").orderBy("rank"))


# --- J7 + A13 ---------------------------------------------------------------------------------------
def match_quality(true_map: DataFrame, pred_map: DataFrame, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """Accuracy / precision / recall / F1 of a predicted source->target mapping.

    Full outer join on (group, source): truth = has a true target, prediction =
    predicted target equals the true one.
    """
    t = true_map.select(*group, "source", F.col("target").alias("_t"))
    p = pred_map.select(*group, "source", F.col("target").alias("_p"))
    j = t.join(p, [*group, "source"], "full_outer")
    yt = F.col("_t").isNotNull()
    yp = F.coalesce(F.col("_p").isNotNull() & (F.col("_p") == F.col("_t")), F.lit(False))
    agg = j.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(yt & yp).alias("_tp"), F.count_if(~yt & yp).alias("_fp"),
        F.count_if(yt & ~yp).alias("_fn"), F.count_if(~yt & ~yp).alias("_tn"))
    m = prf(F.col("_tp"), F.col("_fp"), F.col("_fn"))
    return agg.select(*group, _safe_div((F.col("_tp") + F.col("_tn")).cast("double"),
                                        F.col("_n").cast("double")).alias("accuracy"),
                      m["precision"].alias("precision"), m["recall"].alias("recall"), m["f1"].alias("f1"))


# --- A15 - A20: method comparison over results_long (dataset, method, metric, value) ------------------
METRICS = ["precision", "accuracy", "recall", "f1"]


def results_long(results: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    return results.select("dataset", "method", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


def results_wide(long: DataFrame, methods: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    keyed = long.withColumn("mm", F.concat_ws("_", "method", "metric"))
    values = [f"{a}_{m}" for a in methods for m in metrics]
    return keyed.groupBy("dataset").pivot("mm", values).agg(F.first("value"))


def method_summary(long: DataFrame) -> DataFrame:
    return long.groupBy("method", "metric").agg(F.avg("value").alias("mean"),
                                                F.stddev_pop("value").alias("std"))


def improvement(long: DataFrame, better: str = "embedding", base: str = "lexical") -> DataFrame:
    return long.groupBy("dataset", "metric").agg(
        (F.max(F.when(F.col("method") == better, F.col("value")))
         - F.max(F.when(F.col("method") == base, F.col("value")))).alias("improvement"))


def best_method_per_metric(long: DataFrame, challenger: str = "embedding", base: str = "lexical") -> DataFrame:
    means = long.groupBy("metric").agg(
        F.avg(F.when(F.col("method") == challenger, F.col("value"))).alias("_c"),
        F.avg(F.when(F.col("method") == base, F.col("value"))).alias("_b"))
    return means.select("metric", F.when(F.col("_c") > F.col("_b"), F.lit(challenger))
                        .otherwise(F.lit(base)).alias("best_method"))


def win_loss_tie(long: DataFrame, challenger: str = "embedding", base: str = "lexical",
                 margin: float = 0.05) -> DataFrame:
    per = long.groupBy("dataset", "metric").agg(
        F.max(F.when(F.col("method") == challenger, F.col("value"))).alias("_c"),
        F.max(F.when(F.col("method") == base, F.col("value"))).alias("_b"))
    outcome = (F.when(F.col("_c") > F.col("_b") + margin, F.lit(challenger))
                .when(F.col("_b") > F.col("_c") + margin, F.lit(base)).otherwise(F.lit("tie")))
    return per.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("count"))


def best_challenger_vs_base(metrics: DataFrame, base: str, metric: str = "f1") -> DataFrame:
    """Base method's metric, the best other method and its metric, and the gap
    (ties between other methods go to the larger name)."""
    other = F.col("method") != base
    out = metrics.agg(
        F.max(F.when(~other, F.col(metric))).alias("base_value"),
        F.max_by(F.col("method"), F.when(other, F.struct(F.col(metric), F.col("method")))).alias("best_method"),
        F.max(F.when(other, F.col(metric))).alias("best_value"))
    return out.select(F.lit(base).alias("base_method"), "base_value", "best_method", "best_value",
                      (F.col("best_value") - F.col("base_value")).alias("gap"))


# --- A21 - A23: train x test generalisation ------------------------------------------------------------
def cross_matrix(per_pair: DataFrame, metric: str) -> DataFrame:
    """Rows train, one column per test dataset."""
    return per_pair.groupBy("train").pivot("test").agg(F.first(metric))


def generalisation_summary(per_pair: DataFrame, metric: str) -> DataFrame:
    """Per train dataset: own score, mean over others, drop; best/worst tester."""
    other = F.col("train") != F.col("test")
    return per_pair.groupBy("train").agg(
        F.max(F.when(~other, F.col(metric))).alias("same_score"),
        F.avg(F.when(other, F.col(metric))).alias("mean_other"),
        (F.max(F.when(~other, F.col(metric))) - F.avg(F.when(other, F.col(metric)))).alias("drop"),
    )


def test_summary(per_pair: DataFrame, metric: str) -> DataFrame:
    other = F.col("train") != F.col("test")
    return per_pair.where(other).groupBy("test").agg(
        F.avg(metric).alias("mean_from_others"),
        F.max_by("train", F.struct(F.col(metric), F.col("train"))).alias("best_train"),
        F.min_by("train", F.struct(F.col(metric), F.col("train"))).alias("worst_train"))


def metric_pairs(per_pair: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return per_pair.where(F.col("train") != F.col("test")).select("train", "test", *metrics)
