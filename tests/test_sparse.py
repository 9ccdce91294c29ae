"""Sparse scores against the table of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from schemaweave.constants import PAIR_KEY
from schemaweave.operators import evaluate as E
from schemaweave.operators import sparse as SP
from schemaweave.operators.pairs import attach_context, candidate_pairs, last_descriptions, pairs_with_context
from schemaweave.operators.similarity import score_pairs
from schemaweave.plans.matching import written

CONTEXT = "embedding_header_context_cosine"


def catalog(spark, seed, cities=4, per=14, words=9):
    rng = random.Random(seed)
    vocabulary = ["id", "date", "case_number", "lat", "x", "desc", "type text", "ünit", "a b", "zone"][:words]
    rows = []
    for c in range(cities):
        names = set()
        while len(names) < rng.randrange(2, per):
            names.add("_".join(rng.choices(vocabulary, k=rng.randrange(0, 4))))
        for i, n in enumerate(sorted(names)):
            rows.append((f"c{c}", f"{9 - c if seed % 2 else c}", n.upper(), n, rng.choice([None, "", "the time", "the place of it", "code", "qq"]), i))
    rows.append(rows[0][:3] + (rows[0][3], "another description", 99))  # a name twice in a dataset: the last description holds
    return written(spark, "catalog", spark.createDataFrame(rows, "city string, ds_order string, column_original string, column_final string, description string, pos long"))


def everything(cat, max_features):
    """The table of all pairs with scores and labels."""
    s = score_pairs(written(cat.sparkSession, "texts", pairs_with_context(cat)), max_features)
    s = s.withColumns({c: F.round(c, 9) for c in SP.SCORES})
    d = last_descriptions(cat)
    l = d.withColumnsRenamed({"city": "left_city", "column_final": "left_column_final", "description": "_l"})
    r = d.withColumnsRenamed({"city": "right_city", "column_final": "right_column_final", "description": "_r"})
    return (s.join(l, ["left_city", "left_column_final"]).join(r, ["right_city", "right_column_final"])
            .withColumn("is_match", (F.col("_l") == F.col("_r")).cast("int")).drop("_l", "_r"))


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    """(catalog, its sparse scores, the table of all pairs); the second has few terms, so most pairs score 0."""
    few = request.param == 2
    cat = catalog(spark, request.param, words=4 if few else 10)
    s = SP.sparse_scores(cat, lambda name, df: written(spark, name, df), max_features=12 if few else 100)
    return cat, s, written(spark, "everything", everything(cat, 12 if few else 100))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_pairs_and_weights(case):
    cat, s, full = case
    cols = [*PAIR_KEY, *SP.SCORES, "exact_match", "is_match"]
    assert rows(SP.all_pairs_scored(s), *cols) == rows(full, *cols)
    assert s.total == full.count() == SP.weighted_pairs(s).agg(F.sum("n")).first()[0]
    listed = full.where(" or ".join(f"{c} <> 0" for c in [*SP.SCORES, "exact_match", "is_match"]))
    assert rows(SP.expand(s, s.pairs), *cols) == rows(listed, *cols)
    assert s.pairs.where(" and ".join(f"{c} = 0" for c in [*SP.SCORES, "exact_match", "is_match"])).count() == 0
    old = attach_context(candidate_pairs(cat), cat)
    assert rows(pairs_with_context(cat), *old.columns) == rows(old, *old.columns)


def test_metric_tables(case):
    _, s, full = case
    w = SP.weighted_pairs(s)
    for got, want in ((E.metrics_table(w, weight="n"), E.metrics_table(full)), (E.f1_by_type(w, weight="n"), E.f1_by_type(full)),
                      (E.score_histogram(w, weight="n"), E.score_histogram(full)), (E.threshold_sweep(w, weight="n"), E.threshold_sweep(full)),
                      (E.match_pivot(SP.labels_per_grid(s), weight="n"), E.match_pivot(full))):
        assert rows(got, *want.columns) == rows(want, *want.columns)
    types = lambda df, **kw: rows(E.value_counts(E.true_match_column_types(df, **kw), "column_type", **kw), "column_type", "count")
    assert types(w.withColumnsRenamed({"u_final": "left_column_final", "v_final": "right_column_final"}), weight="n") == types(full)


def test_a_thousand_thresholds(case):
    _, s, full = case
    full = full.collect()
    rng = random.Random(0)
    grid = sorted({-0.5, 0.0, 1.0, 1.5, *[r[c] for r in full[:50] for c in SP.SCORES], *[rng.random() for _ in range(900)]})
    got = {(r.score_column, r.threshold): (r.tp, r.fp, r.fn) for r in E.threshold_sweep(SP.weighted_pairs(s), weight="n", grid=grid).collect()}
    assert len(got) == 3 * len(grid)
    for c in SP.SCORES:
        for t in grid[::37] + grid[:3] + grid[-3:]:
            hit = [r for r in full if r[c] >= t]
            tp = sum(r.is_match for r in hit)
            assert got[c, t] == (tp, len(hit) - tp, sum(r.is_match for r in full) - tp)


def test_null_scores_reach_no_threshold(spark):
    df = spark.createDataFrame([(None, 0.5, 0.1, 1), (0.5, None, 0.5, 0), (0.4999, 0.7, None, 1)], "lexical_jaccard double, embedding_header_only_cosine double, embedding_header_context_cosine double, is_match int")
    got = {(r.score_column, r.threshold): (r.tp, r.fp, r.fn) for r in E.threshold_sweep(df, grid=[0.5]).collect()}
    assert got == {("lexical_jaccard", 0.5): (0, 1, 2), ("embedding_header_only_cosine", 0.5): (2, 0, 0), ("embedding_header_context_cosine", 0.5): (0, 1, 2)}


def test_ranked_views(case):
    _, s, full = case
    listed, cols = full.collect(), [*PAIR_KEY, *SP.SCORES, "is_match"]
    for by, n, label, ascending in [(CONTEXT, n, label, up) for n in (7, 5000) for label in (None, 0, 1) for up in (False, True)] + [(SP.SCORES[0], 40, None, False)]:
        part = [r for r in listed if label is None or r.is_match == label]
        want = sorted(part, key=lambda r: (r[by] if ascending else -r[by], *[r[k] for k in PAIR_KEY]))[:n]
        got = SP.top_pairs(s, by, n, label, ascending).select(*cols).collect()
        assert sorted(map(tuple, got)) == sorted(tuple(r[c] for c in cols) for r in want), (by, n, label, ascending)
    for n in (3, 60):
        got = E.ground_truth_template(SP.top_per_grid(s, CONTEXT, n), n, CONTEXT)
        want = E.ground_truth_template(full, n, CONTEXT)
        assert rows(got, *want.columns) == rows(want, *want.columns)


def test_no_columns_and_one_dataset(spark):
    cat = catalog(spark, 1)
    for few in (cat.limit(0), cat.where("city = 'c1'")):
        s = SP.sparse_scores(few, lambda name, df: written(spark, name, df))
        assert s.total == 0 and s.pairs.count() == 0 and SP.weighted_pairs(s).count() == 0 and SP.top_pairs(s, CONTEXT, 5).count() == 0
        assert E.metrics_table(SP.weighted_pairs(s), weight="n").select("tp", "fp", "fn").distinct().collect() == [(0, 0, 0)]
