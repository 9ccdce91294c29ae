"""Smaller operators: projections, filters, label maps, method comparison tables, sinks."""

import os

import pytest
from pyspark.sql import functions as F

from schemaweave.operators import evaluate as E
from schemaweave.operators.catalog import column_subset_check, normalize_catalog
from schemaweave.operators.clean import (ensure_canonical, filter_isin, filter_label, label_map, presentation_rank,
                                         project_final, rename_to_canonical, route_by_type, select_available)
from schemaweave.operators.pairs import merge_scores
from schemaweave.sources.readers import read_table


def test_projections_and_filters(spark):
    df = spark.createDataFrame([("1", "a", 1), ("2", "b", 0)], "ID string, Block string, is_match int")
    r = rename_to_canonical(df, {"ID": "incident_id", "Nope": "x"})
    assert r.columns == ["incident_id", "Block", "is_match"]
    assert "case_number" in ensure_canonical(r).columns
    assert select_available(r, ["Block", "missing"], "is_match").columns == ["Block", "is_match"]
    with pytest.raises(ValueError):
        project_final(r, ["Block", "missing"])
    assert filter_label(r, 1).count() == 1
    keep = spark.createDataFrame([("a",)], "v string")
    assert filter_isin(r, "Block", keep).count() == 1 and filter_isin(r, "Block", ["a", "b"]).count() == 2


def test_label_map_and_rank(spark):
    df = spark.createDataFrame([("lexical_jaccard",), ("other",)], "m string")
    out = df.select(label_map("m", {"lexical_jaccard": "Lexical (Jaccard)"}).alias("l"),
                    presentation_rank("m", ["x", "lexical_jaccard"]).alias("r")).collect()
    assert [(x["l"], x["r"]) for x in out] == [("Lexical (Jaccard)", 2), ("other", 0)]


def test_route_and_subset(spark):
    cat = spark.createDataFrame([("a", "ID"), ("a", "Case Number"), ("a", "Date"), ("b", "DR_NO"), ("c", "zzz")],
                                "dataset string, column string")
    got = {r["dataset"]: r["dataset_type"] for r in route_by_type(cat).collect()}
    assert got == {"a": "chicago", "b": "unknown", "c": "unknown"}
    df = spark.createDataFrame([(["a", "b"],)], "cols array<string>")
    assert df.select(column_subset_check(F.col("cols"), ["a"])).first()[0] is True


def test_normalize_catalog_duplicates(spark):
    cat = spark.createDataFrame([("x", "Case Number"), ("x", "case_number"), ("y", "Case Number"), ("x", "  ")],
                                "city string, name string")
    rows = {(r["city"], r["name"]): r for r in normalize_catalog(cat, "name", ["city"]).collect()}
    assert rows[("x", "Case Number")]["normalized_is_duplicate"] and rows[("x", "case_number")]["normalized_is_duplicate"]
    assert not rows[("y", "Case Number")]["normalized_is_duplicate"]
    assert rows[("x", "  ")]["normalized_is_empty"]


def test_merge_scores_renames_and_requires_keys(spark):
    lex = spark.createDataFrame([("a", "b", "l", "r", 0.5)], "left_city string, right_city string, left_column string, "
                                                             "right_column string, lexical_jaccard double")
    emb = spark.createDataFrame([("a", "b", "l", "r", 0.9)], "left_city string, right_city string, "
                                                             "left_column_final string, right_column_final string, "
                                                             "embedding_header_only_cosine double")
    assert merge_scores(lex, emb).count() == 1
    with pytest.raises(ValueError):
        merge_scores(lex.drop("left_city"), emb)


def test_method_comparison_tables(spark):
    rows = [("d1", "lexical", 0.5, 0.4, 0.3, 0.2), ("d1", "token", 0.7, 0.4, 0.3, 0.3),
            ("d2", "lexical", 0.6, 0.6, 0.6, 0.6), ("d2", "token", 0.6, 0.9, 0.6, 0.6)]
    res = spark.createDataFrame(rows, "dataset string, method string, precision double, accuracy double, "
                                      "recall double, f1 double")
    long = E.results_long(res)
    assert long.count() == 16
    wide = E.results_wide(long, ["lexical", "token"]).where("dataset = 'd1'").first()
    assert wide["token_precision"] == 0.7
    imp = {(r["dataset"], r["metric"]): r["improvement"] for r in E.improvement(long, "token", "lexical").collect()}
    assert imp[("d2", "accuracy")] == pytest.approx(0.3)
    best = {r["metric"]: r["best_method"] for r in E.best_method_per_metric(long, "token", "lexical").collect()}
    assert best["precision"] == "token" and best["recall"] == "lexical"
    wlt = {r["outcome"]: r["count"] for r in E.win_loss_tie(long, "token", "lexical").collect()}
    assert wlt == {"token": 3, "tie": 5}
    summ = {(r["method"], r["metric"]): r for r in E.method_summary(long).collect()}
    assert summ[("lexical", "f1")]["mean"] == pytest.approx(0.4) and summ[("lexical", "f1")]["std"] == pytest.approx(0.2)


def test_cross_dataset_tables(spark):
    rows = [("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.2), ("b", "b", 0.8)]
    pp = spark.createDataFrame(rows, "train string, test string, f1 double")
    m = E.cross_matrix(pp, "f1").where("train = 'a'").first()
    assert m["b"] == 0.5
    g = {r["train"]: r for r in E.generalisation_summary(pp, "f1").collect()}
    assert g["a"]["drop"] == pytest.approx(0.5)
    t = {r["test"]: r for r in E.test_summary(pp, "f1").collect()}
    assert t["a"]["best_train"] == "b" and E.metric_pairs(pp, ["f1"]).count() == 2


def test_pivot_and_type_counts(spark):
    rows = [("c1", "c2", "incident_id", "case_id", 1), ("c1", "c2", "x", "y", 0), ("c1", "c3", "date", "area", 0)]
    lab = spark.createDataFrame(rows, "left_city string, right_city string, left_column_final string, "
                                      "right_column_final string, is_match int")
    piv = {r["city_pair"]: (r["non_match"], r["match"]) for r in E.match_pivot(lab).collect()}
    assert piv == {"c1 — c2": (1, 1), "c1 — c3": (1, 0)}
    types = {r["column_type"]: r["count"] for r in E.value_counts(E.true_match_column_types(lab), "column_type")
             .collect()}
    assert types == {"code_or_id": 2}


def test_read_table_partition_filter(spark, tmp_dir):
    df = spark.createDataFrame([("1", "la"), ("2", "sf")], "incident_id string, dataset_source string")
    path = os.path.join(tmp_dir, "t")
    df.write.partitionBy("dataset_source").parquet(path)
    assert read_table(spark, path, source="sf").count() == 1 and read_table(spark, path, limit=1).count() == 1
