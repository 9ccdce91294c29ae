"""MLlib plans (rows only) and the streaming incremental load."""

import os

import __spark_entry__ as entry
from schemaweave.constants import CANONICAL_COLUMNS
from schemaweave.operators.clean import CleanSpec
from schemaweave.streaming.incremental import start_incremental_load

SF = "/root/testdata/sf0.001"


def test_model_queries(spark):
    qs = entry.queries()
    summary = qs["logreg"](spark, SF).collect()
    assert {r["model"] for r in summary} == {"Logistic Regression", "Random Forest"}
    assert all(0.0 <= r["accuracy"] <= 1.0 for r in summary)
    report = {r["class"] for r in qs["forest"](spark, SF).collect()}
    assert {"accuracy", "macro avg", "weighted avg"} <= report
    imp = qs["importance"](spark, SF).collect()
    assert 0 < len(imp) <= 10 and sum(r["importance"] for r in imp) <= 1.0 + 1e-9
    assert qs["kmeans"](spark, SF).count() >= 0


def test_features_full_shape(spark):
    f = entry.queries()["features_full"](spark, SF)
    rows = f.collect()
    assert rows and "district_hour_crime_count" in f.columns
    assert all(r[c] is not None for r in rows for c in f.columns)


def test_streaming_incremental_load(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as fh:
        fh.write("DR_NO,DATE OCC,AREA\n1,2016-05-03 10:00,7\n2,2016-05-04 11:00,8\n1,2016-05-03 10:00,7\n")
    spec = CleanSpec(candidates={"incident_id": ["DR_NO"], "incident_datetime": ["DATE OCC"], "district": ["AREA"]})
    schema = spark.read.option("header", True).csv(src).schema
    table = os.path.join(tmp_dir, "incidents")
    q = start_incremental_load(spark, src, schema, spec, table, "la", checkpoint=os.path.join(tmp_dir, "ck"),
                               trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(table)
    assert set(CANONICAL_COLUMNS) <= set(out.columns) and out.count() == 2
