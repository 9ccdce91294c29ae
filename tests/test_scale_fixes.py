import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaweave.functions.casting import date_plus_hhmm, parse_timestamp, to_float, to_int
from schemaweave.operators.catalog import validate
from schemaweave.operators.keyed import exclusive_running_sum, first_per_key
from schemaweave.operators.modeling import kmeans_clusters, roc_auc, stratified_split
from schemaweave.operators.pairs import candidate_pairs
from schemaweave.operators.similarity import score_pairs
from schemaweave.session import checkpoint_root
from schemaweave.sources.readers import read_csv_robust
from schemaweave.sources.sinks import load_counts, load_incidents


@pytest.mark.parametrize("n,parts", [(20_000, 8), (200_000, 8), (200_000, 32)])
def test_running_sum_and_auc_of_many_scores(spark, n, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(n).select(F.xxhash64("id").cast("double").alias("score"), (F.xxhash64("id", F.lit(1)) % 2 == 0).cast("int").alias("label"))
        rows = exclusive_running_sum(spark.range(n).select((F.col("id") * 7 % n).alias("o"), F.lit(1).alias("v")), "o", "v", "s")
        assert rows.where("o <> s").count() == 0 and rows.count() == n
        pdf = df.toPandas()
        rank = pdf.score.rank()
        pos = int(pdf.label.sum())
        want = (rank[pdf.label == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))
        assert [roc_auc(df).first()["auc"] for _ in range(2)] == [pytest.approx(want, abs=1e-12)] * 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_csv_keeps_short_rows_and_the_same_rows_for_any_columns(spark, tmp_dir):
    path = os.path.join(tmp_dir, "x.csv")
    with open(path, "w") as f:
        f.write('a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,11,12,\n13,"x,y",\n14\n')
    df = read_csv_robust(spark, path)
    want = [("1", "2", "3"), ("13", "x,y", None), ("14", None, None), ("4", "5", None)]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert df.count() == df.select("a").count() == len(df.select("c").collect()) == 4
    with open(path, "w") as f:
        f.write('a,b\n1,"two\nlines"\n2,x\n')
    assert sorted(map(tuple, read_csv_robust(spark, path, multi_line=True).collect())) == [("1", "two\nlines"), ("2", "x")]


def test_numbers_from_text(spark):
    text = ["12D", "10F", "nan", "Infinity", "9007199254740993", " 7 ", "10.0", "1.5", "-.5e1", "", None, "0x1A"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, s string")
    got = {r.i: (r.n, r.f) for r in rows.select("i", to_int("s").alias("n"), to_float("s").alias("f")).collect()}
    assert [got[i][0] for i in range(len(text))] == [None, None, None, None, 9007199254740993, 7, 10, None, -5, None, None, None]
    assert [got[i][1] for i in (0, 2, 7, 8, 11)] == [None, None, 1.5, -5.0, None]


def test_published_date_shapes(spark):
    rows = [("2010-01-25T00:00:00", "1350"), ("01/08/2020 12:00:00 AM", "2230"), ("2011-02-03", "5"), ("01/08/2020", None)]
    df = spark.createDataFrame(rows, "d string, t string").select("d", parse_timestamp(date_plus_hhmm("d", "t")).alias("ts"))
    assert {r.d: str(r.ts) for r in df.collect()} == {
        "2010-01-25T00:00:00": "2010-01-25 13:50:00", "01/08/2020 12:00:00 AM": "2020-01-08 22:30:00",
        "2011-02-03": "2011-02-03 00:05:00", "01/08/2020": "2020-01-08 00:00:00"}


def test_validate_an_empty_table(spark):
    r = validate(spark.createDataFrame([], "a int"), "e", ["a"]).first()
    assert (r.row_count, r.null_percentage, r.is_valid) == (0, None, False)


def test_loading_twice_inserts_once(spark, tmp_dir):
    rows = [("1", "x"), ("1", "x"), ("2", "y"), (None, "z"), (None, "z")]
    df = spark.createDataFrame(rows, "incident_id string, v string")
    path = os.path.join(tmp_dir, "incidents")
    first = load_counts(df, load_incidents(df, path, "s")).first()
    again = load_counts(df, load_incidents(df, path, "s")).first()
    assert tuple(first) == (5, 2, 3, 2) and tuple(again) == (5, 0, 5, 2)
    assert spark.read.parquet(path).count() == 2


def test_split_keeps_repeated_keys_and_null_labels(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 5), rnd.choice(["a", None]), i) for i in range(100)]
    out = stratified_split(spark.createDataFrame(rows, "k int, y string, i int"), "y", "k", 0.2, 42)
    got = out.collect()
    assert sorted(r.i for r in got) == list(range(100))
    for y in ("a", None):
        n = sum(r[1] == y for r in rows)
        assert sum(r.is_test for r in got if r.y == y) == round(0.2 * n)


def test_first_per_key_reads_its_input_once(spark, tmp_dir):
    spark.range(10).select((F.col("id") % 3).alias("k"), "id").write.parquet(tmp_dir + "/t")
    out = first_per_key(spark.read.parquet(tmp_dir + "/t"), ["k"], ["id"])
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, out.collect())) == [(0, 0), (1, 1), (2, 2)]


def test_kmeans_of_few_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 9.0, 9.0), (4, None, 1.0)], "id int, latitude double, longitude double")
    got = {r.id: r.location_cluster for r in kmeans_clusters(df, "id", restarts=2).collect()}
    assert got[1] == got[2] != got[3] and set(got) == {1, 2, 3}


def test_context_scores_of_names_that_share_nothing(spark):
    cols = "city string, ds_order string, column_original string, column_final string, description string, pos int"
    cat = spark.createDataFrame([("a", "a", "X", "alpha", "time of report", 0), ("b", "b", "Y", "beta", "time of report", 0)], cols)
    from schemaweave.operators.pairs import attach_context
    r = score_pairs(attach_context(candidate_pairs(cat), cat)).first()
    assert r.lexical_jaccard == 0 and r.embedding_header_only_cosine == 0 and r.embedding_header_context_cosine > 0.3


def test_checkpoint_folder_is_required_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        checkpoint_root(Session())


def test_la_tables_are_routed_by_hints():
    from schemaweave.operators.clean import detect_by_hints
    assert detect_by_hints(["TIME OCC", "Crm Cd Desc", "x"]) == "la_crimes"
    assert detect_by_hints(["Charge Description"]) == detect_by_hints(["Report ID", "Arrest Date"]) == "la_arrests"
    assert detect_by_hints(["DR Number", "Date Occurred"]) == "la_crimes" and detect_by_hints(["x"], fallback="unknown") == "unknown"


def test_a_format_is_tried_only_on_texts_of_its_shape(spark):
    from schemaweave.constants import TIMESTAMP_FORMATS
    from schemaweave.functions.casting import literal_shape, parse_timestamp

    texts = ["05/03/2016 11:40:00 PM", "05/03/2016 11:40:00 pm", "2016-05-03T10:11:12", "2016-05-03t10:11:12", "2016-05-03 10:11:12", "2016-05-03 10:11",
             "05/03/2016 10:11", "2016-05-03", "05/03/2016", " 05/03/2016 ", "1", "", None, "13/13/2016", "5/3/2016", "2016-5-3", "a-b-c", "x/y/z p:q:r s", "+12016-05-03"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(f)).cast("timestamp_ntz") for f in TIMESTAMP_FORMATS])
    rows = df.select("t", parse_timestamp("t").cast("string").alias("a"), plain.cast("string").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and sum(r.a is not None for r in rows) >= 9
    shapes = [literal_shape(f) for f in TIMESTAMP_FORMATS]
    assert sum(bool(spark.range(1).where(F.lit("1").like(s)).count()) for s in shapes) == 0  # "1" is parsed by no attempt
    assert literal_shape("yyyy[-MM]") is None


def test_loads_read_a_frame_cleaned_once(spark, monkeypatch):
    from schemaweave.plans import rows as R

    cleaned = R.canonical_orders(spark, "/root/testdata/sf0.001")
    names = []
    keep = R.written
    monkeypatch.setattr(R, "written", lambda s, n, df: names.append(n) or keep(s, n, df))
    assert R.load_twice(spark, "/root/testdata/sf0.001").count() == 4 and cleaned.count() > 0
    assert names == ["canonical-orders", "canonical-events"]


def test_rows_are_spread_over_the_cores(spark):
    from schemaweave.operators.modeling import spread

    df = spark.range(2000).selectExpr("id", "id % 7 as v").coalesce(1)
    out = spread(df, 2000, 500, 10_000)
    assert out.rdd.getNumPartitions() == min(4, spark.sparkContext.defaultParallelism) and sorted(out.collect()) == sorted(df.collect())
    assert spread(df, 2000, 5000, 10_000) is df and spread(df, 2000, 5000, 100).rdd.getNumPartitions() == 20


def test_forest_keeps_the_nodes_of_its_rows(spark):
    from schemaweave.operators.modeling import train_models

    df = spark.range(300).selectExpr("cast(id % 17 as double) as a", "cast(id % 2 as int) as y")
    fitted = train_models(df, ["a"], "y", n_trees=3, max_depth=4)
    assert fitted["Random Forest"].stages[-1].getCacheNodeIds() and fitted["Random Forest"].stages[-1].getNumTrees == 3


def test_nearest_centres_equal_the_plain_distances():
    from schemaweave.operators.modeling import nearest_centres

    rng = np.random.default_rng(1)
    for n in (0, 1, 1024, 2500):
        x, c = rng.normal(size=(n, 2)), rng.normal(size=(50, 2))
        at, near = nearest_centres(x, c)
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
        assert np.array_equal(at, d.argmin(1) if n else []) and np.array_equal(near, d[np.arange(n), at])
