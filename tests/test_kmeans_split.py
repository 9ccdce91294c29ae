"""k-means restarts advanced together, and splits where one key holds half of a class."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler

import __spark_entry__ as entry
from schemaweave.operators.modeling import first_centres, kmeans_clusters, lloyd_step, stratified_split

SF = "/root/testdata/sf0.001"


def points(n=1500, groups=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-10, 10, (groups, 2))
    return centres[rng.integers(0, groups, n)] + 0.2 * rng.normal(size=(n, 2))


def cost_of(rows, x):
    at = np.array([rows[i] for i in range(len(x))])
    return sum(((x[at == c] - x[at == c].mean(0)) ** 2).sum() for c in set(at.tolist()))


def test_clusters_are_as_good_as_the_best_single_fit(spark):
    x = points()
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(9000, None, 1.0), (9001, 2.0, float("nan"))], "id long, latitude double, longitude double")
    got = {r.id: r.location_cluster for r in kmeans_clusters(df, "id", k=12, restarts=10).collect()}
    assert set(got) == set(range(len(x))) and len(set(got.values())) == 12
    feats = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="f").transform(df.where("id < 9000")).cache()
    single = min(KMeans(k=12, seed=s, featuresCol="f").fit(feats).summary.trainingCost for s in range(3))
    assert cost_of(got, x) <= single * 1.02


def test_a_step_of_all_restarts_equals_each_alone(spark):
    x = points(400, 5)
    df = spark.createDataFrame([(p.tolist(),) for p in x], "x array<double>").repartition(3)
    c = np.stack([first_centres(x, 5, np.random.default_rng(i)) for i in range(3)])
    sums, n, cost = lloyd_step(df, c, np.array([False, True, False]))
    for r in (0, 2):
        d = ((x[:, None] - c[r][None]) ** 2).sum(2)
        at = d.argmin(1)
        assert np.array_equal(n[r], np.bincount(at, minlength=5)) and np.isclose(cost[r], d.min(1).sum())
        assert np.allclose(sums[r], [x[at == j].sum(0) for j in range(5)])
    assert n[1].sum() == 0


def test_few_points(spark):
    of = lambda rows: sorted(tuple(r) for r in kmeans_clusters(spark.createDataFrame(rows, "id long, latitude double, longitude double"), "id").collect())
    assert of([]) == [] and of([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, None, 1.0)]) == [(1, 0), (2, 0)]
    got = of([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 5.0, 5.0)])
    assert got[0][1] == got[1][1] != got[2][1]


def test_a_key_with_half_of_a_class(spark):
    rows = [("hot", "a", i) for i in range(500)] + [(f"k{i}", "a", i) for i in range(500)] + [(None, "b", i) for i in range(100)] + [("x", None, i) for i in range(31)]
    df = spark.createDataFrame(rows, "key string, label string, v int").repartition(5)
    for share in (0.2, 0.5, 0.9):
        out = stratified_split(df, "label", "key", share).collect()
        assert sorted((str(r.key), str(r.label), r.v) for r in out) == sorted((str(k), str(y), v) for k, y, v in rows)
        for label, n in (("a", 1000), ("b", 100), (None, 31)):
            assert sum(r.is_test for r in out if r.label == label) == int(np.floor(share * n + 0.5))
        again = stratified_split(df.repartition(2), "label", "key", share).collect()
        assert sorted(map(str, out)) == sorted(map(str, again))


def test_clusters_feed_the_features(spark):
    f = entry.queries()["features_clustered"](spark, SF).toPandas()
    plain = entry.queries()["features_full"](spark, SF).toPandas()
    assert len(f) == len(plain) > 0 and set(f.columns) - set(plain.columns) == {"location_cluster"}
    assert f["location_cluster"].nunique() > 1 and f["location_cluster"].notna().all()
