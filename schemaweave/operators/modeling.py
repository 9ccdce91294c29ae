"""Split, models and classification metrics on Spark MLlib and DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemaweave.operators.evaluate import prf
from schemaweave.operators.forest import fit_forest
from schemaweave.operators.keyed import exclusive_running_sum, ranked_by_group
from schemaweave.session import checkpoint_root, scratch_path, ship_package

# rows a task takes before more are opened, up to the cores; and the most it takes (a forest draws its samples per
# task, so small tables stay as they are)
FIT_ROWS, EACH_FIT_TASK = 20_000, 200_000
POINTS, EACH_POINTS_TASK = 5_000, 200_000
# rows that MLlib's forest is fitted on; above, its deep trees outgrow the driver and its sums the rows (see forest.py)
MLLIB_FOREST_ROWS = 20_000


def spread(df: DataFrame, rows: int, least: int, most: int) -> DataFrame:
    """``df`` (of ``rows`` rows) over as many tasks as there are cores, each with ``least`` rows or more and
    about ``most`` at most: small files come as one task whatever work hangs on a row."""
    tasks = max(min(df.sparkSession.sparkContext.defaultParallelism, rows // least), -(-rows // most))
    if tasks <= df.rdd.getNumPartitions():
        return df
    return df.repartition(tasks).sortWithinPartitions(*df.columns)  # the same rows in each task at every run


# --- W10 -------------------------------------------------------------------------------
def hash_rank_key(key: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Deterministic stratified split: per class, the round(fraction * n) rows
    with the smallest md5(key || seed) go to test.  Adds ``is_test``.  Every row
    is kept once, also rows that repeat a key; a null label is a class of its own.

    Skew-safe exact selection: the k-th smallest hash of a class is found from
    hash-prefix histograms (16 bits, then 16 more inside the boundary bucket),
    which are partial aggregates; only the rows of the final boundary
    sub-bucket (about n / 2^32 of a class, and all rows of a key that lies there) are
    ranked exactly, over range partitions, so one key may hold any share of a class.
    """
    spark = df.sparkSession
    h = hash_rank_key(key, seed)
    d = df.withColumn("_h", F.coalesce(h, F.lit("")))
    d = d.withColumn("_b1", F.coalesce(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), F.lit(0)))
    d = d.withColumn("_b2", F.coalesce(F.conv(F.substring("_h", 5, 4), 16, 10).cast("int"), F.lit(0)))
    path = scratch_path(spark, "split")  # hashed once; everything below reads this
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path)

    def boundary(hist: DataFrame, bucket: str, need: str) -> DataFrame:
        # cumulative counts per class over buckets (<= 65536 rows per class)
        w = Window.partitionBy(label).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
        c = hist.withColumn("_cum", F.sum("_c").over(w))
        hit = c.where((F.col("_cum") >= F.col(need)) & (F.col("_cum") - F.col("_c") < F.col(need)))
        return hit.select(F.col(label).alias(f"_l{bucket}"), F.col(bucket).alias(f"{bucket}_cut"),
                          (F.col(need) - (F.col("_cum") - F.col("_c"))).alias(f"{need}_in"))

    def with_cut(rows: DataFrame, cut: DataFrame, bucket: str) -> DataFrame:
        return rows.join(cut, rows[label].eqNullSafe(cut[f"_l{bucket}"]), "left").drop(f"_l{bucket}")

    # class sizes come from the (small) first-level histogram, not another pass over the data
    h1 = d.groupBy(label, "_b1").agg(F.count(F.lit(1)).alias("_c"))
    h1 = h1.withColumn("_k", F.round(F.sum("_c").over(Window.partitionBy(label)) * test_fraction).cast("bigint"))
    cut1 = boundary(h1.where(F.col("_k") > 0), "_b1", "_k")
    tagged = with_cut(d, cut1, "_b1")
    inb = tagged.where(F.col("_b1") == F.col("_b1_cut"))
    h2 = inb.groupBy(label, "_b2").agg(F.count(F.lit(1)).alias("_c"), F.first("_k_in").alias("_k_in"))
    tagged = with_cut(tagged, boundary(h2, "_b2", "_k_in"), "_b2")
    edge = F.coalesce((F.col("_b1") == F.col("_b1_cut")) & (F.col("_b2") == F.col("_b2_cut")), F.lit(False))
    below = (F.col("_b1") < F.col("_b1_cut")) | ((F.col("_b1") == F.col("_b1_cut")) & (F.col("_b2") < F.col("_b2_cut")))
    sure = tagged.where(~edge).select(*df.columns, F.coalesce(below, F.lit(False)).alias("is_test"))
    rest = [c for c, t in df.dtypes if c != key and not t.startswith("map")]
    order = F.struct("_h", key, *rest, F.monotonically_increasing_id().alias("_i"))
    of = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))
    at_edge = ranked_by_group(tagged.where(edge).withColumns({"_o": order, "_g": of}), ["_g"], "_o", "_r")
    return sure.unionByName(at_edge.select(*df.columns, (F.col("_r") < F.col("_k_in_in")).alias("is_test")))


# --- M1 -------------------------------------------------------------------------------
def first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres out of a sample: each next one drawn by squared distance to the nearest so far."""
    out = [sample[rng.integers(len(sample))]]
    near = ((sample - out[0]) ** 2).sum(1)
    while len(out) < k and near.sum() > 0:
        out.append(sample[rng.choice(len(sample), p=near / near.sum())])
        near = np.minimum(near, ((sample - out[-1]) ** 2).sum(1))
    return np.array(out + [out[-1]] * (k - len(out)))


def nearest_centres(x: np.ndarray, centres: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, its squared distance) of every row, in blocks that stay in the processor's cache."""
    at, near = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    d, t = np.empty((2, min(rows, len(x)), len(centres)))
    for i in range(0, len(x), rows):
        part = x[i:i + rows]
        a, b = d[:len(part)], t[:len(part)]
        a[:] = 0.0
        for j in range(x.shape[1]):
            np.subtract(part[:, j, None], centres[None, :, j], out=b)
            np.multiply(b, b, out=b)
            np.add(a, b, out=a)
        at[i:i + rows] = a.argmin(1)
        near[i:i + rows] = a[np.arange(len(part)), at[i:i + rows]]
    return at, near


def lloyd_step(points: DataFrame, centres: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, costs) of every restart's clusters in one scan of ``points`` (column x): a task gives
    one row per restart and cluster; restarts flagged in ``fixed`` are left out."""
    restarts, k, width = centres.shape
    held = points.sparkSession.sparkContext.broadcast((centres, fixed))  # restarts x clusters x columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, fixed = held.value
        sums, n, cost = np.zeros((restarts, k, width)), np.zeros((restarts, k), dtype=np.int64), np.zeros((restarts, k))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for r in np.nonzero(~fixed)[0].tolist():
                at, near = nearest_centres(x, centres[r])
                n[r] += np.bincount(at, minlength=k)
                cost[r] += np.bincount(at, weights=near, minlength=k)
                for j in range(width):
                    sums[r, :, j] += np.bincount(at, weights=x[:, j], minlength=k)
        r, c = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(c), pa.array(n[r, c]), pa.array(cost[r, c]), *(pa.array(sums[r, c, j]) for j in range(width))],
                                         names=["r", "c", "n", "cost", *(f"s{j}" for j in range(width))])

    parts = points.select("x").mapInArrow(assign, "r long, c long, n long, cost double, " + ", ".join(f"s{j} double" for j in range(width)))
    rows = parts.groupBy("r", "c").agg(*[F.sum(x).alias(x) for x in ["n", "cost", *(f"s{j}" for j in range(width))]]).collect()  # restarts x clusters
    sums, n, cost = np.zeros((restarts, k, width)), np.zeros((restarts, k)), np.zeros(restarts)
    for x in rows:
        n[x["r"], x["c"]] = x["n"]
        cost[x["r"]] += x["cost"]
        sums[x["r"], x["c"]] = [x[f"s{j}"] for j in range(width)]
    return sums, n, cost


def kmeans_clusters(df: DataFrame, key: str, cols: Sequence[str] = ("latitude", "longitude"),
                    k: int = 50, seed: int = 42, restarts: int = 10, iterations: int = 20, tolerance: float = 1e-4,
                    seed_rows: int = 4000) -> DataFrame:
    """(key, location_cluster) for rows with coordinates, of any number; at most as
    many clusters as there are distinct points.

    The restarts advance together: one scan per iteration gives the partial sums of all of them, and
    the cheapest one assigns the clusters.  Only the first centres come from a sample, of
    ``seed_rows`` points at most, drawn by hash; iterations end when no centre moves by
    more than ``tolerance``, or after ``iterations``."""
    ship_package(df.sparkSession)
    pts = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop(subset=list(cols))
    path = scratch_path(df.sparkSession, "kmeans-points")
    pts.select(key, F.array(*cols).alias("x")).write.parquet(path)
    points = df.sparkSession.read.parquet(path)
    dealt = spread(points, points.count(), POINTS, EACH_POINTS_TASK)
    if dealt is not points:  # every iteration reads them: one task per written file
        path = scratch_path(df.sparkSession, "kmeans-points")
        dealt.write.parquet(path)
        points = df.sparkSession.read.parquet(path)
    distinct = points.select("x").distinct().limit(k).count()
    if distinct < 2:
        return points.select(key, F.lit(0).alias("location_cluster"))
    k = min(k, distinct)
    sample = np.array([r["x"] for r in points.select("x", F.xxhash64(F.lit(seed), "x", key).alias("h")).orderBy("h").limit(seed_rows).collect()])
    centres = np.stack([first_centres(sample, k, np.random.default_rng(seed + i)) for i in range(restarts)])
    best, fixed = np.full(restarts, np.inf), np.zeros(restarts, dtype=bool)
    for _ in range(iterations + 1):  # the last scan only tells the costs
        sums, n, cost = lloyd_step(points, centres, fixed)
        best = np.where(fixed, best, cost)
        moved = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], centres)
        far = np.sqrt(((moved - centres) ** 2).sum(2)).max(1)
        new = fixed | (far <= tolerance)
        if new.all() or _ == iterations:
            break
        centres = np.where(new[:, None, None], centres, moved)
        fixed = new
    chosen = df.sparkSession.sparkContext.broadcast(centres[int(best.argmin())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            at, _ = nearest_centres(x, chosen.value)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(at.astype(np.int32))], names=[key, "location_cluster"])

    return points.mapInArrow(nearest, f"`{key}` {dict(points.dtypes)[key]}, location_cluster int")


# --- M3, M4, M6 --------------------------------------------------------------------------
def train_models(train: DataFrame, features: Sequence[str], label: str, seed: int = 42,
                 n_trees: int = 100, max_depth: int = 30) -> dict:
    """Both models fitted on ``train``; ``max_depth`` bounds the trees (30 is Spark's limit).

    Rows are few bytes but pass every tree at every level, so they are spread over the cores.  Up to
    ``MLLIB_FOREST_ROWS`` rows MLlib fits the forest, with the nodes that rows have reached kept with
    them; larger ones are grown by :func:`fit_forest`, tree by tree, by the same rules but with draws of its own."""
    checkpoint_root(train.sparkSession)  # long chains of node ids are cut there
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    n_train = max(train.count(), 1)
    train = spread(train.select(*dict.fromkeys([*features, label])), n_train, FIT_ROWS, EACH_FIT_TASK).cache()
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=1000,
                            regParam=1.0 / n_train, elasticNetParam=0.0, standardization=False)
    fitted = {"Logistic Regression": Pipeline(stages=[asm, lr]).fit(train)}
    if n_train > MLLIB_FOREST_ROWS:
        fitted["Random Forest"] = fit_forest(train, features, label, n_train, n_trees, seed, max_depth)
    else:
        rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=n_trees, seed=seed,
                                    featureSubsetStrategy="sqrt", maxDepth=max_depth, impurity="gini", cacheNodeIds=True)
        fitted["Random Forest"] = Pipeline(stages=[asm, rf]).fit(train)
    train.unpersist()
    return fitted


def predictions(model, test: DataFrame, label: str, key: str) -> DataFrame:
    p = model.transform(test)
    return p.select(key, F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
                    vector_to_array("probability")[1].alias("score"))


# --- A11 --------------------------------------------------------------------------------
def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision / recall / F1 / support, plus accuracy, macro and
    weighted averages, from (label, prediction) counts."""
    pairs = pred.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("_c"))
    path = scratch_path(pred.sparkSession, "class-counts")  # classes squared: the input is read once
    pairs.write.parquet(path)
    pairs = pred.sparkSession.read.schema(pairs.schema).parquet(path)
    # every (label, prediction) count touches at most two classes
    per = (pairs.withColumn("cls", F.explode(F.array_distinct(F.array(F.col(label), F.col(prediction)))))
           .groupBy("cls").agg(
               F.sum(F.when((F.col(label) == F.col("cls")) & (F.col(prediction) == F.col("cls")), F.col("_c"))
                     .otherwise(0)).alias("tp"),
               F.sum(F.when((F.col(label) != F.col("cls")) & (F.col(prediction) == F.col("cls")), F.col("_c"))
                     .otherwise(0)).alias("fp"),
               F.sum(F.when((F.col(label) == F.col("cls")) & (F.col(prediction) != F.col("cls")), F.col("_c"))
                     .otherwise(0)).alias("fn")))
    m = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    per = per.select(F.col("cls").cast("string").alias("class"), m["precision"].alias("precision"),
                     m["recall"].alias("recall"), m["f1"].alias("f1"),
                     (F.col("tp") + F.col("fn")).cast("bigint").alias("support"), "tp")
    total = per.agg(F.sum("support").alias("_n"), F.sum("tp").alias("_tp"),
                    F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
                    F.sum(F.col("precision") * F.col("support")).alias("_wp"),
                    F.sum(F.col("recall") * F.col("support")).alias("_wr"),
                    F.sum(F.col("f1") * F.col("support")).alias("_wf"))
    acc = total.select(F.lit("accuracy").alias("class"),
                       (F.col("_tp") / F.col("_n")).alias("precision"), (F.col("_tp") / F.col("_n")).alias("recall"),
                       (F.col("_tp") / F.col("_n")).alias("f1"), F.col("_n").cast("bigint").alias("support"))
    macro = total.select(F.lit("macro avg").alias("class"), F.col("_mp").alias("precision"),
                         F.col("_mr").alias("recall"), F.col("_mf").alias("f1"), F.col("_n").cast("bigint").alias("support"))
    weighted = total.select(F.lit("weighted avg").alias("class"), (F.col("_wp") / F.col("_n")).alias("precision"),
                            (F.col("_wr") / F.col("_n")).alias("recall"), (F.col("_wf") / F.col("_n")).alias("f1"),
                            F.col("_n").cast("bigint").alias("support"))
    return per.drop("tp").unionByName(acc).unionByName(macro).unionByName(weighted)


# --- A12 --------------------------------------------------------------------------------
def roc_auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC by the rank-sum formula, ties counted one half.

    Scores are grouped (partial aggregate), then the distinct scores are
    ordered with a cumulative negative count (a distributed prefix sum over
    range partitions of the distinct scores, never one task)."""
    g = pred.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    g = exclusive_running_sum(g, score, "_q", "_below")
    agg = g.agg(F.sum(F.col("_p") * (F.col("_below") + 0.5 * F.col("_q"))).alias("_s"),
                F.sum("_p").alias("_np"), F.sum("_q").alias("_nq"))
    return agg.select(F.when((F.col("_np") > 0) & (F.col("_nq") > 0),
                             F.col("_s") / (F.col("_np") * F.col("_nq"))).alias("auc"),
                      F.col("_np").cast("bigint").alias("n_pos"), F.col("_nq").cast("bigint").alias("n_neg"))


# --- A24 ---------------------------------------------------------------------------------
def feature_importance_topk(model, features: Sequence[str], spark, k: int = 10) -> DataFrame:
    forest = model.stages[-1]
    imp = forest.featureImportances.toArray().tolist()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(k)


def model_summary(preds: dict[str, DataFrame]) -> DataFrame:
    """(model, accuracy, precision, recall, auc) for each fitted model."""
    out = None
    for name, p in preds.items():
        tp = F.count_if((F.col("label") == 1) & (F.col("prediction") == 1))
        fp = F.count_if((F.col("label") == 0) & (F.col("prediction") == 1))
        fn = F.count_if((F.col("label") == 1) & (F.col("prediction") == 0))
        base = p.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
                     tp.alias("_tp"), fp.alias("_fp"), fn.alias("_fn"))
        m = prf(F.col("_tp"), F.col("_fp"), F.col("_fn"))
        row = base.select(F.lit(name).alias("model"), "accuracy", m["precision"].alias("precision"),
                          m["recall"].alias("recall"))
        auc = roc_auc(p).first()["auc"]  # one scalar per model
        row = row.withColumn("auc", F.lit(auc).cast("double"))
        out = row if out is None else out.unionByName(row)
    return out
