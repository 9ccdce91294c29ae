"""Source/sink round trips and the MLlib plans on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.functions.casting import to_float, to_int
from schemaweave.operators.catalog import METADATA_SCHEMA, attach_metadata, metadata_descriptions
from schemaweave.operators.features import NUMERIC, apply_standard_scaler, create_features, fit_standard_scaler
from schemaweave.operators.modeling import (class_report, feature_importance_topk, kmeans_clusters, model_summary,
                                            predictions, stratified_split, train_models)
from schemaweave.plans.matching import table
from schemaweave.plans.rows import canonical_orders, incidents_from_events
from schemaweave.session import checkpoint_root, scratch_path
from schemaweave.sources.readers import dataset_registry, read_csv_robust, read_csv_sniff, scan_with_provenance
from schemaweave.sources.sinks import write_canonical, write_table


def source_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """customer -> CSV (S8) -> robust all-string read (S1) and sniffed read
    (S2) -> typed again; the sniffed read must agree on the header."""
    path = scratch_path(spark, "customer-csv")
    write_table(table(spark, d, "customer"), path, fmt="csv")
    robust = read_csv_robust(spark, path)
    sniffed = read_csv_sniff(spark, path)
    if sniffed.columns != robust.columns:
        raise ValueError("delimiter sniffing disagrees with the robust reader")
    return robust.select(to_int("c_custkey").alias("c_custkey"), F.col("c_name"),
                         to_int("c_nationkey").alias("c_nationkey"), to_float("c_acctbal").alias("c_acctbal"),
                         F.col("c_mktsegment"))


def canonical_write(spark: SparkSession, d: str) -> DataFrame:
    """S6: canonical orders written as Parquet, CSV and profile; the profile document read back, one row per
    column, with the rows of both files."""
    paths = write_canonical(canonical_orders(spark, d), scratch_path(spark, "canonical"), "orders")
    doc = spark.read.schema("n_rows long, n_cols long, columns map<string, struct<dtype string, null_pct double>>").json(paths["profile"])
    n = [spark.read.parquet(paths["parquet"]).agg(F.count(F.lit(1)).alias("parquet_rows")), read_csv_robust(spark, paths["csv"]).agg(F.count(F.lit(1)).alias("csv_rows"))]
    rows = doc.select("n_rows", "n_cols", F.explode("columns").alias("column", "c"))
    for one in n:  # one row each
        rows = rows.join(F.broadcast(one))
    return rows.select("column", "c.dtype", "c.null_pct", "n_rows", "n_cols", "parquet_rows", "csv_rows")


def json_docs(spark: SparkSession, d: str) -> DataFrame:
    """Column-metadata JSON documents built from events, in both shapes."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    shape_a = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("fieldName"),
                                                  F.concat(F.lit("k="), k).alias("description"))).alias("columns")))
    shape_b = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(
        F.upper("event_type").alias("name"), F.concat(F.lit(" k="), k, F.lit(" ")).alias("desc"))).alias("columns"))
        .alias("view")).alias("meta")))
    doc = F.when(F.col("event_type").isin("click", "view"), shape_a).otherwise(shape_b)
    return e.select("event_id", doc.alias("json"))


def json_meta(spark: SparkSession, d: str) -> DataFrame:
    """S5 + J4: descriptions from the documents, attached to the event-type catalog."""
    docs = json_docs(spark, d).select("event_id", F.from_json("json", METADATA_SCHEMA).alias("doc"))
    desc = metadata_descriptions(docs, "doc", "event_id")
    catalog = table(spark, d, "events").select(F.col("event_type").alias("column")).distinct()
    return attach_metadata(catalog, desc, "column")


def scan_files(spark: SparkSession, d: str) -> DataFrame:
    """S3 + P1: customer and supplier files as one scan with provenance."""
    df = scan_with_provenance(spark, d, "{customer,supplier}.parquet")
    return df.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))


def registry(spark: SparkSession, d: str) -> DataFrame:
    config = spark.createDataFrame(
        [("customer", "driver", "customer.parquet"), ("orders", "driver", "orders.parquet"),
         ("missing", "driver", "missing.parquet")], "dataset_key string, city string, csv_file string")
    return dataset_registry(spark, config, d)


# --- ML ------------------------------------------------------------------------------------
def _event_features(spark: SparkSession, d: str) -> DataFrame:
    """Unscaled: the scaler is fitted on the training rows."""
    return create_features(incidents_from_events(spark, d), scale=False)


def kmeans(spark: SparkSession, d: str) -> DataFrame:
    inc = incidents_from_events(spark, d)
    clusters = kmeans_clusters(inc, "incident_id", k=50, restarts=10, seed=42)
    return clusters.groupBy("location_cluster").agg(F.count(F.lit(1)).alias("n"))


def features_clustered(spark: SparkSession, d: str) -> DataFrame:
    """M1 -> M5: the features with the location clusters of the incidents (a label, so not scaled)."""
    inc = incidents_from_events(spark, d)
    clusters = kmeans_clusters(inc, "incident_id", k=50, restarts=10, seed=42)
    return create_features(inc, clusters=clusters)


# without latitude and location_type: the label is derived from the same value
FEATURES = ["crime_category", "crime_subtype", "district", "domestic_flag", "longitude", "year", "hour", "day_of_week"]


def _train_test(spark: SparkSession, d: str):
    """Features -> exact stratified split.  The split table is cut from its
    lineage (reliable checkpoint in the shared folder) and cached, because the
    iterative fits read it once per iteration."""
    f = _event_features(spark, d)
    f = f.withColumn("arrest_made", F.col("arrest_made").cast("int"))
    checkpoint_root(spark)
    split = stratified_split(f, "arrest_made", "incident_id", 0.2, 42).checkpoint(eager=True).cache()
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    scaler = fit_standard_scaler(train, [c for c in NUMERIC if c in train.columns])
    return apply_standard_scaler(train, scaler), apply_standard_scaler(test, scaler)


_FITTED: dict = {}


def _models(spark: SparkSession, d: str):
    key = (spark.sparkContext.applicationId, d)
    if key not in _FITTED:
        train, test = _train_test(spark, d)
        feats = [c for c in FEATURES if c in train.columns]
        _FITTED[key] = (train_models(train, feats, "arrest_made", n_trees=100), test, feats)
    return _FITTED[key]


def logreg(spark: SparkSession, d: str) -> DataFrame:
    models, test, _ = _models(spark, d)
    return model_summary({k: predictions(v, test, "arrest_made", "incident_id") for k, v in models.items()})


def forest(spark: SparkSession, d: str) -> DataFrame:
    models, test, _ = _models(spark, d)
    return class_report(predictions(models["Random Forest"], test, "arrest_made", "incident_id"))


def importance(spark: SparkSession, d: str) -> DataFrame:
    models, _, feats = _models(spark, d)
    return feature_importance_topk(models["Random Forest"], feats, spark, k=10)
