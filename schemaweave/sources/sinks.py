"""Sinks: canonical outputs, the incidents table, intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.operators.catalog import profile
from schemaweave.operators.keyed import any_null, first_per_key
from schemaweave.session import scratch_path


# --- S6 --------------------------------------------------------------------------------
def write_canonical(df: DataFrame, out_dir: str, name: str, csv: bool = True) -> dict[str, str]:
    """Parquet (+ CSV) of the cleaned table and its profile as JSON lines."""
    paths = {"parquet": f"{out_dir}/{name}_clean.parquet", "profile": f"{out_dir}/{name}_profile.json"}
    df.write.mode("overwrite").parquet(paths["parquet"])
    if csv:
        paths["csv"] = f"{out_dir}/{name}_clean.csv"
        df.write.mode("overwrite").option("header", True).csv(paths["csv"])
    profile_document(profile(df.sparkSession.read.parquet(paths["parquet"]))) \
        .coalesce(1).write.mode("overwrite").json(paths["profile"])
    return paths


def profile_document(prof: DataFrame) -> DataFrame:
    """One row shaped {n_rows, n_cols, columns: {name: {dtype, null_pct}}} from
    the long profile (one row per column, so the aggregate is bounded)."""
    entry = F.struct(F.col("column"), F.struct("dtype", "null_pct"))
    return prof.agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"),
                    F.map_from_entries(F.collect_list(entry)).alias("columns"))


# --- S7 --------------------------------------------------------------------------------
def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_incidents(df: DataFrame, table_path: str, source: str,
                   key: tuple[str, ...] = ("incident_id", "dataset_source")) -> DataFrame:
    """Append a cleaned batch tagged with ``dataset_source``.

    The key is enforced: rows with a null in it are rejected, the first row per
    key inside the batch stays, and an anti join against rows already in the table
    (same source partition only) leaves out the rest, so a re-run inserts nothing.
    Returns the rows written; :func:`load_counts` compares them with the batch.
    """
    spark: SparkSession = df.sparkSession
    batch = df.withColumn("dataset_source", F.lit(source)).where(~any_null(key))
    batch = first_per_key(batch, list(key), [c for c in batch.columns if c not in key][:1])
    if path_exists(spark, table_path):
        existing = spark.read.parquet(table_path).where(F.col("dataset_source") == source).select(*key)
        batch = batch.join(existing, list(key), "left_anti")
    # stage in the shared checkpoint folder first: the batch plan reads the
    # table it appends to, so it must be materialised before the append
    staged_path = scratch_path(spark, "incidents-batch")
    batch.write.mode("overwrite").parquet(staged_path)
    staged = spark.read.schema(batch.schema).parquet(staged_path)
    staged.write.mode("append").partitionBy("dataset_source").parquet(table_path)
    return staged


def load_counts(batch: DataFrame, written: DataFrame, key: str = "incident_id") -> DataFrame:
    """(n_rows, inserted, rejected, null_keys) of one load; rejected includes the null keys."""
    zero = F.lit(0).cast("bigint")
    n = batch.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(key).isNull()).alias("null_keys"), zero.alias("inserted"))
    w = written.agg(zero.alias("n_rows"), zero.alias("null_keys"), F.count(F.lit(1)).alias("inserted"))
    total = n.unionByName(w).agg(*[F.sum(c).alias(c) for c in ("n_rows", "inserted", "null_keys")])
    return total.select("n_rows", "inserted", (F.col("n_rows") - F.col("inserted")).alias("rejected"), "null_keys")


# --- S8 --------------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Persist an intermediate table and return it re-read (lineage cut)."""
    spark = df.sparkSession
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
        return spark.read.option("header", True).csv(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Tag each cleaned table with its source and union by name."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn("dataset_source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def write_codebook(codebook: DataFrame, path: str) -> None:
    """Code-book sink: (section, code, description) as JSON lines, one folder
    per section (no section is gathered into a single document or task)."""
    codebook.write.mode("overwrite").partitionBy("section").json(path)
