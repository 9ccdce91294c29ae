"""The schema half on real tables: profile every column of the driver tables,
normalise / expand / flag the names, and pair columns across tables.

Profiling scans the whole tables (non-null ratios and first values per
column), so its work grows with the data; the catalog itself has one row per
column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.functions.text import is_ambiguous, with_expanded, with_normalized
from schemaweave.operators.catalog import column_profile
from schemaweave.operators.pairs import candidate_pairs
from schemaweave.operators.similarity import lexical_scores
from schemaweave.operators.clean import project_final
from schemaweave.plans.matching import _materialised, table

# --- fixed values: tables profiled and the key that orders their rows ---------
PROFILED_TABLES = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey"}


def schema_catalog(spark: SparkSession, d: str, max_values: int = 5) -> DataFrame:
    """One row per (table, column): dtype, non-null ratio, sample values,
    ambiguity flag, normalized and expanded names with their traces.
    Built once per session (one row per column) and re-read from the shared
    checkpoint folder by the steps that follow."""
    return _materialised(spark, f"schema_catalog_{max_values}", d, lambda: _schema_catalog(spark, d, max_values))


def _schema_catalog(spark: SparkSession, d: str, max_values: int) -> DataFrame:
    out = None
    for name, key in PROFILED_TABLES.items():
        df = table(spark, d, name)
        cols = F.array(*[F.lit(c) for c in df.columns])
        prof = column_profile(df, name, key, max_values=max_values).withColumn(
            "pos", F.array_position(cols, F.col("column")).cast("int"))
        out = prof if out is None else out.unionByName(prof)
    out = out.select(F.col("dataset").alias("dataset_key"), F.col("column").alias("original_column_name"),
                     F.col("dtype").alias("inferred_dtype"), F.col("non_null_ratio").alias("non_null_ratio_est"),
                     "sample_values", "pos",
                     is_ambiguous(F.col("column")).alias("flag_ambiguous_or_abbrev"))
    out = with_normalized(out, "original_column_name")
    return with_expanded(out, "normalized_column_name")


def catalog_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All column pairs across the profiled tables, with Jaccard and
    exact-match scores (context = the column's sample values)."""
    cat = schema_catalog(spark, d).select(
        F.col("dataset_key").alias("city"), F.col("dataset_key").alias("ds_order"),
        F.col("original_column_name").alias("column_original"),
        F.col("expanded_column_name").alias("column_final"), F.col("sample_values").alias("description"), "pos")
    pairs = candidate_pairs(cat).withColumns({"left_header_only": F.col("left_column_final"),
                                             "right_header_only": F.col("right_column_final")})
    return lexical_scores(pairs)


# --- fixed values: columns of the final schema table, in order ---
FINAL_COLUMNS = ["dataset_key", "original_column_name", "normalized_column_name", "expanded_column_name", "inferred_dtype",
                 "non_null_ratio_est", "sample_values", "normalization_steps", "abbreviation_rules_applied", "flag_ambiguous_or_abbrev"]


def final_schema(spark: SparkSession, d: str) -> DataFrame:
    """P5: the fixed projection of the column catalog; a missing column is an error."""
    return project_final(schema_catalog(spark, d), FINAL_COLUMNS)
