"""Candidate column pairs across datasets, their text representations and merges.

A catalog row is one column of one dataset: ``city`` (dataset name),
``ds_order`` (dataset order), ``column_original``, ``column_final``,
``description`` and ``pos`` (column position inside its dataset).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweave.constants import PAIR_KEY
from schemaweave.functions.text import context_text


# --- J1 --------------------------------------------------------------------------------
def dataset_pairs(catalog: DataFrame) -> DataFrame:
    """Each unordered pair of datasets once, in ``ds_order``: (left_city, right_city).

    The list of datasets is the catalog's configuration (one entry per dataset)."""
    listed = catalog.groupBy("city").agg(F.min("ds_order").alias("o")).agg(
        F.array_sort(F.collect_list(F.struct("o", "city"))).alias("ds"))
    left = listed.select("ds", F.posexplode("ds").alias("i", "l"))
    return (left.select(F.col("l.city").alias("left_city"), F.explode(F.expr("slice(ds, i + 2, size(ds))")).alias("r"))
            .select("left_city", F.col("r.city").alias("right_city")))


def paired_columns(columns: DataFrame, grids: DataFrame, carry: list[str], salts: int = 8) -> DataFrame:
    """Every left column with every right column of the dataset pairs in ``grids`` (left_city, right_city);
    ``carry`` names the columns taken from each side, as left_* and right_*.

    The join meets on the right dataset and a salt of the left column, the right
    columns repeated per salt, so that no task holds all left columns of one dataset pair."""
    left = (columns.select(F.col("city").alias("left_city"), *[F.col(c).alias(f"left_{c}") for c in carry])
            .join(grids.select("left_city", "right_city"), "left_city")
            .withColumn("_salt", F.pmod(F.xxhash64("left_city", *[f"left_{c}" for c in carry]), F.lit(salts)).cast("int")))
    right = columns.select(F.col("city").alias("right_city"), *[F.col(c).alias(f"right_{c}") for c in carry],
                           F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return left.join(right, ["right_city", "_salt"]).select(
        "left_city", "right_city", *[f"{side}_{c}" for side in ("left", "right") for c in carry])


def candidate_pairs(catalog: DataFrame) -> DataFrame:
    """All column pairs of different datasets, each unordered dataset pair once.

    Every pair is a candidate: its context texts may agree where its names share
    nothing.  The result is what the operator is defined to return, the square of
    the catalog's columns (never of table rows)."""
    return paired_columns(catalog, dataset_pairs(catalog), ["column_original", "column_final"])


def all_pairs_count(catalog: DataFrame) -> DataFrame:
    """Number of cross-dataset pairs the exhaustive nested loop would produce,
    computed from per-dataset sizes: ((sum n)^2 - sum n^2) / 2."""
    sizes = catalog.groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2)
                     .cast("bigint").alias("n_pairs"))


# --- J3 + N20 ----------------------------------------------------------------------------
def last_descriptions(catalog: DataFrame) -> DataFrame:
    """(city, column_final, description): one row per name of a dataset, the last
    catalog row (highest ``pos``) wins; no description gives ''."""
    return (catalog.groupBy("city", "column_final")
            .agg(F.max(F.struct("pos", F.coalesce("description", F.lit("")).alias("d"))).alias("_l"))
            .select("city", "column_final", F.col("_l.d").alias("description")))


def with_context(catalog: DataFrame) -> DataFrame:
    """The catalog with ``header_with_context``, looked up by (dataset, final name): when a name
    repeats the last catalog row (highest ``pos``) wins; no hit gives ''."""
    last = last_descriptions(catalog).withColumnsRenamed({"description": "_d"})
    joined = catalog.join(last, ["city", "column_final"], "left")
    return joined.select(*catalog.columns, context_text(F.col("column_final"), F.coalesce("_d", F.lit(""))).alias("header_with_context"))


def pairs_with_context(catalog: DataFrame) -> DataFrame:
    """All candidate pairs with the header-only and header+context texts of both sides; the texts are
    looked up once per column, before the columns are paired."""
    pairs = paired_columns(with_context(catalog), dataset_pairs(catalog), ["column_original", "column_final", "header_with_context"])
    return pairs.select("left_city", "right_city", "left_column_original", "left_column_final", "right_column_original", "right_column_final",
                        F.col("left_column_final").alias("left_header_only"), F.col("right_column_final").alias("right_header_only"),
                        "left_header_with_context", "right_header_with_context")


def attach_context(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Header-only and header+context texts for both sides of given pairs (see :func:`with_context`)."""
    last = last_descriptions(catalog)
    ld = last.select(F.col("city").alias("left_city"), F.col("column_final").alias("left_column_final"),
                     F.col("description").alias("_ld"))
    rd = last.select(F.col("city").alias("right_city"), F.col("column_final").alias("right_column_final"),
                     F.col("description").alias("_rd"))
    out = (pairs.join(ld, ["left_city", "left_column_final"], "left")
                .join(rd, ["right_city", "right_column_final"], "left"))
    return out.select(
        *pairs.columns,
        F.col("left_column_final").alias("left_header_only"),
        F.col("right_column_final").alias("right_header_only"),
        context_text(F.col("left_column_final"), F.coalesce("_ld", F.lit(""))).alias("left_header_with_context"),
        context_text(F.col("right_column_final"), F.coalesce("_rd", F.lit(""))).alias("right_header_with_context"))


# --- J2 ------------------------------------------------------------------------------------
def merge_scores(lexical: DataFrame, embedding: DataFrame) -> DataFrame:
    """4-key inner join of the two score tables (key names unified, cast to string)."""
    rename = {"left_column": "left_column_final", "right_column": "right_column_final"}

    def keyed(df: DataFrame) -> DataFrame:
        df = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
        missing = [k for k in PAIR_KEY if k not in df.columns]
        if missing:
            raise ValueError(f"score table lacks key columns {missing}")
        return df.withColumns({k: F.col(k).cast("string") for k in PAIR_KEY})

    return keyed(lexical).join(keyed(embedding), PAIR_KEY, "inner")
