"""End-to-end schema-matching plan over a catalog Spark derives from a table.

The driver's ``part`` table plays the role of a set of datasets: each brand
is a dataset, each distinct part name inside it is a column header, and the
brand's most frequent part type for that name is the column description.
The catalog is an aggregate of the whole table, so its size is bounded by
the distinct (brand, name) domain while the scan grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.constants import PAIR_KEY
from schemaweave.functions.text import with_expanded, with_normalized
from schemaweave.operators import sparse as SP
from schemaweave.operators.pairs import pairs_with_context
from schemaweave.session import scratch_path

# --- fixed values: abbreviation rules used on the part-name catalog (chained) ---
PART_RULES = [("rod", "rod_bar"), ("bar", "bar_stock"), ("gizmo", "gadget")]

SCORE_DIGITS = 9

# Session-level materialisation of the intermediate tables (catalog, text
# pairs): built once per application and data folder, written as Parquet into
# the shared checkpoint folder (lineage cut, columnar write and read) and read
# by every evaluation query -- the reference likewise writes its score table
# once and re-reads it in each evaluation step.
_MEMO: dict = {}
PART_KEYS = ("part_catalog",)


def table_stamp(spark: SparkSession, path: str) -> tuple:
    """(file, length, modification time) of a table's files: a changed table is built anew."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(root)))


def written(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """``df`` written to the shared scratch folder and read back."""
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _materialised(spark: SparkSession, key: str, d: str, build) -> DataFrame:
    k = (spark.sparkContext.applicationId, key, d, table_stamp(spark, f"{d}/part.parquet" if key in PART_KEYS else d))
    if k not in _MEMO:
        _MEMO[k] = written(spark, key, build())
    return _MEMO[k]


def clear_materialised() -> None:
    _MEMO.clear()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_header(name_col) -> F.Column:
    """A header-like rendering of a part name: first letter upper-cased."""
    c = F.col(name_col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.expr(f"substr({name_col}, 2)"))


def part_catalog(spark: SparkSession, d: str) -> DataFrame:
    """(city, ds_order, column_original, column_final, description, pos);
    one row per distinct (brand, name), built once per session."""
    return _materialised(spark, "part_catalog", d, lambda: _part_catalog(spark, d))


def _part_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    g = p.groupBy("p_brand", "p_name", "p_type").agg(F.count(F.lit(1)).alias("n"),
                                                     F.min("p_partkey").alias("k"))
    # dominant type: most rows, ties to the smallest type name (a partial aggregate)
    best = g.groupBy("p_brand", "p_name").agg(
        F.min(F.struct((-F.col("n")).alias("nn"), F.col("p_type").alias("t"))).alias("_b"),
        F.min("k").alias("pos"))
    cat = best.select(F.col("p_brand").alias("city"), F.col("p_brand").alias("ds_order"),
                      raw_header("p_name").alias("column_original"),
                      F.col("_b.t").alias("description"), F.col("pos"))
    cat = with_normalized(cat, "column_original", "_norm", "_steps")
    cat = with_expanded(cat, "_norm", "column_final", "_rules", PART_RULES)
    return cat.select("city", "ds_order", "column_original", "column_final", "description", "pos")


def pairs_repr(spark: SparkSession, d: str) -> DataFrame:
    """All cross-dataset pairs with their texts (the catalog's square, not the rows')."""
    return pairs_with_context(part_catalog(spark, d))


def sparse(spark: SparkSession, d: str) -> SP.SparseScores:
    """J1 -> J3 -> {Q1, Q2 -> Q3} -> J2 and the labels, as weighted text pairs; built once per session.

    Label: 1 when both columns carry the same description (part type)."""
    k = (spark.sparkContext.applicationId, "sparse", d, table_stamp(spark, f"{d}/part.parquet"))
    if k not in _MEMO:
        _MEMO[k] = SP.sparse_scores(part_catalog(spark, d), lambda name, df: written(spark, name, df), digits=SCORE_DIGITS)
    return _MEMO[k]


def similarity_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores of every column pair, rounded to 9 dp."""
    return SP.all_pairs_scored(sparse(spark, d)).select(*PAIR_KEY, "lexical_jaccard", "exact_match", *SP.SCORES[1:])


def weighted(spark: SparkSession, d: str) -> DataFrame:
    """Scores and labels of all column pairs as rows with a number ``n`` of pairs."""
    return SP.weighted_pairs(sparse(spark, d))
