"""Keyed building blocks that stay safe when one key holds a third of the rows.

* group counts: partial (map-side) ``count`` then a join back; AQE picks a
  broadcast when the count table is small and splits skewed partitions when
  it is not, so no task ever holds a hot group whole;
* first row per key: a ``row_number() = 1`` filter, planned as a
  WindowGroupLimit on the map side, so a hot key collapses to one row per
  task before the shuffle;
* dense codes for sorted distinct values: range partitioning plus per
  partition offsets, never a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweave.session import scratch_path


def any_null(keys: Sequence[str]) -> Column:
    out = F.col(keys[0]).isNull()
    for k in keys[1:]:
        out = out | F.col(k).isNull()
    return out


def attach_group_count(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add the size of each row's ``keys`` group; a null in any key gives null."""
    counts = (df.where(~any_null(keys))
              .groupBy(*keys).agg(F.count(F.lit(1)).alias(name)))
    return df.join(counts, on=list(keys), how="left")


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                  null_keys: str = "keep") -> DataFrame:
    """Keep the first row (by ascending ``order_by``, nulls first; remaining
    columns break ties) of every key.

    ``null_keys='keep'``: rows with a null key never merge with each other.
    ``null_keys='equal'``: null keys form one group (pandas drop_duplicates).

    ``row_number() = 1`` is planned as a WindowGroupLimit on both sides of the
    shuffle: every map task keeps one row per key before exchanging, so a key
    holding a third of the rows costs each task one row, not one task a third.
    """
    order_by = [c for c in order_by if c not in keys]
    ties = [c for c, t in df.dtypes if c not in keys and c not in order_by and not t.startswith("map")]
    order = [F.col(c).asc_nulls_first() for c in [*order_by, *ties]]

    def dedup(part: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return part.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")

    if null_keys == "equal":
        return dedup(df, keys)
    # one pass: a row with a null key gets a group of its own
    own = F.when(any_null(keys), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return dedup(df.withColumn("_own", own), [*keys, "_own"]).drop("_own")


def dealt_by_range(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned by ``order`` with its partition number ``_pid``.

    The bounds come from a sample, so the rows are written once with their number
    (shared scratch folder): every later branch sees the same partitions."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
    path = scratch_path(spark, "dealt")
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def ranked_by_group(df: DataFrame, group: Sequence[str], order: str, code: str) -> DataFrame:
    """0-based rank ``code`` of each row within ``group`` (not null) by ``order``
    (unique within the group): ranks within (group, partition), shifted by the
    counts of the group's earlier partitions."""
    dealt = dealt_by_range(df, [*group, order])
    own = [*group, "_pid"]
    local = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy(*own).orderBy(order)))
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).select(
        *own, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return local.join(offsets, own).select(*df.columns, (F.col("_off") + F.col("_rn") - 1).cast("bigint").alias(code))


def dense_codes(values: DataFrame, col: str, code: str) -> DataFrame:
    """0-based dense rank of the distinct non-null values of ``col``, in Spark's
    order at every size (NaN last); one row per value."""
    distinct = values.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_g", F.lit(0))
    return ranked_by_group(distinct, ["_g"], col, code).drop("_g")


def exclusive_running_sum(df: DataFrame, order_col: str, value_col: str, out: str) -> DataFrame:
    """Sum of ``value_col`` over all rows strictly before each row in
    ``order_col`` order (``order_col`` unique), computed without a
    single-partition window: range partitions, a running sum inside each, and
    the totals of earlier partitions (one row per partition) added on."""
    dealt = dealt_by_range(df, [order_col])
    inner = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(value_col).over(inner), F.lit(0)))
    totals = dealt.groupBy("_pid").agg(F.sum(value_col).alias("_t"))
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per shuffle partition: a proven bound, so broadcast is safe
    return (local.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .withColumn(out, F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off"))
