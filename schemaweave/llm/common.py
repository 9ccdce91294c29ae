"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaweave.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the
    lineage, and later stages survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the scratch table of ``materialise`` that nothing reads any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Collect unreferenced plans now, so that Spark's cleaner drops their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(col: str | Column, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", max_chars: int = 4_000_000
           ) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of about ``max_chars`` characters of text at most
    (a single longer row makes its own slice), with the texts, null as ''."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        at, size = 0, 0
        for i, t in enumerate(texts):
            if i > at and size + len(t) > max_chars:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(t)
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def range_ranked(df: DataFrame, keys: list[str], order: list[str], size: str | None = None,
                 name: str = "ranked") -> DataFrame:
    """Exact 0-based ``rank`` of each row within ``keys`` by ``order`` and, with
    ``size``, ``before``: the sum of ``size`` over the rows ranked earlier.

    Rows are range-partitioned by (keys, order) and written with their partition
    number, so that a key with any share of the rows spreads over many tasks;
    ranks and sums run within (keys, partition) and are shifted by the totals of
    the key's earlier partitions (one row per key and partition).  Rows equal in
    ``order`` lie in one partition.  ``keys`` must not be null.
    """
    spark = df.sparkSession
    dealt = (df.repartitionByRange(partitions(spark), *(keys + order))
             .withColumn("_pid", F.spark_partition_id()))
    dealt = materialise(dealt, name)
    own = keys + ["_pid"]
    value = F.col(size) if size else F.lit(0)
    local = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*own).orderBy(*order)).cast("long") - 1)
            .withColumn("_sum", F.sum(value).over(local) - value))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = (dealt.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
              .select(*own, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
                      F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_v0")))
    out = rows.join(totals, own)
    cols = [F.col(c) for c in df.columns] + [(F.col("_n0") + F.col("_row")).cast("long").alias("rank")]
    if size:
        cols.append((F.col("_v0") + F.col("_sum")).cast("long").alias("before"))
    return out.select(*cols)


_CHARS: list = []


def char_table():
    """uint8 flags by code point: 1 letter, 2 upper case, 4 digit, 8 white space."""
    if not _CHARS:
        import numpy as np

        flags = np.zeros(0x110000, dtype=np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                flags[i] = 1 + 2 * c.isupper()
            elif c.isdigit():
                flags[i] = 4
            elif c.isspace():
                flags[i] = 8
        _CHARS.append(flags)
    return _CHARS[0]
