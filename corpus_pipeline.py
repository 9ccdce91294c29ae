"""The training-corpus pipeline over ``documents``: five operators in order.

1. toxicity: documents predicted toxic go.
2. quality: documents predicted 0 go.
3. near_dedup: one row of each near-duplicate class of texts stays; rows that share a
   doc_id but not a text, and rows without a doc_id, are told apart by their text.
4. mixing: each source is taken up to its curriculum target; a document taken
   for at least half its words stays, and appears twice if at least half of them
   are taken again; documents without words stay once.  The curriculum's positions
   are not kept, so the schedule does not reach packing.  Rows equal in doc_id
   (null or repeated), source and size all get the largest of their copies.
5. packing: pieces placed in sequences of at most 2048 tokens.

Both models learn from all labelled documents that reach their stage.  A stage
whose model has nothing to learn from (no labels that match) drops nothing.  Every
stage but the last returns the columns of ``documents``; each is written as
Parquet and read again as the next one's input.  A null doc_id cannot be
labelled; such rows pass the filters on their text.  Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.llm import mixing, order_minhash, packing, quality, toxicity
from schemaweave.llm.common import WORD, materialise, table
from schemaweave.session import ship_package

ORACLE_SQL = None  # no stage but the mixing is expressible in SQL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if not model.learnt:
        return docs
    return _kept(docs, toxicity.score(_framed(docs), model), F.col("predicted") == 0)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = quality.fit_labels(docs, table(spark, sf_dir, "labels"), "quality")
    if not model.learnt:
        return docs
    return _kept(docs, quality.score(_framed(docs), model), F.col("predicted") == 1)


def _framed(docs: DataFrame) -> DataFrame:
    """``docs`` as one column beside the text, so that no column name clashes with the scores."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))


def _kept(docs: DataFrame, scored: DataFrame, condition) -> DataFrame:
    return scored.where(condition).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    keyed = order_minhash.row_ids(docs)
    classes = order_minhash.text_classes(keyed.select(F.col("_id").alias("id"), F.col("text").cast("string").alias("text")))
    goes = materialise(classes.where("id <> class_id").select(F.col("id").alias("_id")), "dedup-goes")  # the smaller side
    rows = keyed.join(goes, "_id", "left_anti")
    # rows that repeat doc_id and text: one stays
    twice = materialise(rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"), "dedup-repeated")
    if not twice.take(1):
        return rows.select(docs.columns)
    again = rows.join(twice, "_id", "left_semi").groupBy("_id").agg(F.min(F.struct(*docs.columns)).alias("r"))
    return rows.join(twice, "_id", "left_anti").select(docs.columns).union(again.select(*[F.col("r").getField(c).alias(c) for c in docs.columns]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    taken = mixing.curriculum_mix(docs)
    again = F.col("taken") - F.col("first_taken")
    copies = (F.when(F.col("size") == 0, 1).otherwise((2 * F.col("first_taken") >= F.col("size")).cast("int")
              + (2 * again >= F.col("size")).cast("int")))
    by = ["doc_id", "source", "size"]
    plan = materialise(taken.groupBy(*by).agg(F.max(copies).alias("copies")).where("copies > 0"), "mix-plan")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    d, p = docs.withColumn("_size", size).alias("d"), plan.alias("p")
    same = (F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d._size") == F.col("p.size")))
    return (d.join(p, same).select(*[F.col(f"d.{c}") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("p.copies"))).alias("_copy"))
            .drop("_copy"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
