"""Mixing sources to target weights along a time-varying curriculum.

Sizes are words.  Each source's target is its weighted share of the budget,
limited to ``max_repeat`` times its size, the excess reshared by weight.  A
source's documents stand in hash order on a token line; the first ``target``
words of that line (repeated once it is used up) are taken, so a source's taken
words equal its rounded target.  A source's weight may vary over the training
time 0..1: its schedule is integrated to cumulative token demand, and a
document's training position is the time at which demand reaches its words.

Null text has size 0 and takes nothing.  Null sources form one source, last in
order.  Repeated rows are separate documents; ties in hash order break by
doc_id, then size.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.llm.common import WORD, materialise, range_ranked, table

WEIGHTS = (5.0, 2.0, 1.0)
#: Weight over training time as (time, factor) knots, linear in between; by order of the source, repeating.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
SRC = ["src_null", "src"]


def invert_demand(u: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the share ``u`` of the schedule's integral is reached."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, out = sum(areas), F.lit(knots[-1][0])
    # segment by segment, the last first: solve w0*x + slope*x*x/2 = rest
    upto = [sum(areas[:k + 1]) / total for k in range(len(areas))]
    for k in range(len(areas) - 1, -1, -1):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        rest = u * total - sum(areas[:k])
        slope = (w1 - w0) / (t1 - t0)
        x = rest / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest)) - w0) / slope
        here = F.least(F.lit(t1), F.greatest(F.lit(t0), t0 + x))
        out = here if k == len(areas) - 1 else F.when(u <= upto[k], here).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5,
                   max_repeat: float = 2.0) -> DataFrame:
    """One row per source: src_null, src, source_size, order (by code point,
    null last), target.  ``sizes`` has src_null, src, size."""
    per = sizes.groupBy(*SRC).agg(F.sum("size").alias("source_size"))
    ranked = range_ranked(materialise(per.withColumn("_all", F.lit(0)), "mix-sources"), ["_all"], SRC, name="mix-order")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = materialise(ranked.select(*SRC, "source_size", F.col("rank").alias("order"), w.alias("weight"),
                                    (F.col("source_size") * max_repeat).alias("most")), "mix-weights")
    # raise the level (words per weight) until no source is above its most
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:
        before = level
        full = F.col("most") <= F.lit(before) * F.col("weight")
        r = src.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("held"),
                    F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        level = max(before, (budget * total - r["held"]) / r["open"]) if r["open"] else before
    return src.select(*SRC, "source_size", "order",
                      F.least(F.col("most"), F.lit(float(level)) * F.col("weight")).alias("target"))


def curriculum_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, max_repeat: int = 2,
                   schedules: tuple = SCHEDULES, seed: int = 17) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, first_taken
    (words of the first pass), position and again_position (training times of its
    first and repeated words; null if not taken), range-sorted by position."""
    if max_repeat != 2:
        raise ValueError("the token line is repeated once: max_repeat must be 2")
    sizes = docs.select(
        F.col("doc_id").cast("long"), F.col("source").isNull().alias("src_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = materialise(sizes.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")), "mix-sizes")
    targets = source_targets(sizes, weights, budget, float(max_repeat))
    line = range_ranked(sizes, SRC, ["_h", "doc_id", "size"], size="size", name="mix-line")
    d = line.join(targets, SRC)
    quota = F.floor(F.col("target") + 0.5).cast("long")
    part = lambda q: F.greatest(F.lit(0), F.least(F.col("size"), q - F.col("before")))
    d = (d.withColumn("quota", quota)
         .withColumn("first_taken", part(F.col("quota")).cast("long"))
         .withColumn("again", part(F.col("quota") - F.col("source_size")).cast("long")))
    middle = F.col("before") + F.col("first_taken") / 2
    again = F.col("source_size") + F.col("before") + F.col("again") / 2

    def at(words: Column) -> Column:
        share = words / F.greatest(F.col("quota"), F.lit(1))
        out = invert_demand(share, schedules[0])
        for k, s in enumerate(schedules[1:], 1):
            out = F.when(F.col("order") % len(schedules) == k, invert_demand(share, s)).otherwise(out)
        return out

    return (d.select("doc_id", F.when(F.col("src_null"), None).otherwise(F.col("src")).alias("source"), "size",
                     "source_size", "target", (F.col("first_taken") + F.col("again")).alias("taken"), "first_taken",
                     F.when(F.col("first_taken") > 0, at(middle)).alias("position"),
                     F.when(F.col("again") > 0, at(again)).alias("again_position"))
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def op8_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum_mix(table(spark, sf_dir, "documents")).drop("source")
