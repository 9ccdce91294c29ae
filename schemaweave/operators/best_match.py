"""Best target per source where the targets are a table of any size.

``similarity.fuzzy_best_match`` and ``vector_best_match`` compile a short target list into
a projection.  The joins here take the targets as a table (target, pos); the smallest
``pos`` wins ties, as the first target of a list does.

* Edit ratio: levels of falling ratio.  On a level, texts meet over the rarest of their
  labelled q-grams (prefix filter) if their lengths allow the ratio; a source that finds
  a target on a level needs no lower one, since any better target lies on that level too.
* Token Jaccard: texts meet over shared tokens; a target without one scores 0.
* Vectors: targets are dealt to pivots; a source first looks into its nearest pivot's cell,
  then only into the cells that the triangle inequality cannot exclude.

Meeting points that many texts share are salted: targets are repeated per salt,
sources dealt to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweave.functions.text import tokenize
from schemaweave.operators.similarity import levenshtein_ratio
from schemaweave.session import scratch_path, ship_package

SALTS = 8


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sources(src: DataFrame, text_col: str) -> DataFrame:
    return src.select(F.col(text_col).cast("string").alias("_text")).where("_text is not null").distinct()


def _joined_back(src: DataFrame, text_col: str, best: DataFrame) -> DataFrame:
    return src.join(best, src[text_col].cast("string") == best["_text"]).drop("_text")


def _first_best(pairs: DataFrame, key: str) -> DataFrame:
    """Per ``key`` the pair of highest score, ties to the smallest pos."""
    return (pairs.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "target")).alias("b"))
            .select(key, F.col("b.target").alias("best_target"), (-F.col("b.s")).alias("best_score")))


# --- edit ratio ------------------------------------------------------------------------------------
def grams_needed(length: int, q: int, ratio: float) -> int:
    """Least number of labelled q-grams that a text of ``length`` shares with any text at ``ratio`` or more.

    An edit changes at most q of them, and the longer text has no more than length / ratio letters."""
    longest = math.floor(length / ratio + 1e-9)
    return min((n - q + 1) - q * math.floor((1 - ratio) * n + 1e-9) for n in range(length, longest + 1))


def shortest_filtered(q: int, ratio: float, upto: int = 4096) -> int:
    """Least length from which on q-grams filter (a shared one is certain); ``upto`` + 1 if there is none."""
    out = upto + 1
    for n in range(upto, 0, -1):
        if grams_needed(n, q, ratio) < 1:
            break
        out = n
    return out


def _grams(text: Column, q: int) -> Column:
    """Labelled q-grams: the i-th occurrence of a q-gram is gram + its number."""
    n = F.length(text) - (q - 1)
    plain = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, q))).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(plain, start, lambda acc, g: F.struct(
        F.concat(acc["seen"], F.array(g)).alias("seen"),
        F.concat(acc["out"], F.array(F.concat(g, F.size(F.filter(acc["seen"], lambda x: x == g)).cast("string")))).alias("out")))
    return done["out"]


def _prefixes(texts: DataFrame, counts: DataFrame, q: int, ratio: float) -> DataFrame:
    """texts with ``prefix``: its rarest labelled q-grams, one more than it may miss."""
    n = F.length("low")
    # the bound of grams_needed in closed form, at its least over the lengths that may meet this one
    longest = F.floor(n / F.lit(ratio) + 1e-9)
    need = F.array_min(F.transform(F.sequence(n.cast("long"), longest), lambda m: (m - (q - 1)) - q * F.floor((1 - ratio) * m + 1e-9)))
    gram = texts.withColumn("need", need).select("*", F.explode(_grams(F.col("low"), q)).alias("gram"))
    ordered = (gram.join(counts, "gram", "left").groupBy(*texts.columns, "need")
               .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("g")))
    kept = F.transform(F.slice("g", 1, F.greatest(F.size("g") - F.col("need") + 1, F.lit(0)).cast("int")), lambda x: x["gram"])
    return ordered.select(*texts.columns, kept.alias("prefix"))


def _edit_candidates(left: DataFrame, right: DataFrame, q: int, ratio: float, between: Column) -> DataFrame:
    """(_text, low, target, pos, t_low) of texts that share a q-gram of both prefixes, each pair once."""
    counts = right.select(F.explode(F.array_distinct(_grams(F.col("low"), q))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    a = _prefixes(left, counts, q, ratio).select("_text", "low", "prefix", F.explode("prefix").alias("gram"),
                                                 F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int").alias("salt"))
    b = (_prefixes(right, counts, q, ratio)
         .select("target", "pos", F.col("low").alias("t_low"), F.col("prefix").alias("t_prefix"), F.explode("prefix").alias("gram"))
         .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    x, y = F.length("low"), F.length("t_low")
    met = a.join(b, ["gram", "salt"]).where((F.least(x, y) >= ratio * F.greatest(x, y) - 1e-9) & between)
    return met.where(F.col("gram") == F.get(F.array_intersect("prefix", "t_prefix"), F.lit(0))).select("_text", "low", "target", "pos", "t_low")


def fuzzy_best_match_join(src: DataFrame, text_col: str, targets: DataFrame, threshold: float = 0.6,
                          levels: Sequence[float] = (0.85, 0.65)) -> DataFrame:
    """``src`` with best_target and best_score: the target of highest edit ratio that is >= ``threshold``
    and > 0, the smallest pos on ties.  ``targets`` has target and pos.  Sources without a match and
    null texts are dropped; each distinct text is scored once."""
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    tgt = targets.where("target is not null").select("target", "pos", F.lower("target").alias("low"))
    one = tgt.groupBy("low").agg(F.min(F.struct("pos", "target")).alias("b")).select("low", F.col("b.target").alias("target"), F.col("b.pos").alias("pos"))
    tgt = _written(one, "best-targets")
    left = _sources(src, text_col).withColumn("low", F.lower("_text"))
    equal = _written(left.join(tgt, "low").select("_text", F.col("target").alias("best_target"), F.lit(1.0).alias("best_score")), "best-equal")
    found = equal
    left = _written(left.join(equal, "_text", "left_anti").where("low <> ''"), "best-left")
    tgt = tgt.where("low <> ''")
    for ratio in [*[x for x in sorted(levels, reverse=True) if x > threshold], threshold]:
        q = 2 if ratio > 0.5 else 1
        least = shortest_filtered(q, ratio) if q > 1 else 1
        x, y = F.length("low"), F.length("t_low")
        pairs = _edit_candidates(left.where(F.length("low") >= least), tgt.where(F.length("low") >= least), q, ratio, F.lit(True))
        if least > 1:  # pairs with a text too short for q-grams meet over labelled letters
            reach = math.floor((least - 1) / ratio + 1e-9)
            pairs = pairs.union(_edit_candidates(left.where(F.length("low") <= reach), tgt.where(F.length("low") <= reach), 1, ratio,
                                                 (x < least) | (y < least)))
        scored = pairs.withColumn("score", levenshtein_ratio(F.col("low"), F.col("t_low"))).where((F.col("score") >= ratio) & (F.col("score") > 0))
        hits = _written(_first_best(scored, "_text"), "best-hits")
        found = found.union(hits)
        if ratio > threshold:
            left = _written(left.join(hits, "_text", "left_anti"), "best-left")
    return _joined_back(src, text_col, found)


def token_best_match_join(src: DataFrame, text_col: str, targets: DataFrame, threshold: float) -> DataFrame:
    """As :func:`fuzzy_best_match_join` with the Jaccard similarity of the token sets."""
    left = _sources(src, text_col).withColumn("tokens", tokenize("_text"))
    right = targets.where("target is not null").select("target", "pos", tokenize("target").alias("tokens"))
    a = left.select("_text", F.size("tokens").alias("m"), F.explode("tokens").alias("token"), F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int").alias("salt"))
    b = (right.select("target", "pos", F.size("tokens").alias("k"), F.explode("tokens").alias("token"))
         .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    met = a.join(b, ["token", "salt"]).groupBy("_text", "m", "target", "pos", "k").agg(F.count(F.lit(1)).alias("both"))
    scored = met.withColumn("score", F.col("both") / (F.col("m") + F.col("k") - F.col("both"))).where((F.col("score") >= threshold) & (F.col("score") > 0))
    return _joined_back(src, text_col, _first_best(scored, "_text"))


# --- vectors -----------------------------------------------------------------------------------------
def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable vectors: of this width, finite and not zero."""
    rows, out = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            x = np.array(v, dtype=np.float64)
            n = math.sqrt(float((x * x).sum()))
            if math.isfinite(n) and n > 0:
                rows.append(i)
                out.append(x / n)
    return np.array(rows, dtype=np.int64), np.array(out).reshape(-1, width)


def _best_in(x: np.ndarray, block: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``x`` the highest product with a row of ``block`` and its pos, ties to the smallest.

    Products within rounding of the best are summed again one way, so that equal vectors tie in every block."""
    approx = x @ block.T
    at, which = np.nonzero(approx >= approx.max(1, keepdims=True) - 1e-9)
    exact = (x[at] * block[which]).sum(1)
    order = np.lexsort((pos[which], -exact, at))
    first = order[np.r_[True, at[order][1:] != at[order][:-1]]]
    return exact[first], pos[which[first]]


def vector_best_match_join(src: DataFrame, key: str, vec_col: str, targets: DataFrame, threshold: float = 0.7,
                           block: int = 1024, max_pivots: int = 512) -> DataFrame:
    """(key, best_target, best_score) of the sources whose highest cosine with a target is above ``threshold``.

    ``targets`` has target, pos and vec; ``key`` is unique among the sources.  Vectors that are null, zero, hold null
    or non-finite components or have another width than the first target match nothing."""
    spark = src.sparkSession
    ship_package(spark)
    tgt = _written(targets.select("target", F.col("pos").cast("long").alias("pos"), F.col("vec").cast("array<double>").alias("vec")), "best-vectors")
    head = tgt.where("vec is not null and size(vec) > 0").orderBy("pos").limit(1).collect()
    n = tgt.count()
    types = dict(src.dtypes)
    if not head:
        return src.select(key, F.lit("").alias("best_target"), F.lit(0.0).alias("best_score")).where(F.lit(False))
    width = len(head[0]["vec"])
    sources = src.select(F.col(key).alias("_k"), F.col(vec_col).cast("array<double>").alias("vec"))
    schema = f"_k {types[key]}, score double, pos long"

    def result(keys, score, pos) -> pa.RecordBatch:
        keep = score > threshold
        return pa.RecordBatch.from_arrays([keys.filter(pa.array(keep)), pa.array(score[keep]), pa.array(pos[keep])], names=["_k", "score", "pos"])

    def chosen(hits: DataFrame) -> DataFrame:
        best = hits.groupBy("_k").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos")).alias("b")).select("_k", F.col("b.pos").alias("pos"), (-F.col("b.s")).alias("best_score"))
        names = tgt.groupBy("pos").agg(F.min("target").alias("best_target"))
        return best.join(names, "pos").select(F.col("_k").alias(key), "best_target", "best_score")

    if n <= block:  # one block: a matrix of proven size for every task
        held = tgt.select("pos", "vec").orderBy("pos").toArrow()
        rows, unit = _matrix(held.column("vec"), width)
        model = spark.sparkContext.broadcast((unit, held.column("pos").to_numpy()[rows]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, pos = model.value
            for batch in batches:
                at, x = _matrix(batch.column("vec"), width)
                if len(at) and len(unit):
                    yield result(batch.column("_k").take(pa.array(at)), *_best_in(x, unit, pos))

        return chosen(sources.mapInArrow(scan, schema))

    # pivots are targets, chosen by hash; every target belongs to its nearest one
    pivots = tgt.orderBy(F.xxhash64("pos"), "pos").limit(min(max_pivots, max(1, n // block * 2))).toArrow()
    _, centre = _matrix(pivots.column("vec"), width)
    if not len(centre):
        raise ValueError("no target vector can be compared")
    model = spark.sparkContext.broadcast(centre)  # at most max_pivots vectors
    far = lambda cosine: np.sqrt(np.maximum(0.0, 2 - 2 * cosine))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _matrix(batch.column("vec"), width)
            if len(at):
                near = x @ model.value.T
                cell = near.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("pos").take(pa.array(at)), pa.array(list(x), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)),
                                                  pa.array(far(near.max(1)))], names=["pos", "vec", "cell", "far"])

    dealt = _written(tgt.select("pos", "vec").mapInArrow(to_cells, "pos long, vec array<double>, cell int, far double"), "best-cells")
    cells = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).collect()  # one row per pivot
    radius, parts = np.full(len(centre), -np.inf), np.zeros(len(centre), dtype=np.int32)
    for r in cells:
        radius[r["cell"]], parts[r["cell"]] = r["radius"], r["parts"]
    sizes = spark.createDataFrame([(r["cell"], r["parts"]) for r in cells], "cell int, parts int")
    blocks = dealt.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("pos"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"),
                                                           F.lit(None).cast(types[key]).alias("_k"), "pos", "vec")

    def meet(wanted: DataFrame) -> DataFrame:
        """Best target of every wanted (_k, vec, cell) in each block of the cell, beyond its bound ``least``."""
        asked = wanted.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"),
                                                               "_k", F.lit(None).cast("long").alias("pos"), "vec")
        work = blocks.union(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "side")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, vecs, pos, unit = None, [], [], None
            for batch in batches:
                heads = list(zip(batch.column("cell").to_pylist(), batch.column("part").to_pylist(), batch.column("side").to_pylist()))
                cuts = [0] + [i for i in range(1, len(heads)) if heads[i] != heads[i - 1]] + [len(heads)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    piece = batch.slice(a, b - a)
                    if heads[a][:2] != now:
                        now, vecs, pos, unit = heads[a][:2], [], [], None
                    if heads[a][2] == 0:
                        vecs += piece.column("vec").to_pylist()
                        pos += piece.column("pos").to_pylist()
                        unit = None
                    elif vecs:
                        if unit is None:
                            unit, at = np.array(vecs), np.array(pos)
                        x = np.array(piece.column("vec").to_pylist())
                        yield result(piece.column("_k"), *_best_in(x, unit, at))

        return work.mapInArrow(run, schema)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _matrix(batch.column("vec"), width)
            if len(at):
                cell = np.where(parts[None, :] > 0, x @ model.value.T, -np.inf).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(at)), pa.array(list(x), pa.list_(pa.float64())), pa.array(cell.astype(np.int32))], names=["_k", "vec", "cell"])

    own = _written(sources.mapInArrow(nearest, f"_k {types[key]}, vec array<double>, cell int"), "best-own")
    first = _written(meet(own).groupBy("_k").agg(F.max("score").alias("best"), F.min(F.struct((-F.col("score")).alias("s"), "pos")).alias("b"))
                     .select("_k", "best", F.col("b.pos").alias("pos")), "best-first")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("vec").to_pylist())
            bound = far(np.array([threshold if b is None else b for b in batch.column("best").to_pylist()]))
            # a cell whose every target is farther than the best so far holds no better or equal one
            open_ = (far(x @ model.value.T) - radius[None, :] <= bound[:, None] + 1e-7) & (parts[None, :] > 0)
            open_[np.arange(len(x)), batch.column("cell").to_numpy()] = False
            row, cell = np.nonzero(open_)
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(row)), batch.column("vec").take(pa.array(row)), pa.array(cell.astype(np.int32))], names=["_k", "vec", "cell"])

    more = own.join(first.select("_k", "best"), "_k", "left").mapInArrow(others, f"_k {types[key]}, vec array<double>, cell int")
    hits = first.select("_k", F.col("best").alias("score"), "pos").union(meet(more))
    return chosen(hits)
