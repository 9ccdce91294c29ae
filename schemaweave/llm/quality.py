"""Text quality: random Fourier features of document statistics, ridge, isotonic scores.

Statistics of the whole text (lengths, letter classes, repetition, layout) are
standardised and mapped to cosines that approximate a Gaussian kernel.  Ridge
weights come from normal equations summed over partitions; their size depends on
the number of features alone.  Ridge values are calibrated to probabilities by
isotonic regression over rounded values (a bounded table).

Null text counts as empty and is scored.  Labels of a repeated doc_id are
averaged; null labels and labels without a document are ignored.  With no
training rows every score is 0.5, with one class only its share.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaweave.llm.common import char_table, chunks, fold, materialise, table

STATS = ("log_words", "word_length", "word_spread", "upper", "digits", "symbols", "top_symbol", "spaces", "distinct_words",
         "repeated_grams", "repeated_lines", "line_words", "symbol_words", "upper_words", "compression", "sentence_words")


def statistics(text: str) -> list[float]:
    """The values of STATS; all 0 for an empty text."""
    if not text:
        return [0.0] * len(STATS)
    flags = char_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    kinds = np.bincount(flags, minlength=9)
    n, letters, upper, digits, spaces = len(text), int(kinds[1] + kinds[3]), int(kinds[3]), int(kinds[4]), int(kinds[8])
    words = text.split()
    w = len(words) or 1
    symbols = n - letters - digits - spaces
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    marks = Counter(x for x in set(text) if not x.isalnum() and not x.isspace() and x not in ".,")
    top = max((text.count(x) for x in marks), default=0)
    grams = list(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "surrogatepass")
    return [
        np.log1p(len(words)), letters / w, float(lengths.std()) if words else 0.0, upper / max(letters, 1), digits / n, symbols / n,
        top / n, spaces / n, len(set(words)) / w ** 0.9, 1 - len(set(grams)) / len(grams) if grams else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, np.log1p(w / max(len(lines), 1)),
        sum(not x.isalnum() for x in words) / w, sum(map(str.isupper, words)) / w,
        len(zlib.compress(raw, 1)) / (len(raw) + 20), np.log1p(w / (1 + text.count(". ") + text.count(".\n")))]


def stats_of(docs: DataFrame) -> DataFrame:
    """doc_id, stats: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, max_chars=1_000_000):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))],
                                             names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # ridge values, ascending
    levels: np.ndarray  # their calibrated probabilities
    learnt: bool = True  # False without training rows

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        out = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase)
        return np.hstack([out, np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge(x), self.knots, self.levels)


def isotonic(values: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending ``values`` with counts and hits."""
    blocks: list[list[float]] = []  # first value, last value, n, hits
    for v, m, h in zip(values, n, hits):
        blocks.append([v, v, m, h])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0], a[1], blocks[-1][2] + a[2], blocks[-1][3] + a[3]]
    knots = np.array([x for b in blocks for x in (b[0], b[1])])
    return knots, np.repeat([b[3] / b[2] for b in blocks], 2)


def fit(labelled: DataFrame, features: int = 128, gamma: float = 0.03, penalty: float = 1e-4, seed: int = 5) -> Model:
    """``labelled``: rows of stats and y (0..1)."""
    labelled = materialise(labelled.select("stats", "y"), "quality-train")
    d = len(STATS)
    r = labelled.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)],
                     *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)]).first()
    rng = np.random.default_rng(seed)
    freq, phase = rng.normal(0, np.sqrt(2 * gamma), (d, features)), rng.uniform(0, 2 * np.pi, features)
    flat = np.zeros(features + 1)
    if not r["n"]:
        return Model(np.zeros(d), np.ones(d), freq, phase, flat, np.array([0.0]), np.array([0.5]), False)
    mean = np.array([r[f"m{i}"] for i in range(d)])
    scale = np.array([r[f"s{i}"] or 1.0 for i in range(d)])
    model = Model(mean, np.maximum(scale, 1e-9), freq, phase, flat, np.array([0.0]), np.array([0.5]))
    size = features + 1
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                f = model.features(np.array(batch.column("stats").to_pylist()))
                y = batch.column("y").to_numpy()
                a, b = a + f.T @ f, b + f.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a[upper], b])], pa.list_(pa.float64()))], names=["v"])

    rows = (labelled.mapInArrow(sums, "v array<double>").select(F.posexplode("v").alias("at", "v"))
            .groupBy("at").agg(F.sum("v").alias("v")).collect())
    v = np.zeros(len(upper[0]) + size)
    for x in rows:
        v[x["at"]] = x["v"]
    a = np.zeros((size, size))
    a[upper] = v[:-size]
    a = a + np.triu(a, 1).T
    ridge = penalty * r["n"] * np.eye(size)
    ridge[-1, -1] = 1e-9 * r["n"]
    model.weights = np.linalg.solve(a + ridge, v[-size:])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist()).reshape(-1, d)
            at = np.rint(np.clip(model.ridge(x), -1, 2) * 1000).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["at", "y"])

    found = labelled.mapInArrow(values, "at long, y double").groupBy("at").agg(F.count("y").alias("n"), F.sum("y").alias("h"))
    found = sorted((x["at"], x["n"], x["h"]) for x in found.collect())  # at most 3001 rows
    at, n, hits = (np.array(c, dtype=float) for c in zip(*found))
    model.knots, model.levels = isotonic(at / 1000, n, hits)
    return model


def fit_labels(docs: DataFrame, labels: DataFrame, label: str, **params) -> Model:
    y = (labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
         .agg(F.avg(label).cast("double").alias("y")))
    return fit(stats_of(docs).join(y, "doc_id"), **params)


def score(docs: DataFrame, model: Model, cut: float = 0.7) -> DataFrame:
    """``docs`` with score and predicted added (replacing columns of those names)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, max_chars=1_000_000):
            s = held.value.score(np.array([statistics(t) for t in texts]))
            cols = [*batch.columns, pa.array(s), pa.array((s >= cut).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "score", "predicted"])

    schema = T.StructType(list(docs.schema.fields)).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_labels(docs.where(fold("doc_id", 4) != 2), table(spark, sf_dir, "labels"), "quality")
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
