"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 letters, with
word edges marked) by descending count, ties by code point.  A document's own
profile is compared to each language's by out-of-place distance: the sum of rank
differences, an absent n-gram counting as the profile's length.  The nearest
language wins, ties by name.

Texts are read whole, lower-cased.  Null texts and texts without letters give
``und`` and score 0.  Repeated rows are predicted each; without training rows
every prediction is ``und``.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaweave.llm.common import char_table, chunks, fold, table

EDGE = 1  # code of a word edge; not a letter
BITS = 21  # of a code point


def gram_counts(texts: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, gram, count), sorted by group and gram; texts of equal ``group`` count together.

    A gram holds up to three code points of ``BITS`` bits each."""
    lowered = [f"\n{t.lower()}\n" for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    code = np.where(char_table()[code] & 1, code, EDGE)
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != EDGE) | (code[:-1] != EDGE) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    # small codes in code point order, so that (group, gram) packs into one integer
    used = np.zeros(0x110000, dtype=bool)
    used[code] = True
    letters = np.nonzero(used)[0]
    small = np.zeros(0x110000, dtype=np.int64)
    small[letters] = np.arange(1, len(letters) + 1)
    x, base = small[code], len(letters) + 1
    edge = code == EDGE
    g = group[row].astype(np.int64)
    same2, same3 = row[1:] == row[:-1], row[2:] == row[:-2]
    two = same2 & ~(edge[1:] & edge[:-1])
    three = same3 & ~edge[1:-1]
    grams = np.concatenate([x[~edge], (x[:-1] * base + x[1:])[two], ((x[:-2] * base + x[1:-1]) * base + x[2:])[three]])
    owner = np.concatenate([g[~edge], g[:-1][two], g[:-2][three]])
    span = base ** 3
    if int(group.max(initial=0) + 1) * span >= 2 ** 63:  # very many different letters: two halves
        half = len(texts) // 2
        parts = [gram_counts(texts[:half], group[:half]), gram_counts(texts[half:], group[half:])]
        own, gram, n = (np.concatenate(p) for p in zip(*parts))
        at = np.lexsort((gram, own))
        own, gram, n = own[at], gram[at], n[at]
        first = np.nonzero(np.r_[True, (own[1:] != own[:-1]) | (gram[1:] != gram[:-1])])[0] if len(own) else np.zeros(0, int)
        return own[first], gram[first], np.add.reduceat(n, first) if len(own) else n
    key = np.sort(owner * span + grams)
    first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.zeros(0, dtype=int)
    n = np.diff(np.r_[first, len(key)])
    own, packed = key[first] // span, key[first] % span
    real = np.r_[0, letters]
    gram = np.zeros(len(packed), dtype=np.int64)
    for div in (base * base, base, 1):
        gram = (gram << BITS) | real[packed // div % base]
    return own, gram, n


def profiles(train: DataFrame, size: int, max_languages: int) -> dict[str, list[int]]:
    """language -> its ``size`` most frequent grams in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], int] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()),
                                               pa.array(sums.values(), pa.int64())], names=["lang", "gram", "n"])
            sums.clear()
            return rows

        for batch, texts in chunks(batches, max_chars=500_000):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            group = np.array([names.index(x) for x in langs])
            for g, gram, n in zip(*(a.tolist() for a in gram_counts(texts, group))):
                k = (names[g], gram)
                sums[k] = sums.get(k, 0) + n
            if len(sums) > 250_000:
                yield out()
        yield out()

    counts = train.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
           .withColumn("r", F.row_number().over(best)).where(F.col("r") <= size))
    rows = top.select("lang", "gram", "r").limit(size * max_languages + 1).collect()
    if len(rows) > size * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def identify(texts: list[str], langs: dict[str, list[int]], size: int) -> tuple[list[str], np.ndarray]:
    """Language and score (1 - distance / largest distance) of each text."""
    names = sorted(langs)
    own, gram, n = gram_counts(texts, np.arange(len(texts)))
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    if not len(own) or not names:
        return pred, score
    order = np.lexsort((gram, -n, own))
    own, gram = own[order], gram[order]
    first = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0]
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    top = rank < size
    own, gram, rank = own[top], gram[top], rank[top]
    first = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0]
    most = np.diff(np.r_[first, len(own)]) * size
    known = np.array(sorted({g for p in langs.values() for g in p}))
    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
    found = known[at] == gram
    dist = np.empty((len(names), len(first)))
    for k, name in enumerate(names):
        place = np.full(len(known), -1)
        place[np.searchsorted(known, langs[name])] = np.arange(len(langs[name]))
        here = np.where(found, place[at], -1)
        dist[k] = np.add.reduceat(np.where(here < 0, size, np.abs(here - rank)), first)
    best = dist.argmin(0)
    for doc, b, s in zip(own[first].tolist(), best.tolist(), (1 - dist.min(0) / most).tolist()):
        pred[doc], score[doc] = names[b], s
    return pred, score


def predict(docs: DataFrame, langs: dict[str, list[int]], size: int = 300) -> DataFrame:
    """doc_id, lang_pred, score for every row, from the text alone."""
    model = docs.sparkSession.sparkContext.broadcast(langs)  # at most size * max_languages grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, max_chars=500_000):
            pred, score = identify(texts, model.value, size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str, size: int = 300, max_languages: int = 1000) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = docs.where((fold("doc_id", 4) != 2) & F.col("lang").isNotNull())
    out = predict(docs, profiles(train, size, max_languages), size)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
