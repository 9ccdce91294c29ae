"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Shingles are runs of five words (lower-cased letters and digits); the i-th
occurrence of a shingle in a text is labelled i, so labelled shingles are distinct.
A sketch takes the several smallest labelled shingles under one hash function and
keeps their text order; texts that share one sketch are candidates.  Short texts
add sketches of fewer shingles.

Similarity of two texts is m / (p + q - m) for texts of p and q labelled shingles
whose longest common subsequence has length m; texts of similarity 0.8 or more
are linked.  Such an alignment stays within (p + q) / 9 positions of the
diagonal, so it is found inside that band, exactly.

Equal texts are one representative from the start.  In each sketch bucket every
representative is first aligned with the bucket's smallest one.  Buckets that then
still hold several classes are compared in blocks: the members outside the bucket's
largest class with all members of other classes, aligned where the blocks meet, and a
spanning forest of the links found goes out.  Before any alignment the shingles'
numbers by hash slot bound the common ones from above and rule pairs out
exactly.  Links are never collected; classes come from connected components.

A null text is alone in its class; equal texts without words share one.  Repeated
rows (same doc_id) are one document with that of its texts whose SHA-256 is
smallest; ``row_ids`` tells them apart where every row counts.  A null doc_id is
ignored.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.llm.common import chunks, materialise, table
from schemaweave.llm.components import connected_components

_WORD = re.compile(r"[^\W_]+")
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: (sketches, shingles in each, longest text in shingles that gets them; 0: every text)
SKETCHES = ((32, 6, 0), (40, 4, 48))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: WordHash, size: int = 5) -> np.ndarray:
    """Hashes of the labelled shingles in text order; a shorter text is one shingle."""
    h = np.array(list(map(words.__getitem__, _WORD.findall(text.lower()))), dtype=np.uint64)
    if not len(h):
        return h
    if len(h) < size:
        h = np.r_[h, np.zeros(size - len(h), dtype=np.uint64)]
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = mix(out * GOLD + h[i:len(h) - size + 1 + i])
    order = np.argsort(out, kind="stable")
    s = out[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if new.all():
        return out
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    label = np.empty(len(s), dtype=np.uint64)
    label[order] = np.arange(len(s)) - first
    return np.where(label > 0, mix(out + label * GOLD), out)


def sketches(h: np.ndarray, sketch_sets=SKETCHES, seed: int = 11) -> np.ndarray:
    """Keys of the text's sketches."""
    keys = []
    for j, (m, ell, longest) in enumerate(sketch_sets):
        if not len(h) or longest and len(h) > longest:
            continue
        rng = np.random.default_rng(seed + j)
        a = rng.integers(1, 2 ** 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2 ** 63, m, dtype=np.uint64)
        g = h[None, :] * a[:, None] + b[:, None]
        k = min(ell, len(h))
        at = np.argpartition(g, k - 1, axis=1)[:, :k] if k < len(h) else np.tile(np.arange(k), (m, 1))
        picked = h[np.sort(at, axis=1)]  # in text order
        key = mix(b + np.uint64(k))
        for i in range(k):
            key = mix(key * GOLD + picked[:, i])
        keys.append(key)
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def aligned(p: np.ndarray, q: np.ndarray, least: float = 0.8) -> float:
    """Similarity of two sequences of distinct hashes by banded alignment; 0 if below ``least``."""
    n, m = len(p), len(q)
    need = least * (n + m) / (1 + least)
    if min(n, m) < need - 1e-9 or not n:
        return 0.0
    common, at_p, at_q = np.intersect1d(p, q, assume_unique=True, return_indices=True)
    band = int((n + m) * (1 - least) / (1 + least)) + 1
    close = np.abs(at_p - at_q) <= band
    if close.sum() < need - 1e-9:
        return 0.0
    at_p, at_q = at_p[close], at_q[close]
    run = at_q[np.argsort(at_p)]
    if (np.diff(run) > 0).all():
        best = len(run)
    else:  # longest increasing run of positions
        tails: list[int] = []
        for x in run.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        best = len(tails)
    s = best / (n + m - best)
    return s if s >= least - 1e-12 else 0.0


SLOTS = 512


def signature(h: np.ndarray) -> bytes:
    """Number of labelled shingles by hash slot; empty (bounds nothing) if a number passes 254."""
    n = np.bincount((mix(h) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    return n.astype(np.uint8).tobytes() if n.max() < 255 else b""


def slots(sigs: list[bytes]) -> np.ndarray:
    """Signatures as rows; -1 in the first slot marks one that bounds nothing."""
    return np.stack([np.frombuffer(x, np.uint8).astype(np.int16) if x else np.full(SLOTS, -1, np.int16) for x in sigs])


def possible(sig: bytes, rows: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``slots`` may belong to texts similar to the one of ``sig``."""
    if not sig:
        return np.ones(len(rows), dtype=bool)
    x = np.frombuffer(sig, np.uint8).astype(np.int16)
    common = np.minimum(rows, x).sum(1, dtype=np.int64)
    total = rows.sum(1, dtype=np.int64) + x.sum(dtype=np.int64)
    return (rows[:, 0] < 0) | (common >= least * (total - common) - 1e-9)


def _signatures(texts: DataFrame) -> DataFrame:
    """(id, sig) of the candidates' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch, part in chunks(batches, max_chars=1_000_000):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([signature(shingles(t, words)) for t in part], pa.binary())],
                                             names=["id", "sig"])

    return texts.mapInArrow(run, "id long, sig binary")


def _possible(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` that their signatures do not rule out."""
    two = (pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
           .join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            mask = pa.array([possible(x, slots([y]), least)[0] for x, y in zip(sa, sb)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return two.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts are similar enough."""
    pairs = materialise(_possible(pairs, sigs, least), "omh-possible")
    two = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
           .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kept = WordHash(), {}

        def of(doc: int, cell: pa.Scalar) -> np.ndarray:
            if doc not in kept:
                if len(kept) > 300:
                    kept.clear()
                kept[doc] = shingles(cell.as_py(), words)
            return kept[doc]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = [i for i in range(batch.num_rows)
                    if aligned(of(a[i], batch.column("text_a")[i]), of(b[i], batch.column("text_b")[i]), least)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())],
                                             names=["a", "b"])

    return two.mapInArrow(run, "a long, b long")


def _shingled(texts: DataFrame) -> DataFrame:
    """(id, h): the labelled shingles of the texts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch, part in chunks(batches, max_chars=500_000):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingles(t, words).tobytes() for t in part], pa.binary())],
                                             names=["id", "h"])

    return texts.mapInArrow(run, "id long, h binary")


def _across(held: DataFrame, texts: DataFrame, least: float, block: int, load: int = 200_000) -> DataFrame:
    """(a, b): links between different classes within the buckets, a spanning forest per two blocks.

    ``held`` has key, id, n and the class c.  Buckets of two were settled with
    their smallest member, and buckets of the same members are compared once.
    Members are dealt into blocks of about ``block`` rows or ``load`` shingles; a block of
    those outside the largest class meets each block of the bucket.  The shingles come along,
    so pairs are aligned where they meet: each pair that the shingles' numbers by hash slot
    do not rule out and that is not yet connected through other links.  Only links
    that connect leave a task, fewer than its members, however many pairs it holds."""
    per = held.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("id")).alias("x"))
    keys = (per.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("m").alias("size"), F.sum("w").alias("w"), F.bit_xor("x").alias("x"),
                                   F.max(F.struct("m", (-F.col("c")).alias("low"))).alias("most"))
            .where("classes > 1 and size > 2").groupBy("x", "size")
            .agg(F.min(F.struct("key", (-F.col("most.low")).alias("main"), (F.col("size") - F.col("most.m")).alias("out"), "w")).alias("k"))
            .select(F.col("k.key").alias("key"), F.col("k.main").alias("main"),
                    F.ceil(F.col("size") / block + F.col("k.w") / load).alias("ms"),
                    F.ceil(F.col("k.out") / block + F.col("k.w") / load).alias("os")))
    rows = materialise(held.join(keys, "key"), "omh-open")
    h = materialise(_shingled(texts.join(rows.select("id").distinct(), "id", "left_semi")), "omh-shingles")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    out = rows.where("c <> main").select("key", "id", "n", "c", at("os").alias("o"), every("ms").alias("m"), F.lit(0).alias("side"))
    all_ = rows.select("key", "id", "n", "c", every("os").alias("o"), at("ms").alias("m"), F.lit(1).alias("side"))
    work = out.union(all_).join(h, "id").repartition("key", "o", "m").sortWithinPartitions("key", "o", "m", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, root = None, [], {}
        left: list[int] = []
        right: list[int] = []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            heads = list(zip(*(batch.column(c).to_pylist() for c in ("key", "o", "m"))))
            cols = [batch.column(c).to_pylist() for c in ("id", "n", "c", "side", "h")]
            for head, i, n, c, side, raw in zip(heads, *cols):
                if head != now:  # the block of those outside the largest class comes first
                    now, members, root = head, [], {}
                    held_sig, held_n, held_c = None, None, None
                shingle = np.frombuffer(raw, dtype=np.uint64)
                # a class is connected already: its members stand for it
                root.setdefault(("c", c), ("c", c))
                if side == 0:
                    members.append((i, n, c, shingle))
                    continue
                if held_sig is None:
                    held_sig = slots([signature(x[3]) for x in members]) if members else np.zeros((0, SLOTS), np.int16)
                    held_n, held_c = np.array([x[1] for x in members]), np.array([x[2] for x in members])
                if not members:
                    continue
                ok = np.nonzero((held_c != c) & (np.minimum(held_n, n) >= least * np.maximum(held_n, n)))[0]
                ok = ok[possible(signature(shingle), held_sig[ok], least)]
                for k in ok.tolist():
                    other, _, cls, theirs = members[k]
                    x, y = find(("c", c)), find(("c", cls))
                    if x != y and aligned(theirs, shingle, least):
                        root[x] = y
                        left.append(min(i, other))
                        right.append(max(i, other))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
            left, right = [], []

    return work.mapInArrow(run, "a long, b long").distinct()


def text_classes(texts: DataFrame, least: float = 0.8, sketch_sets=SKETCHES, block: int = 256) -> DataFrame:
    """(id, class_id) of every id: class_id is the smallest id of its class.  ``texts`` has id (long, not
    null) and text; rows that repeat an id must repeat its text."""
    # equal texts: one representative, the smallest id
    digest = F.when(F.col("text").isNull(), F.concat(F.lit("null "), F.col("id").cast("string"))).otherwise(F.sha2(F.col("text"), 256))
    rows = materialise(texts.select(F.col("id").alias("own"), digest.alias("digest")), "omh-digest").distinct()
    same = materialise(rows.groupBy("digest").agg(F.min("own").alias("id")), "omh-same")  # so that the join can split a hot digest
    member = materialise(rows.join(same, "digest").select("own", "id"), "omh-member")
    first = same.select("id")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch, part in chunks(batches, max_chars=1_000_000):
            ids, keys, n = [], [], []
            for i, text in zip(batch.column("id").to_pylist(), part):
                h = shingles(text, words)
                k = sketches(h, sketch_sets)
                ids.append(np.full(len(k), i, dtype=np.int64))
                n.append(np.full(len(k), len(h), dtype=np.int32))
                keys.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, n)], names=["key", "id", "n"])

    reps = texts.select("id", "text").where("text is not null")
    keys = materialise(reps.mapInArrow(sketch, "key long, id long, n int"), "omh-keys")
    # copies were sketched as well, for nothing but the time: their rows go here, and so do those of repeated rows
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high")
    keys = materialise(keys.join(shared, "key").join(first, "id", "left_semi").select("key", "id", "n").distinct(), "omh-shared")
    centre = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"))
    longer = F.least("n", "m") >= least * F.greatest("n", "m")  # else the lengths alone rule a link out
    star = (keys.join(centre.select("key", F.col("c.id").alias("a"), F.col("c.n").alias("m")), "key")
            .where((F.col("a") < F.col("id")) & longer).select("a", F.col("id").alias("b")).distinct())
    held_texts = reps.join(keys.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    held_texts = materialise(held_texts, "omh-texts")
    sigs = materialise(_signatures(held_texts), "omh-signatures")
    links = materialise(_verify(materialise(star, "omh-star"), held_texts, sigs, least), "omh-links")
    cls = connected_components(links)
    # buckets that still hold several classes
    held = materialise(keys.join(cls, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c")), "omh-held")
    found = materialise(_across(held, held_texts, least, block), "omh-links")
    if found.take(1):
        cls = connected_components(links.union(found))
    out = member.join(cls.select("id", "component"), "id", "left")
    return out.select(F.col("own").alias("id"), F.coalesce("component", "id").alias("class_id"))


def row_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id``: the doc_id of the rows whose doc_id stands for one text; rows without
    a doc_id, or whose doc_id stands for several texts, get a negative number of their own per (doc_id, text)."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    digest = F.coalesce(F.sha2(text, 256), F.lit("null"))
    pairs = materialise(docs.select(doc.alias("d"), digest.alias("g")).distinct(), "omh-rows")
    several = pairs.where("d is not null").groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d")
    odd = pairs.join(several, "d", "left_semi").union(pairs.where("d is null"))
    low = min(0, pairs.agg(F.min("d")).first()[0] or 0)
    odd = materialise(odd.withColumn("s", F.lit(low - 1) - F.monotonically_increasing_id()), "omh-odd-rows")
    if not odd.take(1):
        return docs.withColumn("_id", doc)
    alone = docs.where("doc_id is not null").join(several.withColumnRenamed("d", "_d"), doc == F.col("_d"), "left_anti").withColumn("_id", doc)
    rest = docs.withColumn("_g", digest).join(odd, doc.eqNullSafe(F.col("d")) & (F.col("_g") == F.col("g")))
    return alone.unionByName(rest.select(*docs.columns, F.col("s").alias("_id")))


def near_duplicates(docs: DataFrame, least: float = 0.8, sketch_sets=SKETCHES, block: int = 256) -> DataFrame:
    """(doc_id, class_id, kept): class_id is the smallest doc_id of the class, kept marks that document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    own = docs.groupBy("id").agg(F.min(F.coalesce(F.sha2("text", 256), F.lit("null"))).alias("g"), F.count(F.lit(1)).alias("n"))
    again = materialise(own.where("n > 1").select("id", "g"), "omh-again")
    if again.take(1):  # repeated ids: only the text that stands for the id, that of the smallest digest
        chosen = docs.withColumn("g", F.coalesce(F.sha2("text", 256), F.lit("null"))).join(again, ["id", "g"]).dropDuplicates(["id"])
        docs = docs.join(again, "id", "left_anti").union(chosen.select("id", "text"))
    out = text_classes(docs, least, sketch_sets, block)
    return out.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
