"""Audit of how each source's terms diverge from its language and from its sibling sources.

A term is a run of ASCII letters (lower-cased) and characters beyond ASCII.  Each
language keeps the terms of at least ``least_docs`` of its documents; there are V.
A group is an occurring (lang, source); it, and each language as a whole, gives every
kept term p = 1 + floor(10^9 (count + 1) / (N + V)), N its count of kept terms.
Divergence of p from q is f = floor((p - q)^2 / q).

* part ``pair``: for every other source of the language the sum of f over all kept
  terms, q that source's;
* part ``term``: the group's terms with p > q, q the language's, by f; only the first
  ``top``.

Term ranking is a dominance skyband.  f never falls with a higher group count, never
rises with a higher language count, and ties go to the earlier UTF-8 term, so a term
that ``top`` others beat in all three cannot be ranked.  Every partition streams its
sorted rows and retains the terms that fewer than ``top`` others dominate; the
skybands of up to ``fan`` partitions merge per round, and what is left is ranked exactly.

Pair sums take only the terms that occur: a term in neither source adds a constant, a
term in one of them adds a value of its count alone (summed over the histogram of
counts), and a term in both is corrected where the term's sources meet.

Null text, lang and source count as ''.  Every row is a document, so repeated rows count
each.  A language without kept terms gives pair values of 0 and no term rows; empty
tables give no rows; long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaweave.llm.common import materialise, table

SCALE = 1_000_000_000
#: Bytes of a term: ASCII letters, lower-cased, and every byte of a character beyond ASCII; all else parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, held: int = 400_000) -> DataFrame:
    """lang, source, term, n, df: partial sums, one row per task, flush and term at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, dict[bytes, list[int]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in sums.items():
                n = np.array(list(terms.values()), dtype=np.int64).reshape(-1, 2)
                k = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()),
                     pa.array(list(terms), pa.binary()), pa.array(n[:, 0]), pa.array(n[:, 1])],
                    names=["lang", "source", "term", "n", "df"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("lang", "source", "text")]
            for lang, source, text in zip(*cols):
                own = sums.setdefault((lang, source), {})
                before = len(own)
                here: dict[bytes, int] = {}
                for term in text.translate(_TERM_BYTES).split():
                    here[term] = here.get(term, 0) + 1
                for term, n in here.items():
                    got = own.get(term)
                    if got is None:
                        own[term] = [n, 1]
                    else:
                        got[0] += n
                        got[1] += 1
                size += len(own) - before
                if size > held:
                    yield from (b for b in out() if b.num_rows)
                    sums, size = {}, 0
        yield from (b for b in out() if b.num_rows)

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return (rows.mapInArrow(count, "lang string, source string, term binary, n long, df long")
            .withColumn("term", F.col("term").cast("string")))


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE (count + 1) / total), exact beyond 64 bits."""
    scaled = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.lit(1) + F.call_function("div", scaled, total.cast("decimal(38,0)")).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def skyband(group: np.ndarray, other: np.ndarray, k: int, retained: tuple[np.ndarray, np.ndarray] | None = None,
            block: int = 512) -> np.ndarray:
    """Which of the rows, given in ascending order of term, fewer than ``k`` others dominate: an
    earlier row with at least its ``group`` and at most its ``other`` count.  ``retained`` holds the
    counts of the rows kept before these.  Dominators that were dropped need no count: their own
    ``k`` dominators are dominators too."""
    seen_g, seen_o = retained or (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keep = np.zeros(len(group), dtype=bool)
    for at in range(0, len(group), block):
        g, o = group[at:at + block], other[at:at + block]
        n = ((seen_g[None, :] >= g[:, None]) & (seen_o[None, :] <= o[:, None])).sum(1)
        left = np.nonzero(n < k)[0]
        if not len(left):
            continue
        g, o = g[left], o[left]
        beats = np.triu((g[:, None] >= g[None, :]) & (o[:, None] <= o[None, :]), 1)  # [earlier, later]
        # a dropped row's dominators count as well (see above), so one sum over the block is exact
        stay = (n[left] + beats.sum(0)) < k
        keep[at + left[stay]] = True
        seen_g, seen_o = np.concatenate([seen_g, g[stay]]), np.concatenate([seen_o, o[stay]])
    return keep


def skybands(rows: DataFrame, k: int, merge: bool) -> DataFrame:
    """Rows (lang, source, term, c, total, part) that survive within their partition; with ``merge``
    rows of equal ``part`` are brought together first.  State is one group's skyband."""
    parts = rows.repartition("lang", "source", "part") if merge else rows
    order = parts.sortWithinPartitions("lang", "source", "part", "term")
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, g0, o0 = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "part"))))
            g, o = batch.column("c").to_numpy(zero_copy_only=False), batch.column("total").to_numpy(zero_copy_only=False)
            cuts = [0] + [i for i in range(1, len(heads)) if heads[i] != heads[i - 1]] + [len(heads)]
            keep = np.zeros(len(heads), dtype=bool)
            for a, b in zip(cuts, cuts[1:]):
                if heads[a] != now:
                    now, g0, o0 = heads[a], np.zeros(0, np.int64), np.zeros(0, np.int64)
                keep[a:b] = skyband(g[a:b], o[a:b], k, (g0, o0))
                g0, o0 = np.concatenate([g0, g[a:b][keep[a:b]]]), np.concatenate([o0, o[a:b][keep[a:b]]])
            yield batch.filter(pa.array(keep))

    return order.mapInArrow(run, schema)


def top_terms(kept: DataFrame, stats: DataFrame, top: int, fan: int) -> DataFrame:
    """lang, source, term, value, rank of the terms of part ``term``."""
    p, q = share(F.col("c"), F.col("n") + F.col("v")), share(F.col("total"), F.col("n_lang") + F.col("v"))
    above = kept.join(stats, ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("p > q")
    bands = above.select("lang", "source", "term", "c", "total", "p", "q", F.spark_partition_id().alias("part"))
    bands = materialise(skybands(bands, top, merge=False), "skyband")
    parts = bands.agg(F.max("part")).first()[0]
    while parts:  # up to ``fan`` skybands become one
        bands = skybands(bands.withColumn("part", F.floor(F.col("part") / fan).cast("int")), top, merge=True)
        bands = materialise(bands, "skyband")
        parts //= fan
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return (bands.select("lang", "source", "term", divergence(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))


def shared_terms(kept: DataFrame, most: int = 1_000_000) -> DataFrame:
    """lang, a, b, value: the correction that the terms of both a and b bring to their pair sum, summed
    per task.  Input rows carry lang, term, source, p and p0 (p of an absent term); the rows of a
    (lang, term) lie together, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict, list, list]] = {}  # lang -> source numbers, per-term (numbers, p, p0)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, terms, _) in held.items():
                names = list(numbers)
                by_size: dict[int, list] = {}
                for t in terms:
                    by_size.setdefault(len(t[0]), []).append(t)
                keys, values = [], []
                for s, group in by_size.items():
                    step = max(1, most // (s * s))
                    width = max(1, most // s)  # of the terms of very many sources, so many rows of the square at once
                    for at in range(0, len(group), step):
                        idx, p, p0 = (np.array([t[i] for t in group[at:at + step]], dtype=np.int64) for i in range(3))
                        for lo in range(0, s, width):
                            hi = min(s, lo + width)
                            a, pa_, za = idx[:, lo:hi, None], p[:, lo:hi, None], p0[:, lo:hi, None]
                            b, pb, zb = idx[:, None, :], p[:, None, :], p0[:, None, :]
                            f = lambda x, y: (x - y) ** 2 // y
                            v = f(pa_, pb) - f(pa_, zb) - f(za, pb) + f(za, zb)
                            key, inv = np.unique(np.broadcast_to(a * len(names) + b, v.shape).ravel(), return_inverse=True)
                            sums = np.zeros(len(key), dtype=np.int64)
                            np.add.at(sums, inv.ravel(), v.ravel())
                            keys.append(key)
                            values.append(sums)
                if not keys:
                    continue
                key, inv = np.unique(np.concatenate(keys), return_inverse=True)
                sums = np.zeros(len(key), dtype=np.int64)
                np.add.at(sums, inv.ravel(), np.concatenate(values))
                a, b = key // len(names), key % len(names)
                other = a != b
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * int(other.sum()), pa.string()), pa.array([names[i] for i in a[other]], pa.string()),
                     pa.array([names[i] for i in b[other]], pa.string()), pa.array(sums[other])], names=["lang", "a", "b", "value"])

        last = None
        for batch in batches:
            for lang, term, source, p, p0 in zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "source", "p", "p0"))):
                if (lang, term) != last and size >= most:
                    yield from flush()
                    held, size = {}, 0
                numbers, terms, _ = held.setdefault(lang, ({}, [], []))
                if (lang, term) != last:
                    terms.append(([], [], []))
                    last = (lang, term)
                i = numbers.setdefault(source, len(numbers))
                row = terms[-1]
                row[0].append(i)
                row[1].append(p)
                row[2].append(p0)
                size += 1
        yield from flush()

    return kept.mapInArrow(run, "lang string, a string, b string, value long")


def pair_sums(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """lang, source, item, value of part ``pair``."""
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("n") + F.col("v")))
    groups = materialise(stats.select("lang", "source", "n", "v", zero.alias("p0")), "divergence-groups")
    here = (kept.join(groups, ["lang", "source"])
            .select("lang", "term", "source", share(F.col("c"), F.col("n") + F.col("v")).alias("p"), "p0"))
    both = shared_terms(here.repartition("lang", "term").sortWithinPartitions("lang", "term"))
    # terms by their count alone: how many terms of the group have share p
    bars = (kept.groupBy("lang", "source", "c").agg(F.count(F.lit(1)).alias("terms"))
            .join(groups, ["lang", "source"]).withColumn("p", share(F.col("c"), F.col("n") + F.col("v"))))
    sibling = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("z"))
    rest = divergence(F.col("p0"), F.col("z"))
    one = bars.join(sibling, "lang").where("source <> item").withColumn("own", (divergence(F.col("p"), F.col("z")) - rest) * F.col("terms"))
    back = (bars.join(sibling, "lang").where("source <> item")
            .withColumn("own", (divergence(F.col("z"), F.col("p")) - divergence(F.col("z"), F.col("p0"))) * F.col("terms")))
    base = (groups.join(sibling, "lang").where("source <> item")
            .select("lang", "source", "item", F.coalesce(rest * F.col("v"), F.lit(0)).cast("long").alias("own")))
    parts = (base.union(one.select("lang", "source", "item", "own")).union(back.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "own"))
             .union(both.select("lang", "a", "b", "value")))
    return parts.groupBy("lang", "source", "item").agg(F.sum("own").alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, fan: int = 16) -> DataFrame:
    """lang, source, part, item, value, rank; see the module."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # the rows of a (lang, term) lie together from here on: at most one per source
    dealt = term_counts(named).repartition("lang", "term")
    per_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("c"), F.sum("df").alias("df"))
    whole = Window.partitionBy("lang", "term")
    kept = (per_source.withColumn("total", F.sum("c").over(whole)).withColumn("df", F.sum("df").over(whole))
            .withColumn("first", F.row_number().over(whole.orderBy("source")) == 1)
            .where(F.col("df") >= least_docs).select("lang", "term", "source", "c", "total", "first"))
    kept = materialise(kept, "divergence-terms")
    of_lang = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    vocabulary = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    stats = (named.select("lang", "source").distinct().join(of_lang, ["lang", "source"], "left").join(vocabulary, "lang", "left")
             .select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n", "v", "n_lang")]))
    stats = materialise(stats, "divergence-stats")
    terms = top_terms(kept, stats, top, fan).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (pair_sums(kept, stats).withColumn("rank", F.row_number().over(order))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))
    return terms.union(pairs)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
occ AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT id) AS df FROM t GROUP BY ALL),
terms AS (SELECT lang, term, sum(c) AS total FROM occ GROUP BY ALL HAVING sum(df) >= 3),
lang_n AS (SELECT lang, count(*) AS v, sum(total) AS n FROM terms GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, k.total
  FROM grp g JOIN terms k ON g.lang = k.lang
  LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
grp_n AS (SELECT lang, source, sum(c) AS n FROM cell GROUP BY ALL),
pq AS (
  SELECT c.lang, c.source, c.term, c.c,
         1 + (1000000000 * (c.c + 1)::HUGEINT) // (g.n + l.v) AS p,
         1 + (1000000000 * (c.total + 1)::HUGEINT) // (l.n + l.v) AS q
  FROM cell c JOIN grp_n g ON g.lang = c.lang AND g.source = c.source JOIN lang_n l ON l.lang = c.lang),
pair_sum AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM pq a JOIN pq b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sum s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
best AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM pq WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= 200
"""
