"""Exact top-k inner products on a bit-sliced index.

Components are quantised to floor(256 * x).  A block of rows (by hash, bounded) is
stored as bitmaps: per dimension, one bitmap for each bit of the value above the
block's minimum, and of the maximum minus the value, which serves negative query
components.  A query adds the bitmaps its components' bits select, all rows at
once, with carry-save adders; the score's bitmaps are then read from the most
significant one down to keep the rows of the k best scores.  Rows that tie at the
boundary are resolved by vec_id, and the blocks' best rows are merged by (score,
vec_id).

Vectors that are null, empty or hold null or non-finite components, and rows with
a null vec_id, take no part.  Only vectors of equal length are compared.  Repeated
rows with one vec_id are candidates each, but never for a query of that vec_id,
which is answered once.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaweave.llm.common import materialise, table
from schemaweave.llm.cover_tree import usable

FORM = "dim int, block long, ids binary, low binary, high binary, place binary, slices binary"


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 to rows of 64-bit words, lowest bit first."""
    width = -(-bits.shape[1] // 64) * 64
    padded = np.zeros((bits.shape[0], width), dtype=np.uint8)
    padded[:, :bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def slice_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimum, maximum, place, slices): ``place`` has per dimension and side (value, complement)
    the first slice and the number of slices."""
    low, high = values.min(0), values.max(0)
    place, parts, at = np.zeros((values.shape[1], 2, 2), dtype=np.int64), [], 0
    for d in range(values.shape[1]):
        n = int(high[d] - low[d]).bit_length()
        for side, v in enumerate((values[:, d] - low[d], high[d] - values[:, d])):
            place[d, side] = at, n
            if n:
                parts.append(pack((v[None, :] >> np.arange(n)[:, None] & 1).astype(np.uint8)))
                at += n
    words = -(-len(values) // 64)
    return low, high, place, np.concatenate(parts) if parts else np.zeros((0, words), dtype=np.uint64)


def add_slices(by_weight: dict[int, np.ndarray], words: int) -> list[np.ndarray]:
    """Bitmaps of the sum of weighted bitmaps, from bit 0 up: full adders on three at a time."""
    out, weight = [], 0
    pending = dict(by_weight)
    while pending:
        rows = pending.pop(weight, np.zeros((0, words), dtype=np.uint64))
        carries = [pending.pop(weight + 1)] if weight + 1 in pending else []
        while len(rows) > 1:
            if len(rows) == 2:
                rows = np.concatenate([rows, np.zeros((1, words), dtype=np.uint64)])
            m = len(rows) // 3
            x = rows[:3 * m].reshape(m, 3, words)
            t = x[:, 0] ^ x[:, 1]
            carries.append((x[:, 0] & x[:, 1]) | (t & x[:, 2]))
            rows = np.concatenate([t ^ x[:, 2], rows[3 * m:]])
        out.append(rows[0] if len(rows) else np.zeros(words, dtype=np.uint64))
        if carries:
            pending[weight + 1] = np.concatenate(carries)
        weight += 1
    return out


def top_rows(score: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest scores among ``valid``; of equal ones the first rows."""
    count = lambda x: int(np.bitwise_count(x).sum())
    sure, open_, n = np.zeros_like(valid), valid, 0
    for s in reversed(score):
        one = open_ & s
        c = count(one)
        if n + c >= k:
            open_ = one
        else:
            sure, n, open_ = sure | one, n + c, open_ & ~s
    rows = lambda x: np.nonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))[0]
    return np.concatenate([rows(sure), rows(open_)[:k - n]])


def search_block(ids: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray, slices: np.ndarray,
                 query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and scores of the block's k best rows for the query."""
    words = -(-len(ids) // 64)
    picked: dict[int, list[np.ndarray]] = {}
    const = 0
    for d, q in enumerate(query.tolist()):
        const += q * int(low[d]) if q >= 0 else q * int(high[d])
        at, n = place[d, 0 if q >= 0 else 1].tolist()
        if n:
            mag = abs(q)
            for bit in range(mag.bit_length()):
                if mag >> bit & 1:
                    for s in range(n):
                        picked.setdefault(bit + s, []).append(at + s)
    score = add_slices({w: slices[rows] for w, rows in picked.items()}, words)
    valid = pack((ids != query_id).astype(np.uint8)[None, :])[0]
    best = top_rows(score, valid, k)
    total = [const + sum(int(s[r >> 6] >> np.uint64(r & 63) & np.uint64(1)) << w for w, s in enumerate(score)) for r in best.tolist()]
    return ids[best], np.array(total, dtype=np.int64)


def top_k(vectors: DataFrame, query_mod: int = 50, k: int = 5, scale: int = 256, block_rows: int = 16_384,
          query_rows: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query (vec_id divisible by ``query_mod``)."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))
    rows = (vectors.where(F.col("vec_id").isNotNull() & usable("embedding"))
            .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.size("embedding").alias("dim")))
    rows = materialise(rows, "bits-rows")
    n = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    dealt = rows.join(n, "dim").select("dim", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / block_rows)).alias("block"), "vec_id", "v")
    blocks = dealt.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("m"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                m = b.column("m")[i].values
                ids = m.field("vec_id").to_numpy()
                values = m.field("v").flatten().to_numpy().reshape(len(ids), -1)
                low, high, place, slices = slice_block(values)
                cells = [x.astype(np.int64).tobytes() for x in (ids, low, high, place)] + [slices.tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("dim").slice(i, 1), b.column("block").slice(i, 1), *(pa.array([c], pa.binary()) for c in cells)],
                    names=["dim", "block", "ids", "low", "high", "place", "slices"])

    index = materialise(blocks.mapInArrow(build, FORM), "bits-index")
    queries = rows.where(F.col("vec_id") % query_mod == 0).dropDuplicates(["vec_id"])
    sets = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("sets"))
    queries = (queries.join(sets, "dim").groupBy("dim", F.pmod(F.xxhash64(F.lit(2), "vec_id"), "sets").alias("set"))
               .agg(F.collect_list(F.struct("vec_id", "v")).alias("q")))
    # every block meets every set of queries: each block once for each set, joined by (dim, set)
    work = (index.join(sets, "dim").withColumn("set", F.explode(F.sequence(F.lit(0), F.col("sets") - 1))).drop("sets")
            .join(queries, ["dim", "set"]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cell = lambda c, t: np.frombuffer(b.column(c)[i].as_py(), dtype=t)  # noqa: B023, E731
                ids, low, high = (cell(c, np.int64) for c in ("ids", "low", "high"))
                place = cell("place", np.int64).reshape(-1, 2, 2)
                slices = cell("slices", np.uint64).reshape(-1, -(-len(ids) // 64))
                found: tuple[list, list, list] = ([], [], [])
                for q in b.column("q")[i].as_py():
                    best, score = search_block(ids, low, high, place, slices, np.array(q["v"]), q["vec_id"], k)
                    for col, x in zip(found, ([q["vec_id"]] * len(best), best.tolist(), score.tolist())):
                        col.extend(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    found = work.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows of each block
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


#: floor and the inner product in whole numbers; ties to the smaller vec_id.
ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id,
    CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
