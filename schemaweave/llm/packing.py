"""Best-fit packing of tokenised documents into fixed-length sequences.

Best fit in sweeps over runs, on the driver.  Documents and gaps are sorted by size; equal sizes
are runs, and a run is (size, rank interval), so the state of a round is bounded
by the sequence length, not by the corpus.  A sweep takes the document runs from
long to short and gives each the successor gap run (smallest gap that holds it);
where several rows want the same gaps the lower ranks win, the gaps shrink, and
the rest goes on to the next gap run or opens new sequences.  The ranks of the
rows themselves come from a distributed range sort, and every row finds its
place from (length, rank) without another shuffle.

Null text counts as empty (one piece: the end token).  Repeated rows are packed
once each.  Only documents longer than a sequence are cut; the first piece takes
the remainder.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.llm.common import chunks, materialise, range_ranked, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"

# Splitting rule of the byte-level BPE for texts of ASCII and Latin-1 letters;
# any other text goes through the tokenizer as a whole.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPLIT = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[0-9]+| ?[^\t-\r {_L}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_PLAIN = re.compile(rf"[\x00-\x7f{_L}]*")


class BpeBytes(dict):
    """Word -> its token ids as little-endian 32-bit bytes, encoded when first
    met; the memory is emptied when ``limit`` words are held."""

    def __init__(self, path: str, limit: int = 120_000):
        super().__init__()
        import tiktoken

        self.path, self.limit, self.tokenizer = path, limit, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.bpe = tiktoken.Encoding("bytes", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.bpe.encode_ordinary(word), dtype="<u4").tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, _SPLIT.findall(text)))
        if self.tokenizer is None:  # few texts need it
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_LOADED: dict[str, BpeBytes] = {}


def _encoder(path: str) -> BpeBytes:
    if path not in _LOADED:
        _LOADED[path] = BpeBytes(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document is its ids followed by ``end_id``.  The tokenizer file is a
    parameter and must be readable on every executor.
    """
    path = tokenizer_path or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch, texts in chunks(batches, max_chars=1_000_000):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids = memoryview(enc.encode(text) + end)
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = n % capacity or capacity if at == 0 else capacity
                    for col, v in zip(rows, (doc, k, at, size, zlib.crc32(ids[4 * at:4 * (at + size)]))):
                        col.append(v)
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit_plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) for runs of equal
    lengths: ranks first..end-1 of that length go, in order, to the sequences
    from the first on, at the offset.  Its size depends on ``capacity`` alone."""
    gaps: dict[int, deque[tuple[int, int]]] = {}
    sizes: list[int] = []  # gap sizes in use, ascending
    plan, opened = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = deque()
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        at, end = 0, counts[size]
        while at < end:
            k = bisect.bisect_left(sizes, size)
            if k < len(sizes):  # the successor gaps; lower ranks first
                gap = sizes[k]
                first, n = gaps[gap].popleft()
                m = min(n, end - at)
                if m < n:
                    gaps[gap].appendleft((first + m, n - m))
                elif not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(k)
                plan.append((size, at, at + m, first, capacity - gap))
                leave(gap - size, first, m)
                at += m
            else:  # no gap holds it: whole sequences of this size, then one for the rest
                each = capacity // size
                n = max(1, (end - at) // each)
                for j in range(min(each, end - at)):
                    plan.append((size, at, at + n, opened, j * size))
                    at += n
                    used = j + 1
                leave(capacity - used * size, opened, n)
                opened += n
    return plan


def pack_best_fit(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``token_pieces``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(size < 1 or size > capacity for size in counts):
        raise ValueError(f"piece lengths must lie in 1..{capacity}")
    plan = sorted(best_fit_plan(counts, capacity))
    ranked = range_ranked(pieces.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32")),
                          ["length"], ["_h", "doc_id", "piece", "start", "ids_crc32"], name="packing-ranked").drop("_h")
    span = max(counts.values(), default=0) + 1
    starts = np.array([p[0] * span + p[1] for p in plan], dtype=np.int64)
    first = np.array([p[3] - p[1] for p in plan], dtype=np.int64)
    offsets = np.array([p[4] for p in plan], dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(starts, length * span + rank, side="right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(first[k] + rank), pa.array(offsets[k])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048) -> DataFrame:
    return pack_best_fit(materialise(token_pieces(docs, tokenizer_path, capacity), "packing-pieces"), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
