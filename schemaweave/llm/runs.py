"""Periodic runs of words, caught online as squares over dyadic blocks.

A run is a stretch of consecutive words with smallest period q (words q apart are equal),
at least ``least`` words and ``least_periods`` periods long, that no neighbouring word
extends keeping period q.

Words are appended to a ``Catchers``.  Level k holds one catcher for every completed
block of 2^k words that starts at a multiple of 2^k; it lies in wait for squares of
period 2^k to 2^(k+1) - 1.  Each appended word completes one suffix of 2^k words per
level, which is compared with the block of exactly one catcher, the only one whose
distance to the suffix is such a period.  Equality is a square's two copies of that block:
it is extended to the left and right by doubling comparisons and becomes a run, or merges
into the run that already holds it.  Any stretch of three periods holds a whole block of its
level and its copy one period on, so no run is missed.  Appending is in arrays: the
words of one append advance all catchers of a level at once.

Blocks are compared by 64-bit fingerprints of word numbers (a pair of half blocks is
mixed into one); every run that is reported has been checked word by word.

Words are the stretches free of ASCII white space.  Null and empty texts have no words and no
runs.  Every row is a document: repeated rows are judged each.  A null doc_id has no
planted stretch.  State is a document's words times the levels, log2 of a third of its
words.  Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.llm.common import table

_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)


class Collision(ArithmeticError):
    """Two different blocks had one fingerprint."""


def _mixed(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    """Fingerprint of a block from those of its halves."""
    x = left * np.uint64(_ODD + 2 * seed) + right
    x ^= x >> _SHIFT
    x *= _MIX
    x ^= x >> _SHIFT
    return x


class Catchers:
    """Online detection of the runs of one sequence of word numbers."""

    def __init__(self, least: int = 24, least_periods: int = 3, seed: int = 0):
        self.least, self.least_periods, self.seed = least, least_periods, seed
        self.words = np.zeros(0, dtype=np.int64)
        self.prints: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)]  # of each level's windows, by first word
        self.seen: list[int] = [0]  # windows of each level that have met their catcher
        self.found: dict[tuple[int, int], int] = {}  # (first word, period) -> word after the last

    def append(self, words: np.ndarray) -> None:
        before = len(self.words)
        self.words = np.concatenate([self.words, words]) if before else np.asarray(words, dtype=np.int64)
        n = len(self.words)
        fresh = _mixed(np.asarray(words).astype(np.uint64), np.full(len(words), 1, dtype=np.uint64), self.seed)
        self.prints[0] = np.concatenate([self.prints[0], fresh]) if before else fresh
        # a level is needed once a stretch of three periods of its least period fits
        while self.least_periods * 2 ** len(self.prints) <= n:
            self.prints.append(np.zeros(0, dtype=np.uint64))
            self.seen.append(0)
        for k in range(1, len(self.prints)):
            below, have, half = self.prints[k - 1], len(self.prints[k]), 2 ** (k - 1)
            more = _mixed(below[have:max(have, len(below) - half)], below[have + half:], self.seed)
            self.prints[k] = np.concatenate([self.prints[k], more]) if have else more
        for (start, q), end in list(self.found.items()):
            if end == before:  # the run reached the last word: it may grow
                self.found[start, q] = end + int(self._forward(np.array([end - q]), np.array([end]))[0])
        for k in range(len(self.prints)):
            self._advance(k)

    def _advance(self, k: int) -> None:
        """The windows completed since the last append meet the catchers of level ``k``."""
        p, size, at = self.prints[k], 2 ** k, max(self.seen[k], 2 ** k)
        self.seen[k] = max(self.seen[k], len(p))
        if at >= len(p):
            return
        # window j meets the block that starts at (floor(j / size) - 1) size
        first = (at // size) * size
        blocks = np.repeat(p[first - size:len(p) - size:size], size)[at - first:at - first + len(p) - at]
        j = at + np.nonzero(p[at:] == blocks)[0]
        if not len(j):
            return
        s = (j // size - 1) * size
        q = j - s
        if self.found:
            runs = np.array([(a, x, b) for (a, x), b in self.found.items()])
            new = np.ones(len(j), dtype=bool)
            for (a, x, b), lo, hi in zip(runs.tolist(), np.searchsorted(j, runs[:, 0]).tolist(), np.searchsorted(j, runs[:, 2]).tolist()):
                if lo < hi:  # a square inside a run whose period divides its own merges into that run
                    new[lo:hi] &= (s[lo:hi] < a) | (j[lo:hi] + size > b) | (q[lo:hi] % x != 0)
            j, s, q = j[new], s[new], q[new]
            if not len(j):
                return
        start = s - self._backward(s, j)
        end = j + self._forward(s, j)
        for a, x, b in sorted(set(zip(start.tolist(), q.tolist(), end.tolist())), key=lambda r: (r[1], r[0])):
            # a stretch that may still grow is kept however short it is
            if b - a >= self.least_periods * x and b - a >= self.least or b == len(self.words):
                self.found[a, x] = b

    def _forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        i, j = i.copy(), j.copy()
        first = j.copy()
        for k in range(len(self.prints) - 1, -1, -1):
            p, size = self.prints[k], 2 ** k
            live = np.nonzero(j < len(p))[0]
            while len(live):
                live = live[p[i[live]] == p[j[live]]]
                i[live] += size
                j[live] += size
                live = live[j[live] < len(p)]
        return j - first

    def _backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j (i < j)."""
        i, j = i.copy(), j.copy()
        first = i.copy()
        for k in range(len(self.prints) - 1, -1, -1):
            p, size = self.prints[k], 2 ** k
            live = np.nonzero(i >= size)[0]
            while len(live):
                live = live[p[i[live] - size] == p[j[live] - size]]
                i[live] -= size
                j[live] -= size
                live = live[i[live] >= size]
        return first - i

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run so far, by start and period."""
        best: dict[tuple[int, int], int] = {}
        for (a, q), b in self.found.items():
            if b - a >= max(self.least, self.least_periods * q):
                # stretches of equal bounds are one run: its periods are multiples of the smallest
                best[a, b] = min(q, best.get((a, b), q))
        out = []
        for (a, b), q in best.items():
            if not np.array_equal(self.words[a:b - q], self.words[a + q:b]):
                raise Collision
            out.append((a, b - a, q))
        return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(words: np.ndarray, least: int = 24, least_periods: int = 3, piece: int = 1 << 20) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words``, appended in pieces; other fingerprints
    are tried where two blocks collide."""
    for seed in range(64):
        caught = Catchers(least, least_periods, seed)
        for at in range(0, len(words), piece):
            caught.append(words[at:at + piece])
        try:
            return caught.runs()
        except Collision:
            continue
    raise Collision


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The stated test stretch: with h = crc32(doc_id), if h % 10 is 0, words from a on repeat with period p."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the strongest run's start, length, period and exponent_milli, and both hashes."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    listed = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    kept = words if keep.all() else [words[i] for i in np.nonzero(keep)[0].tolist()]
    collapsed = hashlib.sha256(b" ".join(kept)).hexdigest()
    best: tuple = (None, None, None)
    for run in runs:  # by start and period, so that ties keep the earlier one
        if best[0] is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return len(runs), *best, milli, listed, collapsed


SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def document_runs(docs: DataFrame, plant: bool = False, least: int = 24, least_periods: int = 3) -> DataFrame:
    """One row per document, see ``SCHEMA``; with ``plant`` the words are changed by ``planted`` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or b"").split()  # bytes: exactly the ASCII white space
                if plant:
                    words = planted(words, doc_id)
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
                # a run of three periods needs a word that comes back
                runs = runs_of(ids, least, least_periods) if len(words) >= least and len(numbers) < len(words) else []
                out.append((doc_id, *digest(words, runs)))
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_runs(table(spark, sf_dir, "documents"), plant=True)
