"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

Strings are the words of a sentence, accents and marks removed ("i.d.i.o.t" gives
"idiot"), and runs of single letters ("i d i o t").  The gap-weighted subsequence
kernel counts common three-letter subsequences, each weighted by decay ** span,
spans up to six letters; it is normalised, so an inserted, dropped or separated
letter lowers it a little instead of breaking the match.

Training sees labelled sentences of a bounded sample of labelled documents.
Landmarks are strings associated with label 1 (one per similar group) and common
other ones.  A sentence is represented by its string nearest to a landmark; a
document with label 1 gives its nearest sentence and all strings close to a landmark
(and copies with an inserted letter), one with label 0 its nearest three
sentences and its last.  A linear SVM
is fitted on the Nyström features, and again with the most toxic joined string of
each document of label 0.  Its value is linear in the explicit features
of the kernel, so a string is scored from its own subsequences.  A document's
score is the calibrated value of its most toxic string.

Null text counts as empty and gets the lowest score.  Repeated rows are scored
each.  Labels of a repeated doc_id are averaged; without labels of both classes
every score is the share of label 1 (0 without any).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaweave.llm.common import chunks, fold, materialise, table

SPAN, DECAY, LETTERS, WINDOW = 6, 0.8, 32, 16
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_SENTENCE = re.compile(r"[.!?]+(?=\s)|\n+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][^\w\n]{1,3}){2,}[^\W\d_](?![^\W_])")
_EDGES = ".,;:!?\"'()[]{}|$%&*#-_"


_DIGITS = str.maketrans("013457", "oieast")
_FOREIGN, _TOKEN, _OTHER_SPACE = re.compile(r"[^\x00-\x7f]+"), re.compile(r"\S+"), re.compile(r"[^\S\x00-\x7f]")
_NORMS = np.array([max(1e-9, sum(max(0, m - b) * (b - 1) * DECAY ** (2 * b + 2) for b in range(2, SPAN))) for m in range(WINDOW + 1)]) ** 0.5
SLACK = 1e-7  # of bounds, for rounding


def plain(token: str) -> str:
    """Letters of the token in lower case without accents; digits among letters stand for the letters they look like."""
    if token.isascii() and token.isalpha():
        return token
    if any(map(str.isalpha, token)):
        token = token.translate(_DIGITS)
    return "".join(c for c in unicodedata.normalize("NFKD", token) if c.isalpha())


class Plain(dict):
    """Memo of a word's letters (see ``plain``) without its edges; emptied when full."""

    def __missing__(self, word: str) -> str:
        if len(self) > 20_000:
            self.clear()
        out = self[word] = plain(word.strip(_EDGES))
        return out


class Spelt(dict):
    """Memo of runs of other than ASCII characters written so that ASCII rules read them: each character
    becomes its letters, a space or "-".  \\1 stands for a numeral that no letter rule covers, \\0 for a
    character that is a letter without letters or the reverse: the words of such a text are spelt one by one."""

    def __init__(self):
        super().__init__()
        self.plain = Plain()

    def __missing__(self, run: str) -> str:
        if len(self) > 20_000:
            self.clear()
        out = self[run] = "".join(map(self.letters, run))
        return out

    @staticmethod
    def letters(c: str) -> str:
        out = plain(c)
        if bool(out) != c.isalpha():
            return "\0"
        return out or (" " if c.isspace() else "\1" if c.isalnum() and not c.isdecimal() else "-")

    def word(self, word: str) -> str:
        return word if word.isascii() else (self.plain[word] or "-") + (word[-1] if word[-1] in ".!?" else "")

    def text(self, low: str) -> tuple[str, bool]:
        """The text, and whether every character stayed one character."""
        if low.isascii():
            return low, True
        out = _FOREIGN.sub(lambda m: self[m[0]], low)
        if "\0" in out:
            return _OTHER_SPACE.sub(" ", _TOKEN.sub(lambda m: self.word(m[0]), low)), False
        return out, len(out) == len(low) and "\1" not in out


def tokens_of(text: str) -> list[str]:
    low = text.lower()
    return [t.strip(_EDGES) for t in low.split()] + _SPACED.findall(low)


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def windows(string: str) -> list[str]:
    """The string, or windows of it if it is long; every subsequence of up to half a window lies in one."""
    if len(string) <= WINDOW:
        return [string]
    step = WINDOW // 2
    return [string[i:i + WINDOW] for i in range(0, len(string) - step, step)]


def explicit(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the normalised kernel features, sorted by row."""
    n = len(strings)
    code = np.full((n, WINDOW), -1, dtype=np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32)
    size = np.fromiter(map(len, strings), dtype=np.int64, count=n)
    row = np.repeat(np.arange(n), size)
    code[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = letter_codes(flat)
    return features(code)


def letter_codes(points: np.ndarray) -> np.ndarray:
    points = points.astype(np.int64)
    return np.where((points >= 97) & (points <= 122), points - 97, 26 + points % (LETTERS - 26))


def features(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``explicit`` of strings given as rows of letter codes, -1 behind their end."""
    n = len(code)
    keys, values = [], []
    for a, b in OFFSETS:
        x, y, z = code[:, :WINDOW - b], code[:, a:WINDOW - b + a], code[:, b:]
        r, at = np.nonzero(z >= 0)
        keys.append(((r * LETTERS + x[r, at]) * LETTERS + y[r, at]) * LETTERS + z[r, at])
        values.append(np.full(len(r), DECAY ** (b + 1)))
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    if not len(key):
        return key, key, value
    first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
    key, value = key[first], np.add.reduceat(value, first)
    row, feature = key // LETTERS ** 3, key % LETTERS ** 3
    norm = np.sqrt(np.bincount(row, weights=value ** 2, minlength=n))
    return row, feature, value / norm[row]


def linear(strings: list[str] | np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Products of the normalised features of strings (or rows of letter codes) with ``weights`` (features, or features x m)."""
    row, feature, value = features(strings) if isinstance(strings, np.ndarray) else explicit(strings)
    w = weights if weights.ndim == 2 else weights[:, None]
    out = np.zeros((len(strings), w.shape[1]))
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][:len(row)])
    # blocks of whole rows, of about a million products each
    cuts = [*range(0, len(first), max(1, 1_000_000 // (120 * w.shape[1]))), len(first)] if len(row) else []
    for a, b in zip(cuts, cuts[1:]):
        part = slice(first[a], first[b] if b < len(first) else len(row))
        out[row[first[a:b]]] = np.add.reduceat(w[feature[part]] * value[part, None], first[a:b] - first[a], axis=0)
    return out if weights.ndim == 2 else out[:, 0]


def landmark_matrix(landmarks: list[str]) -> np.ndarray:
    row, feature, value = explicit(landmarks)
    z = np.zeros((LETTERS ** 3, len(landmarks)))
    z[feature, row] = value
    return z


SPACE, OTHER, UNDERSCORE, NUMBER, DIGIT, LETTER = range(6)  # a digit looks like a letter, a number does not
_KIND = np.array([SPACE if chr(c).isspace() else LETTER if chr(c).isalpha() or c == 128 else DIGIT if c in _DIGITS
                  else NUMBER if chr(c).isdigit() else UNDERSCORE if chr(c) == "_" else OTHER for c in range(129)], dtype=np.uint8)
_LOOKS = np.array([_DIGITS.get(c, c) for c in range(128)], dtype=np.uint8)


class Letters:
    """The letters of all words of some texts one after the other, and bounds of the value of any run of them.

    Words without letters are left out.  A bound takes each subsequence's occurrences apart,
    which makes the norm smaller, never larger, so it bounds values above 0 only."""

    def __init__(self, texts: list[str], weights: np.ndarray, spelt: Spelt):
        low = [t.lower() for t in texts]
        own, even = zip(*map(spelt.text, low))
        whole = "\n".join(own) + "\n"
        narrow = whole.isascii()
        points = np.frombuffer(whole.encode("ascii"), np.uint8) if narrow else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = np.full(len(points) + 2, SPACE, dtype=np.uint8)
        kind[1:-1] = _KIND[points if narrow else np.minimum(points, 128)]
        edges = np.flatnonzero((kind[1:] == SPACE) != (kind[:-1] == SPACE))
        first, last = edges[::2], edges[1::2]
        stops = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1)
        owner = np.searchsorted(stops, first, side="right")

        # single letters a few characters apart: only texts with two of them may spell a string that way
        alone = np.flatnonzero((kind[1:-1] == LETTER) & (kind[2:] < UNDERSCORE) & (kind[:-2] < NUMBER))
        near = alone[:-1][np.diff(alone) <= 4]
        may = {*np.searchsorted(stops, near, side="right").tolist(), *(k for k, e in enumerate(even) if not e)}
        self.spaced = [(k, w) for k in sorted(may) for t in _SPACED.findall(low[k]) for w in windows(plain(t))]

        letter = kind[1:-1] == LETTER
        count = np.r_[0, np.cumsum(letter)]
        digit = np.flatnonzero(kind[1:-1] == DIGIT)
        if len(digit):  # they count in words that have a letter
            word = np.searchsorted(first, digit, side="right") - 1
            letter[digit[count[last[word]] > count[first[word]]]] = True
            count = np.r_[0, np.cumsum(letter)]
        ended = np.zeros(len(first) + 1, dtype=bool)  # a sentence before the word
        ended[np.searchsorted(first, np.flatnonzero(points == 10))] = True
        ended[1:] |= np.isin(points[last - 1], (33, 46, 63))
        sentence = np.cumsum(ended[:-1])
        start, end = count[first], count[last]
        # a text without tokens counts as one without letters
        self.short = np.bincount(owner, minlength=len(texts)) == 0
        self.short[owner[end - start < 3]] = True
        has = end > start
        self.start, self.end, self.owner, self.sentence = start[has], end[has], owner[has], sentence[has]
        points = points[letter]
        self.weights, self.code = weights, letter_codes(np.where(points < 128, _LOOKS[np.minimum(points, 127)], points))

        n = len(self.code)
        x, y, z = self.code * LETTERS ** 2, self.code * LETTERS, self.code
        self.sums, self.begin, self.finish = [], np.zeros(n + 1), np.zeros(n + 1)
        for b in range(2, SPAN):
            m = max(0, n - b)
            v = np.zeros(m)
            xz = x[:m] + z[b:b + m]
            for a in range(1, b):
                v += weights[xz + y[a:a + m]]
            c = np.zeros(n + 1)
            np.cumsum(v * DECAY ** (b + 1), out=c[1:m + 1])
            self.sums.append(c)
            self.begin += c
            self.finish[b:] += c[:max(0, n + 1 - b)]

    def bound(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A bound of the value of the letters from ``s`` to before ``e``."""
        v = self.finish[e] - self.begin[s]
        few = np.flatnonzero(e - s < SPAN - 1)
        f, g = s[few], e[few]
        v[few] = sum(np.where(g - b > f, c[np.maximum(g - b, f)] - c[f], 0.0) for b, c in zip(range(2, SPAN), self.sums))
        return v / _NORMS[e - s]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of the windows of words of at least three letters."""
        size = self.end - self.start
        step = WINDOW // 2
        n = np.where(size <= WINDOW, 1, -(-(size - step) // step)) * (size > 2)
        word = np.repeat(np.arange(len(size)), n)
        s = self.start[word] + step * (np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n))
        return self.owner[word], s, np.minimum(s + WINDOW, self.end[word])

    def runs(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end, bound) of runs of neighbouring words of a sentence, at most a window
        and at least three letters, whose value may exceed the text's ``least``."""
        found: list[tuple[np.ndarray, ...]] = []
        least, first = least[self.owner], np.arange(len(self.start))
        for j in range(1, WINDOW):
            first = first[:np.searchsorted(first, len(self.start) - j)]
            first = first[(self.sentence[first] == self.sentence[first + j]) & (self.end[first + j] - self.start[first] <= WINDOW)]
            if not len(first):
                break
            s, e = self.start[first], self.end[first + j]
            v = self.bound(s, e)
            at = np.flatnonzero((v + SLACK > least[first]) & (e - s > 2))
            found.append((self.owner[first[at]], s[at], e[at], v[at]))
        none = np.zeros(0, dtype=np.int64)
        return tuple(map(np.concatenate, zip(*found))) if found else (none, none, none, np.zeros(0))

    def search(self, best: np.ndarray, owner: np.ndarray, s: np.ndarray, e: np.ndarray, bound: np.ndarray) -> None:
        """Raises ``best`` (by text) to the largest value of the given runs of letters."""
        left = np.flatnonzero(bound + SLACK > best[owner])
        left = left[np.lexsort((-bound[left], owner[left]))]
        step = 1
        while len(left):
            who = owner[left]
            head = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            now = np.arange(len(left)) - np.repeat(head, np.diff(np.r_[head, len(left)])) < step
            tried, left = left[now], left[~now]
            for at in range(0, len(tried), 5000):
                part = tried[at:at + 5000]
                place = s[part][:, None] + np.arange(WINDOW)
                code = np.where(place < e[part][:, None], self.code[np.minimum(place, len(self.code) - 1)], -1)
                _, once, same = np.unique((code + 1).astype(np.uint8).view(f"S{WINDOW}")[:, 0], return_index=True, return_inverse=True)
                np.maximum.at(best, owner[part], linear(code[once], self.weights)[same])
            left = left[bound[left] + SLACK > best[owner[left]]]
            step *= 4

    def best_words(self) -> np.ndarray:
        """The largest value of a string of each text, joined ones apart; 0 without any string."""
        best = np.where(self.short, 0.0, -np.inf)
        owner, s, e = self.words()
        v = self.bound(s, e)
        # a value below 0 lies above its bound, and below 0
        self.search(best, owner, s, e, np.maximum(v, 0.0))
        if self.spaced:
            np.maximum.at(best, [k for k, _ in self.spaced], linear([w for _, w in self.spaced], self.weights))
        return best

    def best_runs(self, best: np.ndarray) -> None:
        """Raises ``best`` to the largest value of a joined string (see ``best_joined``, which names the string)."""
        self.search(best, *self.runs(best))


def pieces(texts: list[str], most: int = 200_000) -> Iterator[list[str]]:
    """The texts in lists of about ``most`` characters at most (a longer text makes its own list)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def joined(texts: list[str], weights: np.ndarray, least: np.ndarray, letters_of: Plain) -> list[list[tuple[float, str]]]:
    """Per text: the joined letters of each run of neighbouring words of a sentence
    (at most a window) whose value may exceed ``least``, with a bound of the value, best first.

    The bound takes each subsequence's occurrences apart, which makes the norm smaller, never larger."""
    parts, sizes, place, owner, sentence = [], [], [], [], 0
    for k, text in enumerate(texts):
        for s in sentences(text.lower()):
            words = list(filter(None, map(letters_of.__getitem__, s.split())))
            sentence += 1
            if len(words) > 1:
                parts += words
                sizes += map(len, words)
                place += [sentence] * len(words)
                owner += [k] * len(words)
    out: list[list[tuple[float, str]]] = [[] for _ in texts]
    if not parts:
        return out
    letters = "".join(parts)
    flat = np.frombuffer(letters.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    code = np.where((flat >= 97) & (flat <= 122), flat - 97, 26 + flat % (LETTERS - 26))
    sums = []
    for b in range(2, SPAN):
        n = max(0, len(code) - b)
        v = np.zeros(n)
        for a in range(1, b):
            v += weights[(code[:n] * LETTERS + code[a:n + a]) * LETTERS + code[b:n + b]]
        sums.append(np.concatenate([[0.0], np.cumsum(v * DECAY ** (b + 1)), np.zeros(b)]))
    ends, size, place, owner = np.cumsum(sizes), np.array(sizes), np.array(place), np.array(owner)
    starts, first = ends - size, np.arange(len(size))
    norms = np.array([max(1e-9, sum(max(0, m - b) * (b - 1) * DECAY ** (2 * b + 2) for b in range(2, SPAN))) for m in range(WINDOW + 1)])
    for j in range(1, WINDOW):
        first = first[first + j < len(size)]
        first = first[(place[first] == place[first + j]) & (ends[first + j] - starts[first] <= WINDOW)]
        if not len(first):
            break
        s, e = starts[first], ends[first + j]
        v = sum(np.where(e - b > s, c[np.maximum(e - b, s)] - c[s], 0.0) for b, c in zip(range(2, SPAN), sums)) / np.sqrt(norms[e - s])
        for i in np.nonzero((v > least[owner[first]]) & (e - s > 2))[0].tolist():
            out[owner[first[i]]].append((float(v[i]) + 1e-9, letters[s[i]:e[i]]))
    for found in out:
        found.sort(reverse=True)
    return out


def best_joined(texts: list[str], weights: np.ndarray, least: np.ndarray, letters_of: Plain | None = None) -> list[tuple[float, str]]:
    """Per text the joined string of the largest value, or (least, "") if none exceeds ``least``."""
    best = [(float(x), "") for x in least]
    left = joined(texts, weights, least, Plain() if letters_of is None else letters_of)
    step = 1
    while any(left):
        tried = [(k, s) for k, found in enumerate(left) for _, s in found[:step]]
        for at in range(0, len(tried), 5000):
            part = tried[at:at + 5000]
            for (k, s), v in zip(part, linear([s for _, s in part], weights).tolist()):
                if v > best[k][0]:
                    best[k] = (v, s)
        left = [[x for x in found[step:] if x[0] > best[k][0]] for k, found in enumerate(left)]
        step *= 4
    return best


class Scores(dict):
    """Token -> value of its best window; filled for many tokens at once, emptied when full."""

    def __init__(self, weights: np.ndarray, limit: int = 200_000):
        super().__init__()
        self.weights, self.limit, self.plain, self.spelt = weights, limit, Plain(), Spelt()

    def learn(self, tokens: set[str]) -> None:
        if len(self) > self.limit:
            self.clear()
        new = [t for t in tokens if t not in self]
        parts = [(t, w) for t in new for w in windows(self.plain[t])]
        for at in range(0, len(parts), 5000):
            part = parts[at:at + 5000]
            for (t, _), v in zip(part, linear([w for _, w in part], self.weights).tolist()):
                if v > self.get(t, -9e9):
                    self[t] = v


@dataclass
class Model:
    weights: np.ndarray  # of the kernel's explicit features
    bias: float
    slope: float
    intercept: float
    share: float | None = None  # the score of everything, if there is nothing to fit
    learnt: bool = True  # False if no labelled document was there

    def values(self, texts: list[str], cache: Scores) -> np.ndarray:
        """SVM value of each text's most toxic string."""
        out = [np.zeros(0)]
        for part in pieces(texts):
            letters = Letters(part, self.weights, cache.spelt)
            best = letters.best_words()
            letters.best_runs(best)
            out.append(best)
        return np.concatenate(out) + self.bias

    def scores(self, texts: list[str], cache: Scores) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        z = self.slope * self.values(texts, cache) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def association(sample: DataFrame, limit: int = 600) -> tuple[list[tuple[str, float]], list[str]]:
    """Strings by association with label 1 (signed log-likelihood ratio, best first), and common strings of label 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        letters_of = Plain()
        for batch, texts in chunks(batches, max_chars=1_000_000):
            for y, text in zip(batch.column("y").to_pylist(), texts):
                n[y].update(set(map(letters_of.__getitem__, tokens_of(text))))
        words = sorted(w for w in n[0].keys() | n[1].keys() if 3 <= len(w) <= WINDOW)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[1][w] for w in words], pa.int64()),
                                          pa.array([n[0][w] for w in words], pa.int64())], names=["s", "p", "q"])

    docs = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b = float(docs[1]), float(docs[0])
    counts = materialise(sample.mapInArrow(count, "s string, p long, q long").groupBy("s")
                         .agg(F.sum("p").alias("p"), F.sum("q").alias("q")), "toxic-strings")
    rate = (F.col("p") + F.col("q")) / (a + b)
    term = lambda n, e: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (rate * e))).otherwise(0.0)
    ratio = 2 * (term("p", a) + term("q", b))
    top = (counts.where((F.col("p") >= 2) & (F.col("p") / a > 5 * F.col("q") / b)).select("s", ratio.alias("g"))
           .where("g > 10").orderBy(F.desc("g"), "s").limit(limit).collect())
    other = counts.where(F.col("p") / a <= 2 * F.col("q") / b).orderBy(F.desc("q"), "s").limit(64).collect()
    return [(r["s"], r["g"]) for r in top], [r["s"] for r in other]


def choose_landmarks(toxic: list[str], common: list[str], n: int, near: float = 0.8) -> list[str]:
    """Strings best first, leaving out those nearer than ``near`` to one already chosen; a quarter are common ones."""
    out: list[str] = []
    for pool, most in ((toxic, n - n // 4), (common, n)):
        if not pool:
            continue
        z = landmark_matrix(pool)
        chosen: list[int] = []
        for i in range(len(pool)):
            if len(out) < most and (not chosen or (z[:, chosen].T @ z[:, i]).max() < near):
                chosen.append(i)
                out.append(pool[i])
    return out


def variants(string: str) -> list[str]:
    """The string with one letter inserted at either side of its middle letter, cut to a window."""
    at = len(string) // 2
    return [(string[:at] + "x" + string[at:])[:WINDOW], (string[:at + 1] + "e" + string[at + 1:])[:WINDOW]]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_docs: int = 8000, landmarks: int = 96,
        seed: int = 3) -> Model:
    """``fit_docs`` bounds the labelled documents of each class that training reads (chosen by hash)."""
    y = (labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
         .agg((F.avg(label) >= 0.5).cast("int").alias("y")).where("doc_id is not null"))
    # only labels of documents that training may read count
    y = materialise(y.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"), "toxic-labels")
    n = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    flat = Model(np.zeros(LETTERS ** 3), 0.0, 0.0, 0.0, n.get(1, 0) / max(1, sum(n.values())))
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, fit_docs / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, fit_docs / max(1, n.get(0, 0)))))
    drawn = y.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    sample = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(drawn), "doc_id").select("text", "y")
    sample = materialise(sample, "toxic-sample")
    seen = {r["y"] for r in sample.select("y").distinct().collect()}
    if seen != {0, 1}:
        flat.learnt = bool(seen)
        return flat
    toxic, common = association(sample)
    if not toxic:
        return flat
    marks = choose_landmarks([s for s, _ in toxic], common, landmarks)
    z = landmark_matrix(marks)
    values, vectors = np.linalg.eigh(z.T @ z)
    keep = values > 1e-6
    nystroem = vectors[:, keep] / np.sqrt(values[keep])  # K ** -1/2 on the range of K
    bad = sum(s in {t for t, _ in toxic} for s in marks)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters_of = Plain()
        for batch, texts in chunks(batches, max_chars=1_000_000):
            near: dict[str, float] = {}
            found = [[{p for t in tokens_of(s) for p in windows(letters_of[t])} for s in sentences(text)] for text in texts]
            new = sorted(set().union(*(s for doc in found for s in doc)))
            for at in range(0, len(new), 1000):
                part = new[at:at + 1000]
                near.update(zip(part, linear(part, z[:, :bad]).max(1).tolist()))
            strings, ys = [], []
            for doc, label in zip(found, batch.column("y").to_pylist()):
                best = [max(s, key=lambda w: (near[w], w)) for s in doc if s]
                by = sorted(dict.fromkeys(best), key=lambda w: (-near[w], w))
                if label:  # every string about as near to a landmark as the nearest
                    by = by[:1] + [w for w in sorted(set().union(*doc)) if near[w] >= 0.8 and w not in by[:1]]
                picked = [*by, *(v for w in by for v in variants(w))] if label else by[:3] + by[-1:]
                strings += picked
                ys += [label] * len(picked)
            k = linear(strings, z) @ nystroem if strings else np.zeros((0, nystroem.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(list(k), pa.list_(pa.float64())), pa.array(ys, pa.float64())], names=["k", "y"])

    train = materialise(sample.mapInArrow(examples, "k array<double>, y double"), "toxic-examples")
    train = train.select(array_to_vector("k").alias("features"), "y")
    m = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(m) < 2:
        return flat
    even = F.when(F.col("y") == 1, F.lit(m[0.0] / m[1.0])).otherwise(F.lit(1.0))
    svm = LinearSVC(featuresCol="features", labelCol="y", weightCol="w", maxIter=60, regParam=2e-4, standardization=False)
    once = svm.fit(train.withColumn("w", even))
    weights = z @ (nystroem @ once.coefficients.toArray())

    def harder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters_of = Plain()
        for batch, texts in chunks(batches, max_chars=1_000_000):
            strings = []
            for at in range(0, len(texts), 200):
                part = texts[at:at + 200]
                strings += [s for _, s in best_joined(part, weights, np.zeros(len(part)), letters_of) if s]
            k = linear(strings, z) @ nystroem if strings else np.zeros((0, nystroem.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(list(k), pa.list_(pa.float64())), pa.array([0.0] * len(k), pa.float64())], names=["k", "y"])

    more = materialise(sample.where("y = 0").select("text").mapInArrow(harder, "k array<double>, y double"), "toxic-joined")
    train = train.union(more.select(array_to_vector("k").alias("features"), "y"))
    even = F.when(F.col("y") == 1, F.lit((m[0.0] + more.count()) / m[1.0])).otherwise(F.lit(1.0))
    svm = svm.fit(train.withColumn("w", even))
    beta = nystroem @ svm.coefficients.toArray()
    model = Model(z @ beta, float(svm.intercept), 1.0, 0.0)

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Scores(model.weights)
        for batch, texts in chunks(batches, max_chars=1_000_000):
            values, ys = model.values(texts, cache).tolist(), batch.column("y").to_pylist()
            for text in [t for t, y in zip(texts, ys) if y]:  # its most toxic string with a letter inserted
                found = tokens_of(text)
                cache.learn(set(found))
                worst = max(found, key=lambda t: (cache.get(t, -9e9), t), default="")
                new = [v for w in windows(plain(worst)) for v in variants(w)[:1] if len(w) < WINDOW]
                values += (linear(new, model.weights) + model.bias).tolist() if new else []
                ys += [1] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), pa.array(ys, pa.int32())], names=["v", "y"])

    seen = materialise(sample.mapInArrow(maxima, "v double, y int"), "toxic-values")
    seen = seen.select(array_to_vector(F.array("v")).alias("features"), F.col("y").cast("double").alias("y"))
    curve = LogisticRegression(featuresCol="features", labelCol="y", maxIter=100, regParam=1e-4, standardization=False).fit(seen)
    model.slope, model.intercept = float(curve.coefficients[0]), float(curve.intercept)
    return model


def score(docs: DataFrame, model: Model, cut: float = 0.7) -> DataFrame:
    """``docs`` with score and predicted added (replacing columns of those names)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Scores(held.value.weights)
        for batch, texts in chunks(batches, max_chars=1_000_000):
            s = held.value.scores(texts, cache)
            cols = [*batch.columns, pa.array(s), pa.array((s >= cut).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "score", "predicted"])

    schema = T.StructType(list(docs.schema.fields)).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(fold("doc_id", 3) != 1), table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
