"""Brown class-based bigram model: exchange clustering and smoothed scores.

Tokens are the words of the ASCII-lower-cased text and one end per document.
The corpus is counted whole.  Clustering starts from units: each of the most
frequent words is a unit, every other word belongs to the unit of its last three
bytes, or to one common unit.  Exchange moves one unit after the other to the
class that gains most log-likelihood, on the bigrams of units, a table bounded by
parameters, until none moves.  Then every other word of the vocabulary is moved by
its own bigrams: its counts before and after each class are summed in Spark over
the whole corpus, the words move at once, and the class bigrams are counted again,
for ``word_rounds`` rounds or until no word has a better class.  A round that lowers the
likelihood is undone and tried with half of the words; after a round that succeeds all
may move again.  Only words that training never saw stay in their
unit's class.  A token's probability is
P(class | previous class) * P(word | class), with the transition interpolated
with the class's share and the emission (c + delta) / (T + delta * (V + 1)) over
the T tokens and V words of the class; a document starts after an end.

Counts of frequent words travel as a broadcast of at most ``head_words`` entries;
those of all other words are joined by word.  Null text counts as empty (one
end).  Repeated rows are scored each; a table without training documents gives
probabilities from the smoothing alone.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.llm.common import fold, materialise, release, table, tidy

END = b"\n"  # no word holds white space
SUFFIX = 3
DELTA = 0.1
SMALL = 32  # counts whose gains are tabulated


def words_of(text: str) -> list[bytes]:
    """ASCII lower case, split at \\x20 and \\x09-\\x0D."""
    return text.encode().lower().split()


def spelled(batches: Iterator[pa.RecordBatch], max_chars: int = 4_000_000
            ) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``max_chars`` bytes of text at most (a single longer row makes its own
    slice), with their distinct words, all tokens as numbers of these (the end, after each document, as the next
    number), and where each document starts and ends."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + max_chars, "right")))
            part = batch.slice(at, to - at)
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column("text"), "")))
            words, cuts = lists.flatten(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
            some = pc.greater(pc.binary_length(words), 0)  # white space at a text's ends leaves empty words
            cuts = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))][cuts]
            coded = words.filter(some).cast(pa.binary()).dictionary_encode()
            ends = cuts[1:] + np.arange(part.num_rows)
            tokens = np.full(cuts[-1] + part.num_rows, len(coded.dictionary), dtype=np.int64)
            inner = np.ones(len(tokens), dtype=bool)
            inner[ends] = False
            tokens[inner] = coded.indices.to_numpy()
            starts, distinct = cuts[:-1] + np.arange(part.num_rows), coded.dictionary
            del lists, words, some, coded, inner, cuts
            yield part, distinct, tokens, starts, ends
            at = to
    pa.default_memory_pool().release_unused()  # workers live on, beside the executor's heap


def word_counts(train: DataFrame) -> DataFrame:
    """word (binary), c: over all training texts, one end each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, tokens, _, _ in spelled(batches):
            words = pa.concat_arrays([words, pa.array([END], pa.binary())])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(tokens, minlength=len(words)))], names=["word", "n"])

    return train.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def heavy(df: DataFrame, col: str, limit: int) -> DataFrame:
    """The rows of largest ``col``: all above a level that at most ``limit`` rows pass."""
    bin_ = F.floor(8 * F.log2(F.col(col))).cast("int")
    level, n = None, 0
    for r in sorted(df.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        n += r["n"]
        if n > limit:
            break
        level = r["b"]
    return df.where(bin_ >= level) if level is not None else df.limit(0)


class Index:
    """Word -> index: a frequent word's own, else that of its ending's unit."""

    def __init__(self, words: list[bytes], endings: dict[bytes, int], other: int):
        self.words, self.endings = pa.array(words, pa.binary()), pa.array([*endings], pa.binary())
        self.at = np.array([*endings.values(), other], dtype=np.int64)

    def of(self, words: pa.Array) -> np.ndarray:
        ending = pc.fill_null(pc.index_in(pc.binary_slice(words, -SUFFIX), value_set=self.endings), -1)
        own = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where(own >= 0, own, self.at[ending.to_numpy(zero_copy_only=False)])


def indices(index: Index, words: pa.Array, end: int) -> np.ndarray:
    """The index of each distinct word, then that of the end."""
    return np.r_[index.of(words), end]


def before(tokens: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    prev = np.empty_like(tokens)
    prev[1:] = tokens[:-1]
    prev[starts] = end
    return prev


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def best_move(n: np.ndarray, own: int, out: np.ndarray, into: np.ndarray, self_n: float) -> tuple[int, float]:
    """The class whose likelihood gain for a unit is largest, and that gain over staying.

    n: class bigrams with the unit in class ``own``; out, into: the unit's bigrams
    to and from the classes without those with itself, ``self_n``."""
    m = n.astype(float).copy()
    m[own, :] -= out
    m[:, own] -= into
    m[own, own] -= self_n
    left, right = m.sum(1) + into, m.sum(0) + out  # whatever the unit's class, the others keep their bigrams with it
    d = np.arange(len(m))
    rows = xlogx(m + out[None, :]) - xlogx(m)  # the unit's bigrams added to row b
    cols = xlogx(m + into[:, None]) - xlogx(m)  # and to column b
    corner = xlogx(m[d, d] + out + into + self_n) - xlogx(m[d, d])
    gain = rows.sum(1) - rows[d, d] + cols.sum(0) - cols[d, d] + corner
    gain -= xlogx(left + out.sum() + self_n) - xlogx(left)
    gain -= xlogx(right + into.sum() + self_n) - xlogx(right)
    best = int(np.argmax(gain[1:])) + 1  # class 0 is the end's
    least = max(1e-9, 1e-12 * float(n.sum()))  # below that a gain is rounding
    return (best, float(gain[best] - gain[own])) if gain[best] > gain[own] + least else (own, 0.0)


def best_moves(n: np.ndarray, own: np.ndarray, word: np.ndarray, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_move`` for many words, each against the same class bigrams.

    own: the words' classes; (word, at, c): their counts, at = next class,
    k + previous class, or 2k for bigrams of the word with itself."""
    k, w = len(n), len(own)
    dense = np.bincount(word * (2 * k + 1) + at, weights=c, minlength=w * (2 * k + 1)).reshape(w, 2 * k + 1)
    self_n, all_w = dense[:, 2 * k], np.arange(w)
    gain = np.zeros((w, k))
    small = np.arange(SMALL + 1)
    for side, other, table in ((dense[:, :k], dense[:, k:2 * k], n.T), (dense[:, k:2 * k], dense[:, :k], n)):
        table = np.ascontiguousarray(table, dtype=float)
        # by count and class on this side: what the bigrams add to each class; counts are mostly small
        steps = xlogx(table[None] + small[:, None, None]) - xlogx(table)[None]
        u, j = np.nonzero(side)  # table[j]: the bigrams of all classes with class j on this side
        for s in range(0, len(u), 16_000):
            us, js = u[s:s + 16_000], j[s:s + 16_000]
            d, e, at_own = side[us, js], np.arange(len(us)), own[us]
            f = steps[np.minimum(d, SMALL).astype(np.int64), js]
            big = d > SMALL
            f[big] = xlogx(table[js[big]] + d[big, None]) - xlogx(table[js[big]])
            m = table[js, at_own] - d  # in its own class, the word's bigrams come off first
            f[e, at_own] = xlogx(m + d) - xlogx(m)
            same = np.nonzero(js == at_own)[0]
            m = table[js[same]] - other[us[same]]
            m[np.arange(len(same)), at_own[same]] -= d[same] + self_n[us[same]]
            f[same] = xlogx(m + d[same, None]) - xlogx(m)
            f[e, js] = 0.0
            first = np.nonzero(np.r_[True, us[1:] != us[:-1]])[0]
            gain[us[first]] += np.add.reduceat(f, first, axis=0)
        total, sums = side.sum(1) + self_n, table.sum(0)
        steps = xlogx(sums[None] + small[:, None]) - xlogx(sums)[None]
        f = steps[np.minimum(total, SMALL).astype(np.int64)]
        big = total > SMALL
        f[big] = xlogx(sums[None] + total[big, None]) - xlogx(sums)[None]
        f[all_w, own] = xlogx(sums[own]) - xlogx(sums[own] - total)
        gain -= f
    both = dense[:, :k] + dense[:, k:2 * k] + self_n[:, None]
    u, j = np.nonzero(both)
    d = np.diag(n).astype(float)[j] - np.where(own[u] == j, both[u, j], 0.0)
    gain[u, j] += xlogx(d + both[u, j]) - xlogx(d)
    best = np.argmax(gain[:, 1:], 1) + 1
    up = gain[all_w, best] - gain[all_w, own]
    stay = up <= max(1e-9, 1e-12 * float(n.sum()))
    return np.where(stay, own, best), np.where(stay, 0.0, up)


def likelihood(n: np.ndarray) -> float:
    """The part of the log-likelihood that depends on the classes."""
    return float(xlogx(n).sum() - xlogx(n.sum(1)).sum() - xlogx(n.sum(0)).sum())


def class_bigrams(rows: DataFrame, cls: np.ndarray, k: int) -> np.ndarray:
    """Class bigram counts from unit rows (unit, outs, out_n), summed in Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for b in batches:
            for u, o, n in zip(*(b.column(c).to_pylist() for c in ("unit", "outs", "out_n"))):
                if o:
                    total += np.bincount(cls[u] * k + cls[np.array(o)], weights=n, minlength=k * k)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["at", "n"])

    out = np.zeros(k * k)
    for r in rows.select("unit", "outs", "out_n").mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(k, k)


def word_id(word: bytes, seed: int) -> int:
    """A signed 64-bit number of the word."""
    x = xxhash.xxh3_64_intdigest(word, seed)
    return x - (1 << 64) if x >> 63 else x


def numbered(vocab: DataFrame) -> tuple[DataFrame, int]:
    """(word, c, id) and the seed of the ids: the first seed that gives no two words of the vocabulary one id."""
    seed, fields = 0, ", ".join(f"{c} {t}" for c, t in vocab.dtypes)
    while True:
        def run(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = [word_id(w, seed) for w in b.column("word").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64())], names=[*b.schema.names, "id"])

        out = materialise(vocab.mapInArrow(run, f"{fields}, id long"), "brown-ids")
        if not out.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
            return out, seed
        release(out)
        seed += 1


#: A block's share of bigrams. word: ids; cls: their classes; k_: contexts with frequent words (how many by word,
#: at, n; at = next class, k + previous class, or 2k with itself); f_ and p_: the other such words that follow and
#: precede (how many by word, ids, n).
PARTS = ("word", "cls", "k_len", "k_at", "k_n", "f_len", "f_id", "f_n", "p_len", "p_id", "p_n")
PACKED = "block int, " + ", ".join(f"{c} binary" for c in PARTS)


#: A block's bigrams as summed, and with its neighbours' classes put in.
BLOCK = ("word", "cls", "k_len", "k_at", "k_n", "pair", "flag", "pair_n", "send_to", "send_len", "send")
CELLS = ("word", "cls", "len", "at", "n", "send_to", "send_len", "send", "bigrams")


def pack(a: np.ndarray) -> bytes:
    """Whole numbers in the smallest type that holds them."""
    for t in ("B", "H", "I"):
        if not len(a) or a.min() >= 0 and a.max() <= np.iinfo(t).max:
            return t.encode() + a.astype(t).tobytes()
    return b"q" + a.astype("q").tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=chr(b[0]), offset=1).astype(np.int64)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and their sums of n."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
    return key[first], np.add.reduceat(n[order], first)


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (ids.view(np.uint64) % np.uint64(blocks)).astype(np.int64)


def packed(blocks: int, ids: np.ndarray, cls: np.ndarray | None, known: tuple, pairs: tuple) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED, one per block. known: (word, at, n); pairs: (word, following word, n), words as places in ids."""
    home = block_of(ids, blocks)
    order = np.lexsort((ids, home))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    ids, home, w = ids[order], home[order], len(ids)
    lists = []
    for key, value, n in (known, pairs, (pairs[1], pairs[0], pairs[2])):
        by = np.argsort(place[key], kind="stable")
        length = np.bincount(place[key], minlength=w)
        lists.append((length, np.r_[0, np.cumsum(length)], value[by] if value is known[1] else ids[place[value[by]]], n[by]))
    first = np.nonzero(np.r_[True, home[1:] != home[:-1]])[0] if w else []
    rows = []
    for s, e in zip(first, [*first[1:], w]):
        row = [pack(ids[s:e]), pack(cls[order][s:e] if cls is not None else ids[:0])]
        for length, cuts, value, n in lists:
            row += [pack(length[s:e]), pack(value[cuts[s]:cuts[e]]), pack(n[cuts[s]:cuts[e]])]
        rows.append((int(home[s]), *row))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i + 1] for r in rows], pa.binary()) for i in range(len(PARTS)))],
                                     names=["block", *PARTS])


NONE = (np.zeros(0, np.int64),) * 3


def contexts(train: DataFrame, look, cls_of: np.ndarray, own: int, k: int, seed: int, blocks: int) -> DataFrame:
    """Bigrams of the words that are no units of their own, words as their ids (see ``numbered``), as rows of
    PACKED: each slice of texts gives one row to every block that holds words of its, for them to be summed there.
    A bigram of two such words goes to both words' blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, digest = Index(*look.value), xxhash.xxh3_64_intdigest  # see word_id
        for _, words, tokens, starts, _ in spelled(batches):
            at = indices(index, words, 0)
            rest, cls = at >= own, cls_of[at]
            ids = np.array([digest(w, seed) for w in words.filter(pa.array(rest[:-1])).to_pylist()], dtype=np.uint64).view(np.int64)
            place = np.cumsum(rest) - 1
            is_rest = rest[tokens]
            inner = np.ones(len(tokens), dtype=bool)
            inner[starts] = False
            b = np.nonzero(inner)[0]
            a = b - 1
            x, y = is_rest[a], is_rest[b]
            two, left, right = x & y, x & ~y, y & ~x
            begins = starts[is_rest[starts]]  # a document starts after an end
            p, q = place[tokens[a[two]]], place[tokens[b[two]]]
            same = p == q
            wide = 2 * k + 1
            known, m = np.unique(np.concatenate([
                place[tokens[begins]] * wide + k + cls_of[0],
                place[tokens[a[left]]] * wide + cls[tokens[b[left]]],
                place[tokens[b[right]]] * wide + k + cls[tokens[a[right]]],
                p[same] * wide + 2 * k]), return_counts=True)
            two, r = np.unique((p[~same] << 32) + q[~same], return_counts=True)
            yield from packed(blocks, ids, None, (known // wide, known % wide, m), (two >> 32, two & 0xFFFFFFFF, r))

    return train.select("text").mapInArrow(count, PACKED)


def packed_rows(near: DataFrame, blocks: int) -> DataFrame:
    """Rows (word, other, at, n), words as ids, as rows of PACKED.

    With a frequent word: at = next class, or k + previous class; with another
    such word: other, at = 0 (word before other); with itself: at = 2k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, at, n = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("word", "at", "n"))
            two = pc.is_valid(b.column("other")).to_numpy(zero_copy_only=False)
            other = pc.fill_null(b.column("other"), 0).to_numpy()[two]
            ids, place = np.unique(np.r_[word, other], return_inverse=True)
            w, o = place[:len(word)], place[len(word):]
            yield from packed(blocks, ids, None, (w[~two], at[~two], n[~two]), (w[two], o, n[two]))

    return near.mapInArrow(run, PACKED)


def refine(near: DataFrame, words: DataFrame, fixed: np.ndarray, k: int, rounds: int | None = None, blocks: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Classes (word, cls) of the words after their own exchange of at most ``rounds`` rounds, and the class
    bigrams.  A round's tables go when the next one's stand.

    near: see ``contexts`` (or rows, see ``packed_rows``, also with words that are no ids); words: (word, cls) to
    start from; fixed: the class bigrams of the other words with one another.  Words lie in ``blocks`` blocks by
    id.  A block sends each other one the classes of those of its words that have neighbours there, in order of
    their ids; the receiver knows the same order from its own bigrams."""
    spark, wide, spelling = words.sparkSession, 2 * k + 1, None
    if dict(words.dtypes)["word"] != "bigint":
        spelling, seed = numbered(words)
        number = F.udf(lambda w: None if w is None else word_id(bytes(w), seed), "long")
        near = near.select(number("word").alias("word"), number("other").alias("other"), "at", "n")
        words = spelling.select(F.col("id").alias("word"), "cls")
    if "block" not in near.columns:
        near = packed_rows(near, blocks)

    def first_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from packed(blocks, b.column("word").to_numpy(), b.column("cls").to_numpy().astype(np.int64), NONE, NONE)

    def build(rows: pa.Table) -> pa.Table:
        """The block's bigrams summed. Pairs are ordered by the other word's block and id, so that ``new`` alone
        tells the other word: where the next one's pairs start. send_: to which blocks how many of which words."""
        parts = {c: [unpack(x) for x in rows.column(c).to_pylist()] for c in PARTS}
        start = [i for i, c in enumerate(parts["cls"]) if len(c)]
        join = lambda xs: np.concatenate([*xs, np.zeros(0, np.int64)])
        ids, cls = join(parts["word"][i] for i in start), join(parts["cls"][i] for i in start)
        order = np.argsort(ids)
        ids, cls, w = ids[order], cls[order], len(ids)
        place = [np.searchsorted(ids, x) for x in parts["word"]]
        of = {s: join(np.repeat(p, n) if len(n) else p[:0] for p, n in zip(place, parts[f"{s}_len"])) for s in "kfp"}
        known, known_n = summed(of["k"] * wide + join(parts["k_at"]), join(parts["k_n"]))
        other, back = np.unique(np.r_[join(parts["f_id"]), join(parts["p_id"])], return_inverse=True)
        home = block_of(other, blocks)
        by = np.lexsort((other, home))
        rank = np.empty(len(other), dtype=np.int64)
        rank[by] = np.arange(len(other))
        side = np.r_[of["f"] * 2, of["p"] * 2 + 1]
        pair, pair_n = summed(rank[back] * (2 * w) + side, np.r_[join(parts["f_n"]), join(parts["p_n"])])
        rank, side = pair // max(1, 2 * w), pair % max(1, 2 * w)
        new = np.diff(rank, prepend=-1)
        to, to_at = np.unique(home[by][rank], return_inverse=True)
        send = np.unique(to_at * w + side // 2)
        starts = np.bincount(send // max(1, w), minlength=len(to))
        idx = send % max(1, w)
        return pa.table([[rows.column("block")[0].as_py()]] + [pa.array([pack(x)], pa.binary()) for x in (
            ids, cls, np.bincount(known // wide, minlength=w), known % wide, known_n, side // 2, (side % 2) + 2 * new, pair_n, to, starts,
            idx)], schema=pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in BLOCK)]))

    def mail(block: int, cls: np.ndarray, to: np.ndarray, length: np.ndarray, idx: np.ndarray, moves: tuple[int, int]) -> list[tuple]:
        cuts = np.r_[0, np.cumsum(length)]
        return [(block, -1, pack(cls), *moves), *((int(t), block, pack(cls[idx[s:e]]), 0, 0) for t, s, e in zip(to, cuts, cuts[1:]))]

    def letters(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["block", "sender", "cls", "wish", "moved"])

    def first_mail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield letters(mail(r["block"], *(unpack(r[c]) for c in ("cls", "send_to", "send_len", "send")), (0, 0)))

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        """The words' counts by class with the classes that came in, and the class bigrams of the block."""
        r = left.to_pylist()[0]
        got = {x["sender"]: unpack(x["cls"]) for x in right.to_pylist()}
        cls, w = got[-1], len(got[-1])
        near_cls = np.concatenate([*(got[t] for t in unpack(r["send_to"]).tolist()), np.zeros(0, np.int64)])
        flag, word, n = unpack(r["flag"]), unpack(r["pair"]), unpack(r["pair_n"])
        oc = near_cls[np.cumsum(flag >> 1) - 1]
        after = flag & 1 == 0
        known, at, known_n = np.repeat(np.arange(w), unpack(r["k_len"])), unpack(r["k_at"]), unpack(r["k_n"])
        c = cls[known]
        total = np.bincount(np.where(at < k, c * k + at, np.where(at < 2 * k, (at - k) * k + c, c * k + c)), weights=known_n, minlength=k * k)
        total += np.bincount(cls[word[after]] * k + oc[after], weights=n[after], minlength=k * k)  # a bigram of two of these words counts at its first
        dense = np.bincount(np.r_[known * wide + at, word * wide + np.where(after, oc, oc + k)], weights=np.r_[known_n, n], minlength=w * wide)
        cell = np.nonzero(dense)[0]
        out = [r["word"], pack(cls), pack(np.bincount(cell // wide, minlength=w)), pack(cell % wide), pack(dense[cell].astype(np.int64)),
               r["send_to"], r["send_len"], r["send"], pack(total.astype(np.int64))]
        return pa.table([[r["block"]], *([x] for x in out)], schema=pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in CELLS)]))

    def gathered(letters: DataFrame) -> DataFrame:
        rows = table_.groupBy("block").cogroup(letters.select("block", "sender", "cls").groupBy("block")).applyInArrow(
            gather, "block int, " + ", ".join(f"{c} binary" for c in CELLS))
        out = materialise(rows, "brown-contexts")
        del rows
        tidy(spark)
        return out

    def bigrams_of(rows: DataFrame) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * k, dtype=np.int64)
            for b in batches:
                for x in b.column("bigrams").to_pylist():
                    total += unpack(x)
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

        out = fixed.reshape(-1).copy()
        for r in rows.select("bigrams").mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] += r["n"]
        return out.reshape(k, k)

    def moved(rows: DataFrame, n: np.ndarray, turn: int, share: int) -> DataFrame:
        """The classes that the words want, sent out: by those that a hash chooses, one of ``share``."""
        key = xxhash.xxh64_intdigest(turn.to_bytes(4, "little"), 42)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    ids, cls, length, at, c = (unpack(r[x]) for x in ("word", "cls", "len", "at", "n"))
                    cuts, to = np.r_[0, np.cumsum(length)], cls.copy()
                    for s in range(0, len(cls), 4000):
                        e = min(len(cls), s + 4000)
                        p = slice(cuts[s], cuts[e])
                        to[s:e], _ = best_moves(n, cls[s:e], np.repeat(np.arange(e - s), length[s:e]), at[p], c[p])
                    wish = to != cls
                    chosen = wish
                    if share > 1:
                        hashes = np.array([xxhash.xxh64_intdigest(i.tobytes(), key) for i in ids], dtype=np.uint64).view(np.int64)
                        chosen = wish & (hashes % share == 0)
                    yield letters(mail(r["block"], np.where(chosen, to, cls), *(unpack(r[x]) for x in ("send_to", "send_len", "send")),
                                       (int(wish.sum()), int(chosen.sum()))))

        return materialise(rows.drop("bigrams").mapInArrow(move, "block int, sender int, cls binary, wish long, moved long"), "brown-mail")

    both = near.select("block", *PARTS).unionByName(words.select("word", F.col("cls").cast("long").alias("cls")).mapInArrow(first_classes, PACKED))
    table_ = materialise(both.groupBy("block").applyInArrow(build, "block int, " + ", ".join(f"{c} binary" for c in BLOCK)), "brown-near")
    del near, both
    tidy(spark)
    post = materialise(table_.select("block", "cls", "send_to", "send_len", "send").mapInArrow(first_mail, "block int, sender int, cls binary, wish long, moved long"), "brown-mail")
    at = gathered(post)
    release(post)
    n = bigrams_of(at)
    share = 1
    for turn in range(1, rounds + 1) if rounds is not None else count(1):
        post = moved(at, n, turn, share)
        moves = post.agg(F.sum("wish").alias("all"), F.sum("moved").alias("some")).first()
        if not moves["all"]:
            release(post)
            break
        if not moves["some"]:  # too small a part
            release(post)
            share = max(1, share // 2)
            continue
        rows = gathered(post)
        release(post)
        m = bigrams_of(rows)
        if likelihood(m) > likelihood(n):
            release(at)
            at, n, share = rows, m, 1
        else:
            release(rows)
            if moves["some"] == 1:
                break  # the gain of a single move is rounding
            share *= 2
        tidy(spark)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, c in zip(b.column("word").to_pylist(), b.column("cls").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(w)), pa.array(unpack(c).astype(np.int32))], names=["word", "cls"])

    out = materialise(at.select("word", "cls").mapInArrow(classes, "word long, cls int"), "brown-refined")
    release(at)
    release(table_)
    if spelling is not None:
        out = out.withColumnRenamed("word", "id").join(spelling.select("id", "word"), "id").select("word", "cls")
    return out, n


def exchange(bigrams: DataFrame, units: int, k: int, rounds: int | None, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the units and the class bigram counts.

    ``bigrams`` has one row (a, b, n) per pair of units that occurs, at most the
    square of ``units`` whatever the corpus.  The end stays alone in class 0;
    the other units move one after the other, in order of their number, until a
    round moves none (or for ``rounds`` rounds)."""
    both = (bigrams.groupBy(F.col("a").alias("unit")).agg(F.collect_list(F.struct("b", "n")).alias("o"))
            .join(bigrams.groupBy(F.col("b").alias("unit")).agg(F.collect_list(F.struct("a", "n")).alias("i")), "unit", "full")
            .select("unit", F.col("o.b").alias("outs"), F.col("o.n").alias("out_n"),
                    F.col("i.a").alias("ins"), F.col("i.n").alias("in_n")))
    rows = materialise(both, "brown-units")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = 1 + np.arange(units) % (k - 1)
        cls[end] = 0
        n, own = np.zeros((k, k)), {}
        for b in batches:
            cells = [b.column(c) for c in ("outs", "out_n", "ins", "in_n")]
            for r, u in enumerate(b.column("unit").to_pylist()):
                o, on, i, in_ = (np.array(c[r].values if c[r].is_valid else [], dtype=np.int64) for c in cells)
                n += np.bincount(cls[u] * k + cls[o], weights=on, minlength=k * k).reshape(k, k)
                if u != end:
                    own[u] = (o[o != u], on[o != u], i[i != u], in_[i != u], float(on[o == u].sum()))
        for _ in range(rounds) if rounds else count():
            moved = 0
            for u in sorted(own):
                o, on, i, in_, self_n = own[u]
                out = np.bincount(cls[o], weights=on, minlength=k)
                into = np.bincount(cls[i], weights=in_, minlength=k)
                to, gain = best_move(n, int(cls[u]), out, into, self_n)
                if gain > 0:
                    for c, sign in ((cls[u], -1), (to, 1)):
                        n[c, :] += sign * out
                        n[:, c] += sign * into
                        n[c, c] += sign * self_n
                    cls[u] = to
                    moved += 1
            if not moved:
                break
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(units)), pa.array(cls)], names=["unit", "cls"])

    cls = np.zeros(units, dtype=np.int64)
    for r in rows.repartition(1).mapInArrow(move, "unit long, cls long").collect():  # a task for a bounded table
        cls[r["unit"]] = r["cls"]
    return cls, class_bigrams(rows, cls, k)


def score_documents(docs: DataFrame, held_mod: int = 10, classes: int = 48, unit_words: int = 1000, endings: int = 500,
                    head_words: int = 65_536, rounds: int | None = None, word_rounds: int | None = 4, prior: float = 20.0,
                    block_tokens: int = 500_000) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``rounds`` and ``word_rounds`` bound the exchange of the units and of all other words (None: to rest);
    the other words' bigrams lie in blocks of about ``block_tokens`` of their occurrences."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (fold("doc_id", held_mod) == 0).alias("held_out"))
    train = docs.where(~F.col("held_out"))
    vocab = materialise(word_counts(train), "brown-vocab").where("c > 0")
    r = vocab.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = r["n"] or 0, r["v"]

    # units: the end, the most frequent words, the commonest endings, all the rest
    head = {bytes(x["word"]): x["c"] for x in heavy(vocab.where(F.col("word") != F.lit(END)), "c", head_words).collect()}
    order = [END, *sorted(head, key=lambda w: (-head[w], w))]
    own = min(len(order), unit_words + 1)
    in_units = spark.createDataFrame([(bytearray(w),) for w in order[:own]], "word binary")
    rest = vocab.join(F.broadcast(in_units), "word", "left_anti")  # at most unit_words rows
    by_end = rest.groupBy(F.expr(f"substring(word, -{SUFFIX}, {SUFFIX})").alias("e")).agg(F.sum("c").alias("t"))
    by_end = materialise(by_end, "brown-endings")
    ends = sorted(bytes(x["e"]) for x in heavy(by_end, "t", endings).collect())
    units = own + len(ends) + 1
    ending_unit = {e: own + i for i, e in enumerate(ends)}
    counts = [0 if w == END else head[w] for w in order]
    counts[0] = next((x["c"] for x in vocab.where(F.col("word") == F.lit(END)).collect()), 0)

    # one index space: frequent words first, then the endings' units
    first_end = len(order)
    unit_of = np.array([i if i < own else ending_unit.get(w[-SUFFIX:], units - 1) for i, w in enumerate(order)]
                       + list(range(own, units)), dtype=np.int64)
    look = spark.sparkContext.broadcast((order, {e: first_end + i for i, e in enumerate(ends)}, first_end + len(ends)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = Index(*look.value), np.zeros(units * units, dtype=np.int64)
        for _, words, tokens, starts, _ in spelled(batches):
            unit = unit_of[indices(index, words, 0)]
            seen += np.bincount(unit[before(tokens, starts, len(words))] * units + unit[tokens], minlength=units * units)
        at = np.nonzero(seen)[0]
        for k in range(0, max(1, len(at)), 100_000):
            a = at[k:k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((a // units).astype(np.int32)), pa.array((a % units).astype(np.int32)),
                                              pa.array(seen[a])], names=["a", "b", "n"])

    bigrams = train.select("text").mapInArrow(pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    bigrams = materialise(bigrams, "brown-bigrams")
    cls, _ = exchange(bigrams, units, classes, rounds, 0)
    cls_of = cls[unit_of]

    def unit_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (cls[b.column(c).to_numpy()] for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(x * classes + y), b.column("n")], names=["at", "n"])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*look.value)
        for b in batches:
            to = cls_of[index.of(b.column("word"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(to.astype(np.int32))], names=["word", "cls"])

    # the frequent words keep their classes, all others of the vocabulary move by their own bigrams
    fixed = np.zeros(classes * classes)
    between = bigrams.where((F.col("a") < own) & (F.col("b") < own)).mapInArrow(unit_classes, "at long, n long")
    for x in between.groupBy("at").agg(F.sum("n").alias("n")).collect():
        fixed[x["at"]] = x["n"]
    known_words, seed = numbered(rest)
    blocks = max(1, -(-(total - sum(counts[:own])) // block_tokens))
    begun = materialise(known_words.mapInArrow(start, "word long, cls int"), "brown-start")  # no two Python steps in a task
    near = contexts(train, look, cls_of, own, classes, seed, blocks)
    words, n = refine(near, begun, fixed.reshape(classes, classes), classes, word_rounds, blocks)
    words = materialise(words.withColumnRenamed("word", "id").join(known_words, "id").select("word", "cls", "c"), "brown-classes")
    tidy(spark)
    in_head = spark.createDataFrame([(bytearray(w),) for w in order], "word binary")  # at most head_words + 1 rows
    own_cls = {bytes(x["word"]): x["cls"] for x in words.join(F.broadcast(in_head), "word", "left_semi").select("word", "cls").collect()}
    cls_of[own:first_end] = [own_cls[w] for w in order[own:]]

    # smoothed log10 probabilities, by class and by index
    share = (n.sum(0) + 1) / (n.sum() + classes)
    trans = np.log10((n + prior * share) / (n.sum(1, keepdims=True) + prior))
    t, v = (np.bincount(cls[:own], weights=x, minlength=classes) for x in (np.array(counts[:own], dtype=float), np.array([counts[0] > 0] + [1.0] * (own - 1))))
    for x in words.groupBy("cls").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("v")).collect():
        t[x["cls"]] += x["t"]
        v[x["cls"]] += x["v"]
    spread = np.log10(np.maximum(t + DELTA * (v + 1), DELTA))
    log_c = np.array([*(np.log10(np.array(counts) + DELTA)), *(0.0 for _ in range(units - own))])
    known = np.array([c > 0 for c in counts] + [False] * (units - own))
    base_norm = float(np.log10(total + DELTA * (distinct + 1)))
    tables = spark.sparkContext.broadcast((trans, spread, cls_of, log_c, known))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, made = Index(*look.value), 0
        trans, spread, cls_of, log_c, known = tables.value
        for batch, words, tokens, starts, ends in spelled(batches):
            spell, tokens = tokens, indices(index, words, 0)[tokens]
            rare = tokens >= first_end
            cuts = np.r_[0, np.cumsum(rare)][np.r_[starts, len(tokens)]].astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(cuts), words.take(pa.array(spell[rare])))
            codes = cls_of[tokens].astype(np.int16 if len(trans) < 1 << 15 else np.int32)
            codes[rare] = -1 - codes[rare]  # an unseen word's class, to be replaced if training saw the word
            cuts = (np.r_[starts, len(tokens)] * codes.itemsize).astype(np.int32)
            codes = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(codes)])
            rid = (TaskContext.get().partitionId() << 40) + made + np.arange(len(starts))
            made += len(starts)
            add = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), batch.column("doc_id"), batch.column("held_out"), pa.array(ends - starts + 1),
                 pa.array(add(known[tokens].astype(np.int64))), pa.array(add(log_c[tokens])), codes, rest],
                names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "log_c", "codes", "rest"])

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trans, spread = tables.value[:2]
        keep = ["doc_id", "held_out", "n_tokens", "n_known", "log_c", "rest_log", "rest_known"]
        for b in batches:
            model = []
            for codes, found in zip(b.column("codes").to_pylist(), b.column("found")):
                c = np.frombuffer(codes, dtype=np.int16 if len(trans) < 1 << 15 else np.int32).astype(np.int64)
                rare = np.nonzero(c < 0)[0]
                c = np.where(c < 0, -1 - c, c)
                if found.is_valid and len(found.values):
                    c[rare[found.values.field("pos").to_numpy()]] = found.values.field("cls").to_numpy()
                model.append(float((trans[np.r_[0, c[:-1]], c] - spread[c]).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), pa.array(model, pa.float64())], names=[*keep, "model"])

    local = materialise(docs.mapInArrow(score, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, "
                                               "log_c double, codes binary, rest array<binary>"), "brown-local")
    few = words.join(F.broadcast(in_head), "word", "left_anti")
    found = (local.select("rid", F.posexplode("rest").alias("pos", "word")).join(few, "word", "left")
             .groupBy("rid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + DELTA)).alias("rest_log"), F.count("c").alias("rest_known"),
                                 F.collect_list(F.when(F.col("cls").isNotNull(), F.struct("pos", "cls"))).alias("found")))
    out = local.drop("rest").join(found, "rid", "left").mapInArrow(
        transitions, "doc_id long, held_out boolean, n_tokens long, n_known long, log_c double, rest_log double, rest_known long, model double")
    log_all = F.col("log_c") + F.coalesce("rest_log", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (log_all - F.col("n_tokens") * F.lit(base_norm)).alias("base_score"), (log_all + F.col("model")).alias("score"))


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
