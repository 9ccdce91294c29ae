import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from schemaweave.llm import runs

SF = "/root/testdata/sf0.001"


def brute(words, least=24, periods=3):
    """Every (start, length, smallest period) by the definition."""
    n, out = len(words), set()
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, periods * q):
                part = words[i:i + length]
                if not any(part[:length - x] == part[x:] for x in range(1, q)):
                    out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def ids(words):
    names = {}
    return np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)


def sample(rng):
    """Words with nested, adjacent and overlapping repetitions."""
    out = []
    while len(out) < rng.randrange(5, 300):
        unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, rng.choice([2, 6, 40])))]
        out += (unit * rng.randrange(1, 9))[:rng.randrange(1, 200)]
        if rng.random() < 0.3:
            out += out[-rng.randrange(1, 60):] * rng.randrange(1, 5)
    return out


def test_runs_are_those_of_the_definition():
    rng = random.Random(5)
    for _ in range(400):
        words = sample(rng)
        for least, periods in ((24, 3), (4, 3), (2, 3), (24, 4)):
            assert runs.runs_of(ids(words), least, periods) == brute(words, least, periods)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.lists(st.integers(1, 17), min_size=1, max_size=9))
def test_appending_in_pieces_changes_nothing(words, sizes):
    caught, at, i = runs.Catchers(6, 3), 0, 0
    while at < len(words):
        step = sizes[i % len(sizes)]
        caught.append(np.array(words[at:at + step], dtype=np.int64))
        at, i = at + step, i + 1
        assert caught.runs() == brute(words[:at], 6, 3)  # online: right after every piece


def test_long_words_of_one_kind():
    n = 200_000
    assert runs.runs_of(np.zeros(n, dtype=np.int64), piece=70_000) == [(0, n, 1)]
    unit = np.arange(30_011)
    assert runs.runs_of(np.tile(unit, 4)) == [(0, 4 * 30_011, 30_011)]


def test_a_collision_is_tried_again(monkeypatch):
    mixed = runs._mixed

    def poor(left, right, seed):
        return mixed(left, right, seed) % np.uint64(3) if seed == 0 else mixed(left, right, seed)

    monkeypatch.setattr(runs, "_mixed", poor)
    words = [random.Random(3).randrange(5) for _ in range(200)] + [1, 2, 3] * 20
    assert runs.runs_of(ids(words)) == brute(words)


def expected(doc_id, text, plant):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def key(row):
    return tuple((x is None, x) for x in row)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = [tuple(r) for r in runs.op13_periodic_runs(spark, SF).collect()]
    want = [expected(r.doc_id, r.text, True) for r in docs]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[1] for r in got) > 5  # planted stretches are among them


def test_odd_rows(spark):
    nbsp = "a b " * 30  # no-break spaces part no words
    texts = [None, "", "  \t\n", "x", nbsp, "la " * 5000, "\x0b".join(["a", "b"] * 20), "é ü " * 12, "a b c " * 7 + "d " * 30]
    rows = [(i, t, "n", i) for i, t in enumerate(texts)] + [(None, "z " * 40, None, 1), (3, "x", "n", 1), (3, "x", "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, start int").select("text", "doc_id", "start", "n_runs")
    got = [tuple(r) for r in runs.document_runs(df).collect()]
    want = [expected(r[0], r[1], False) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    planted = runs.document_runs(df, plant=True).collect()
    assert sorted(map(key, (tuple(r) for r in planted))) == sorted(key(expected(r[0], r[1], True)) for r in rows)
    assert runs.document_runs(df.limit(0), plant=True).collect() == []
