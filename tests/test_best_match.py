"""Best-match joins against brute force."""

import random

import duckdb
import numpy as np
import pytest

from schemaweave.operators import best_match as B


def names(rng, n):
    parts = ["date", "time", "case", "number", "id", "lat", "location", "block", "description", "type", "code", "year", "arrest", "x"]
    out = []
    for _ in range(n):
        s = "_".join(rng.choices(parts, k=rng.randrange(1, 4)))
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(0, len(s) + 1)
            s = s[:i] + rng.choice(["", "q", "e", "7"]) + s[i + rng.randrange(0, 2):]
        out.append(rng.choice([s, s.upper(), s.title()]))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_edit_ratio_join_equals_brute_force_at_5000_targets(spark, threshold):
    rng = random.Random(int(threshold * 10))
    targets = [(t, i) for i, t in enumerate(names(rng, 5000) + ["", "a", None, "DATE"])]
    sources = [(i, t, 7) for i, t in enumerate(names(rng, 120) + ["", "a", "zz", None, "Date", "date", "x" * 60, "Date"])]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (target VARCHAR, pos INT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [x for x in targets if x[0] is not None])
    con.execute("CREATE TABLE s (k INT, name VARCHAR)")
    con.executemany("INSERT INTO s VALUES (?, ?)", [x[:2] for x in sources if x[1] is not None])
    want = con.execute(f"""SELECT k, target, sc FROM (SELECT k, target, pos, CASE WHEN greatest(length(name), length(target)) = 0 THEN 1.0::DOUBLE ELSE
        1.0::DOUBLE - levenshtein(lower(name), lower(target)) / greatest(length(name), length(target)) END AS sc FROM s, t)
        WHERE sc >= {threshold}::DOUBLE AND sc > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY sc DESC, pos) = 1""").fetchall()
    src = spark.createDataFrame(sources, "k int, name string, pos int")
    got = B.fuzzy_best_match_join(src, "name", spark.createDataFrame(targets, "target string, pos int"), threshold)
    assert got.columns == ["k", "name", "pos", "best_target", "best_score"]
    got = sorted((r.k, r.best_target, round(r.best_score, 9)) for r in got.collect())
    assert got == sorted((k, t, round(s, 9)) for k, t, s in want)


def test_edit_ratio_join_of_empty_sides(spark):
    src, tgt = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([], "target string, pos int")
    assert B.fuzzy_best_match_join(src, "name", tgt, 0.5).collect() == []
    assert B.fuzzy_best_match_join(src.limit(0), "name", spark.createDataFrame([("a", 0)], "target string, pos int"), 0.5).collect() == []


def test_a_shared_gram_is_certain_where_the_filter_says_so():
    for q, ratio in ((2, 0.65), (2, 0.85), (1, 0.3)):
        least = B.shortest_filtered(q, ratio)
        assert B.grams_needed(least, q, ratio) >= 1 and (least == 1 or B.grams_needed(least - 1, q, ratio) < 1)


def test_token_join_equals_brute_force(spark):
    rng = random.Random(3)
    targets = [(t, i) for i, t in enumerate(names(rng, 400) + ["", None])]
    sources = names(rng, 60) + ["", None, "date date_TIME"]
    tok = lambda s: {x for x in s.lower().replace("_", " ").split()}
    want = []
    for s in sources:
        best = [(len(tok(s) & tok(t)) / len(tok(s) | tok(t)), -i, t) for t, i in targets if s and t and tok(s) & tok(t)]
        if best and max(best)[0] >= 0.4:
            want.append((s, max(best)[2], max(best)[0]))
    got = B.token_best_match_join(spark.createDataFrame([(s,) for s in sources], "s string"), "s", spark.createDataFrame(targets, "target string, pos int"), 0.4)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def vectors(n_sources, n_targets, width=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, width))
    of = lambda n: centres[rng.integers(0, 30, n)] + 0.2 * rng.normal(size=(n, width))
    s, t = of(n_sources), of(n_targets)
    t[n_targets // 2] = 2 * s[0]  # ties of equal direction, in different blocks
    t[n_targets // 3] = 4 * s[0]
    t[n_targets - 1] = 8 * s[0]
    return s, t


@pytest.mark.parametrize("n,block", [(10_000, 256), (700, 1024)])
def test_vector_join_equals_brute_force(spark, n, block):
    s, t = vectors(150, n)
    unit = lambda m: m / np.sqrt((m * m).sum(1))[:, None]
    a, b = unit(s), unit(t)
    want = {}
    for i, x in enumerate(a):
        score = (x[None, :] * b).sum(1)
        best = score.max()
        if best > 0.97:
            want[i] = (f"t{int(np.nonzero(score >= best - 1e-12)[0][0])}", round(float(best), 9))
    odd = [None, [], [0.0] * 12, [1.0] * 11, [1.0] * 11 + [None], [float("nan")] * 12, [float("inf")] * 12]
    src = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(s)] + [(1000 + i, v) for i, v in enumerate(odd)], "k long, v array<double>")
    tgt = spark.createDataFrame([(f"t{i}", i, x.tolist()) for i, x in enumerate(t)] + [(f"o{i}", 20_000 + i, v) for i, v in enumerate(odd)],
                                "target string, pos int, vec array<double>")
    got = B.vector_best_match_join(src, "k", "v", tgt, 0.97, block=block)
    assert {r.k: (r.best_target, round(r.best_score, 9)) for r in got.collect()} == want and 10 < len(want) < 150


def test_vector_join_without_targets(spark):
    src = spark.createDataFrame([(1, [1.0, 0.0])], "k long, v array<double>")
    for rows in ([], [("a", 0, None), ("b", 1, [0.0, 0.0])]):
        tgt = spark.createDataFrame(rows, "target string, pos int, vec array<double>")
        assert B.vector_best_match_join(src, "k", "v", tgt, 0.1).collect() == []
