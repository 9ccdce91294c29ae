"""Segmented section scan and mergeable first values."""

import random

import numpy as np
from pyspark.sql import functions as F

from schemaweave.operators.catalog import column_profile, first_values
from schemaweave.operators.sections import extract_sections
from test_operators import _greedy

HEADERS = {"# A": "alpha", "# B": "beta", "# P": "pairs", "# N": "next"}
RULES = {"alpha": ("inline", r"^([A-Z]) - (.+)$"), "beta": ("inline", r"^(\d+): (.+)$"), "pairs": ("pair", r"[A-Z]{2}"), "next": ("next_not_code", r"[A-Z]{2}")}


def test_two_inline_sections_have_their_own_patterns(spark):
    items = ["# A", "X - first", "7: not here", "# B", "7: seven", "Y - not here", "# A", "Z - last"]
    df = spark.createDataFrame([(None, i, t) for i, t in enumerate(items)], "doc int, pos int, item string")
    assert {tuple(r) for r in extract_sections(df, HEADERS, RULES, "alpha").collect()} == {
        ("alpha", "X", "first"), ("beta", "7", "seven"), ("alpha", "Z", "last")}


def test_a_long_document_is_scanned_in_segments(spark):
    rng = random.Random(11)
    pool = [*HEADERS, "AB", "CD", "EF", "AB", "CD", "X - x", "7: y", "text one", "text two"]
    docs = [rng.choices(pool, k=rng.randrange(1, 30)) for _ in range(60)] + [rng.choices(pool, k=1500)]
    docs += [["# P"] + ["AB", "CD", "EF"] * 700 + ["end"], ["# N"] + ["AB"] * 1999 + ["end", "AB"], ["AB"] * 2001]  # runs over whole segments
    rows = [(d, i, t) for d, items in enumerate(docs) for i, t in enumerate(items)]
    df = spark.createDataFrame(rows, "doc int, pos int, item string")
    want = set()
    for items in docs:
        want |= _greedy(items, HEADERS, RULES, "pairs")
    assert {tuple(r) for r in extract_sections(df, HEADERS, RULES, "pairs").collect()} == want
    assert extract_sections(df.limit(0), HEADERS, RULES, "pairs").collect() == []


def test_first_values_merge():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size, n = int(rng.integers(0, 40)), int(rng.integers(1, 6))
        pos, values = rng.integers(0, 12, size), rng.choice(list("abcdefgh"), size).astype(object)
        first = {}
        for p, v in zip(pos.tolist(), values.tolist()):
            first[v] = min(p, first.get(v, p))
        want = sorted(first.items(), key=lambda x: (x[1], x[0]))[:n]
        state, cut = {}, sorted(rng.integers(0, size + 1, 2).tolist())
        for a, b in ((0, cut[0]), (cut[0], cut[1]), (cut[1], size)):
            state = first_values(state, pos[a:b], values[a:b], n)
        assert list(state.items()) == want


def test_profile_over_many_partitions_and_none(spark):
    rows = [(i if i % 7 else None, ["x ", " y", "", None, "z"][i % 5], f"v{i // 3}", i % 2 == 0, 1.5) for i in range(500)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "`a.b` int, t string, many string, flag boolean, d double, pos int").repartition(6)
    got = {r.column: (r.dtype, r.non_null_ratio, r.sample_values) for r in column_profile(df, "t", "pos", 3).collect()}
    assert got["t"] == ("string", 0.8, "x | y | z") and got["many"][2] == "v0 | v1 | v2" and got["a.b"][1:] == (round(428 / 500, 6), "1 | 2 | 3")
    assert got["flag"] == ("boolean", 1.0, "true | false") and got["d"][2] == "1.5"
    assert {(r.column, r.non_null_ratio, r.sample_values) for r in column_profile(df.limit(0), "t", "pos").collect()} == {(c, 0.0, "") for c in df.columns}
    plan = column_profile(df, "t", "pos", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one scan
