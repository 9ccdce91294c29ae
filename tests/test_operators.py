"""Operators against brute-force Python references on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from schemaweave.constants import PAIR_KEY, SECTION_HEADERS, SECTION_RULES
from schemaweave.operators.catalog import column_profile, metadata_descriptions, profile, validate, METADATA_SCHEMA
from schemaweave.operators.evaluate import (match_quality, metrics_table, precision_at_k, threshold_sweep,
                                            top_false_positives)
from schemaweave.operators.keyed import attach_group_count, dense_codes, first_per_key
from schemaweave.operators.modeling import class_report, roc_auc, stratified_split
from schemaweave.operators.pairs import all_pairs_count, attach_context, candidate_pairs
from schemaweave.operators.sections import extract_sections
from schemaweave.operators.similarity import fuzzy_best_match, tfidf_cosine, vector_best_match


# --- W1 / A4 ---------------------------------------------------------------------------------
def test_first_per_key_null_modes(spark):
    rows = [(1, "a", 3), (1, "a", 1), (None, "b", 5), (None, "b", 2), (2, None, 7)]
    df = spark.createDataFrame(rows, "k1 int, k2 string, o int")
    keep = sorted(first_per_key(df, ["k1", "k2"], ["o"], "keep").collect(), key=str)
    equal = sorted(first_per_key(df, ["k1", "k2"], ["o"], "equal").collect(), key=str)
    assert [tuple(r) for r in keep] == sorted([(1, "a", 1), (None, "b", 5), (None, "b", 2), (2, None, 7)], key=str)
    assert [tuple(r) for r in equal] == sorted([(1, "a", 1), (None, "b", 2), (2, None, 7)], key=str)


def test_first_per_key_idempotent(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, o int")
    once = first_per_key(df, ["k"], ["o"])
    assert sorted(map(tuple, first_per_key(once, ["k"], ["o"]).collect())) == sorted(map(tuple, once.collect()))


def test_group_count_null_key(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "v string")
    got = sorted(((r["v"], r["n"]) for r in attach_group_count(df, ["v"], "n").collect()), key=str)
    assert got == sorted([("x", 2), ("x", 2), (None, None), ("y", 1)], key=str)


def test_dense_codes(spark):
    vals = ["b", "a", "10", "2", "b", None, "c"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    codes = {r["v"]: r["c"] for r in dense_codes(df, "v", "c").collect()}
    assert codes == {"10": 0, "2": 1, "a": 2, "b": 3, "c": 4}
    nums = spark.createDataFrame([(float("nan"),), (3.0,), (1.0,), (float("nan"),), (2.0,)], "v double")
    got = {str(r["v"]): r["c"] for r in dense_codes(nums, "v", "c").collect()}
    assert got == {"1.0": 0, "2.0": 1, "3.0": 2, "nan": 3}


# --- A1, A2, A3, S5 ---------------------------------------------------------------------------
def test_profile_and_validate(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, "y"), (4, None)], "a int, b string")
    p = {r["column"]: r for r in profile(df).collect()}
    assert p["a"]["null_pct"] == 25.0 and p["b"]["null_pct"] == 50.0 and p["a"]["n_rows"] == 4
    v = validate(df, "t", ["a", "c"]).first()
    assert v["missing_cols"] == "c" and v["extra_cols"] == "b" and v["null_percentage"] == 37.5
    assert v["is_valid"] is False


def test_column_profile_first_values(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", " a ", "b", "", None, "c", "d"])],
                               "pos int, v string")
    r = {x["column"]: x for x in column_profile(df, "t", "pos", max_values=3).collect()}
    assert r["v"]["sample_values"] == "b | a | c"
    assert r["v"]["non_null_ratio"] == round(6 / 7, 6)


def test_metadata_two_shapes_last_wins(spark):
    docs = ['{"columns": [{"fieldName": "Case Number", "description": " first "}]}',
            '{"meta": {"view": {"columns": [{"name": "case_number", "desc": "second"},'
            ' {"columnName": "Beat", "description": "   "}]}}}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, j string")
    parsed = df.select("i", F.from_json("j", METADATA_SCHEMA).alias("doc"))
    got = {r["key"]: r["description"] for r in metadata_descriptions(parsed, "doc", "i").collect()}
    assert got == {"casenumber": "second"}


# --- J1, J3 -------------------------------------------------------------------------------------
def _catalog(spark, entries):
    rows = [(c, c, n, n, d, i) for i, (c, n, d) in enumerate(entries)]
    return spark.createDataFrame(rows, "city string, ds_order string, column_original string, column_final string, "
                                       "description string, pos int")


def test_candidate_pairs_match_bruteforce(spark):
    rnd = random.Random(7)
    words = ["id", "case", "date", "beat", "area", "code", "x"]
    entries = [(f"d{rnd.randint(0, 3)}", "_".join(rnd.sample(words, rnd.randint(1, 3))), "") for _ in range(40)]
    cat = _catalog(spark, entries)
    got = Counter((r.left_city, r.left_column_final, r.right_city, r.right_column_final)
                  for r in candidate_pairs(cat).collect())
    want = Counter()
    for a in entries:
        for b in entries:
            if a[0] < b[0]:
                want[(a[0], a[1], b[0], b[1])] += 1
    assert got == want


def test_all_pairs_count_golden(spark):
    entries = [("chicago", f"c{i}", "") for i in range(23)] + [("sf", f"s{i}", "") for i in range(35)] + \
              [("la", f"l{i}", "") for i in range(26)]
    assert all_pairs_count(_catalog(spark, entries)).first()[0] == 2313
    assert candidate_pairs(_catalog(spark, entries)).count() == 2313


def test_attach_context_last_wins(spark):
    cat = _catalog(spark, [("a", "case_id", "first"), ("a", "case_id", "second"), ("b", "case_no", "")])
    pairs = candidate_pairs(cat).dropDuplicates()
    r = attach_context(pairs, cat).first()
    assert r["left_header_with_context"] == "case_id | second"
    assert r["right_header_with_context"] == "case_no"


# --- Q2/Q3: TF-IDF against a plain-Python implementation -----------------------------------------
def _py_tfidf_cos(lefts, rights, max_features=100):
    def terms(t):
        toks = re.findall(r"[^\W]{2,}", t.lower())
        return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
    docs = lefts + rights
    tfs = [Counter(terms(d)) for d in docs]
    freq, df = Counter(), Counter()
    for c in tfs:
        freq.update(c)
        df.update(set(c))
    vocab = sorted(freq, key=lambda t: (-freq[t], t))[:max_features]
    n = len(docs)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}

    def vec(c):
        v = {t: c[t] * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}
    out = []
    for i in range(len(lefts)):
        a, b = vec(tfs[i]), vec(tfs[len(lefts) + i])
        out.append(sum(a[t] * b.get(t, 0.0) for t in a))
    return out


def test_tfidf_cosine_matches_python(spark):
    lefts = ["case_number | the case id", "beat", "date of arrest", "area name | area", "x"]
    rights = ["case number", "police beat area", "arrest date | date", "area | name", "y"]
    rows = [(f"a{i}", f"b{i}", lefts[i], rights[i]) for i in range(len(lefts))]
    pairs = spark.createDataFrame(rows, "left_city string, right_city string, l string, r string") \
        .withColumn("left_column_final", F.col("l")).withColumn("right_column_final", F.col("r"))
    got = {r["left_city"]: r["c"] for r in tfidf_cosine(pairs, "l", "r", "c", max_features=6).collect()}
    want = _py_tfidf_cos(lefts, rights, max_features=6)
    for i, w in enumerate(want):
        assert got[f"a{i}"] == pytest.approx(w, abs=1e-12)


# --- A7, A8, A9, W5, W6, A13 ---------------------------------------------------------------------
def _labelled(spark, n=60, seed=3):
    rnd = random.Random(seed)
    rows = [("c1", "c2", f"l{i}", f"r{i}", round(rnd.random(), 3), round(rnd.random(), 3), round(rnd.random(), 3),
             rnd.randint(0, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "left_city string, right_city string, left_column_final string, "
                                       "right_column_final string, lexical_jaccard double, "
                                       "embedding_header_only_cosine double, embedding_header_context_cosine double, "
                                       "is_match int")


def test_sweep_properties(spark):
    lab = _labelled(spark)
    sweep = threshold_sweep(lab).collect()
    assert len(sweep) == 27
    positives = sum(r["is_match"] for r in lab.collect())
    by_method = {}
    for r in sweep:
        assert r["tp"] + r["fn"] == positives
        by_method.setdefault(r["method"], []).append((r["threshold"], r["recall"]))
    for series in by_method.values():
        recalls = [x for _, x in sorted(series)]
        assert all(a >= b for a, b in zip(recalls, recalls[1:]))


def test_metrics_zero_denominators(spark):
    lab = _labelled(spark).withColumn("is_match", F.lit(0))
    for r in metrics_table(lab).collect():
        assert (r["precision"], r["recall"], r["f1"], r["tp"], r["fn"]) == (0.0, 0.0, 0.0, 0, 0)


def test_precision_at_k_bruteforce(spark):
    lab = _labelled(spark)
    rows = lab.collect()
    got = {(r["method"], r["k"]): r["precision_at_k"] for r in precision_at_k(lab, ks=(5, 10, 100)).collect()}
    top = sorted(rows, key=lambda r: (-r["lexical_jaccard"], *[r[k] for k in PAIR_KEY]))
    for k in (5, 10, 100):
        want = sum(r["is_match"] for r in top[:k]) / min(k, len(rows))
        assert got[("Lexical (Jaccard)", k)] == pytest.approx(want)


def test_top_false_positives(spark):
    lab = _labelled(spark)
    got = [r["left_column_final"] for r in top_false_positives(lab, n=5).collect()]
    neg = sorted([r for r in lab.collect() if r["is_match"] == 0],
                 key=lambda r: (-r["embedding_header_context_cosine"], r["left_column_final"]))
    assert got == [r["left_column_final"] for r in neg[:5]]


def test_match_quality(spark):
    true_map = spark.createDataFrame([("d", "A", "a"), ("d", "B", "b"), ("d", "C", "c")],
                                     "dataset string, source string, target string")
    pred = spark.createDataFrame([("d", "A", "a"), ("d", "B", "x")], "dataset string, source string, target string")
    r = match_quality(true_map, pred).first()
    assert (r["accuracy"], r["precision"], r["recall"]) == (pytest.approx(1 / 3), 1.0, pytest.approx(1 / 3))


# --- A11, A12, W10 ------------------------------------------------------------------------------------
def test_roc_auc_bruteforce(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 8))) for _ in range(80)]
    got = roc_auc(spark.createDataFrame(rows, "label int, score double")).first()["auc"]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(want)


def test_class_report(spark):
    rows = [(1, 1), (1, 0), (0, 0), (0, 0), (0, 1), (1, 1)]
    rep = {r["class"]: r for r in class_report(spark.createDataFrame(rows, "label int, prediction int")).collect()}
    assert rep["1"]["precision"] == pytest.approx(2 / 3) and rep["1"]["recall"] == pytest.approx(2 / 3)
    assert rep["accuracy"]["f1"] == pytest.approx(4 / 6) and rep["macro avg"]["support"] == 6


def test_stratified_split_exact(spark):
    rows = [(i, "A" if i % 3 else "B") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, y string")
    got = {r["k"] for r in stratified_split(df, "y", "k", 0.2, 42).where("is_test").collect()}
    want = set()
    for label in ("A", "B"):
        ks = sorted((hashlib.md5(f"{k}42".encode()).hexdigest(), k) for k, y in rows if y == label)
        want |= {k for _, k in ks[:round(0.2 * len(ks))]}
    assert got == want


# --- Q4, Q5 --------------------------------------------------------------------------------------------
def test_best_matches(spark):
    src = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    got = {r["id"]: r["best_target"] for r in vector_best_match(src, "v", [("x", [1.0, 0.0]), ("y", [0.0, 1.0])],
                                                               threshold=0.7).collect()}
    assert got == {1: "x", 2: "y", 3: "x"}
    names = spark.createDataFrame([("Case Number",), ("Beat",), ("zzz",)], "s string")
    best = fuzzy_best_match(names, "s", ["case_number", "beat"], 0.6)
    assert {r["s"]: r["best_target"] for r in best.collect()} == {"Case Number": "case_number", "Beat": "beat"}
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") == 1


# --- W9: windows vs the sequential cursor --------------------------------------------------------------
def _greedy(items, headers, rules, default):
    out, section, i = set(), default, 0
    while i < len(items):
        t = items[i]
        if t in headers:
            section, i = headers[t], i + 1
            continue
        mode, pat = rules[section]
        nxt = items[i + 1] if i + 1 < len(items) else None
        if mode == "next_not_code" and re.fullmatch(pat, t) and nxt is not None \
                and not re.fullmatch(pat, nxt) and nxt not in headers:
            out.add((section, t, nxt))
            i += 2
            continue
        if mode == "pair" and re.fullmatch(pat, t) and nxt is not None and nxt not in headers:
            out.add((section, t, nxt))
            i += 2
            continue
        if mode == "inline":
            m = re.match(pat, t)
            if m:
                out.add((section, m.group(1), m.group(2)))
        i += 1
    return out


def test_sections_golden(spark):
    items = ["RADIO CODES", "10-25", "RESPOND AS BACKUP", "Dispositions:", "ADV", "ADVISED", "CIT", "CITED",
             "Suffixes and Radio Code Modifiers:", "B - Bomb", "Priorities", "A", "Emergency"]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(items)], "doc int, pos int, item string")
    got = {tuple(r) for r in extract_sections(df).collect()}
    assert ("radio_codes", "10-25", "RESPOND AS BACKUP") in got
    assert got == _greedy(items, SECTION_HEADERS, SECTION_RULES, "radio_codes")


def test_sections_random_vs_greedy(spark):
    rnd = random.Random(5)
    pool = ["10-1", "10-22B", "415", "CODE 3", "ADV", "CIT", "Q", "Z", "B - Bomb", "RED - alert", "some text",
            "Another description", "RADIO CODES", "Dispositions:", "Priorities", "Suffixes and Radio Code Modifiers:",
            "RADIO CODES-S.F. Sheriff Dept."]
    docs = [[rnd.choice(pool) for _ in range(rnd.randint(1, 25))] for _ in range(40)]
    rows = [(d, i, t) for d, items in enumerate(docs) for i, t in enumerate(items)]
    got = {tuple(r) for r in extract_sections(spark.createDataFrame(rows, "doc int, pos int, item string")).collect()}
    want = set()
    for items in docs:
        want |= _greedy(items, SECTION_HEADERS, SECTION_RULES, "radio_codes")
    assert got == want
