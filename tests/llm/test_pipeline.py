from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from schemaweave.llm import mixing, order_minhash, quality, toxicity
from schemaweave.llm.common import materialise
from test_packing_mixing import check

SF = "/root/testdata/sf0.01"
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("start", docs)]
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-stage")
        out.append((name, docs))
    return dict(out)


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_every_stage_but_the_last_keeps_the_columns(stages):
    for name in ("toxicity", "quality", "near_dedup", "mixing"):
        assert stages[name].columns == COLS


def test_filters_keep_exactly_what_the_models_accept(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = stages["start"]
    want = ids(toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0"))
    assert ids(stages["toxicity"]) == want
    docs = stages["toxicity"]
    want = ids(quality.score(docs, quality.fit_labels(docs, labels, "quality")).where("predicted = 1"))
    assert ids(stages["quality"]) == want
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    kept = ids(stages["quality"])
    clean = [i for i, (q, t) in known.items() if q == 1 and t == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i in kept for i, (q, t) in known.items() if q == 0) <= 0.05 * len(known)


def test_one_document_of_each_class_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["quality"].collect()]
    h = order_minhash.WordHash()
    s = {i: order_minhash.shingles(t, h) for i, t in rows}
    held = {}
    for i, x in s.items():
        for k in x.tolist():
            held.setdefault(k, []).append(i)
    near = {(a, b) for l in held.values() for n, a in enumerate(l) for b in l[n + 1:] if order_minhash.aligned(s[a], s[b])}
    text = dict(rows)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_text = {}
    for i in sorted(text):
        near.add((by_text.setdefault(text[i], i), i))
    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert ids(stages["near_dedup"]) == Counter({find(i): 1 for i in root})


def test_mixing_takes_and_repeats(stages):
    plan = {r.doc_id: r for r in mixing.curriculum_mix(stages["near_dedup"]).collect()}
    want = Counter({i: (2 * r.first_taken >= r.size) + (2 * (r.taken - r.first_taken) >= r.size) if r.size else 1 for i, r in plan.items()})
    assert ids(stages["mixing"]) == +want


def test_packing_places_every_copy(stages):
    rows = [(r.doc_id, r.text) for r in stages["mixing"].collect()]
    pieces = stages["packing"].collect()
    n = check(rows, pieces, 2048)
    assert n <= -(-sum(p.length for p in pieces) // 2048) * 1.02 + 1


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
    empty = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1, None, None, None, 0, 1.0, "x"), (1, "a b c", "en", "s", 5, 1.0, "x"), (None, "a b c", "en", "s", 5, 1.0, "x"),
                                  (2, "", "en", "s", 0, 1.0, "x"), (3, "w " * 9000, "en", "s", 18000, 1.0, "x")], schema)
    for docs in (empty, some):
        n = docs.count()
        for name, stage in P.STAGES:
            docs = materialise(stage(spark, docs, "/root/testdata/sf0.001"), "test-odd")
            if name != "packing":
                assert docs.columns == empty.columns
            if not n:
                assert docs.count() == 0


def test_rows_that_share_an_id_keep_their_texts(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 3
    rows = [(1, "text a of one", "en"), (1, "quite another text b", "en"), (0, "zero", "en"), (5, None, "en"), (5, long, "en"), (None, "no id", "x"),
            (None, "other words, no id", "x"), (None, "no id", "y"), (7, "zero", "en"), (8, long + "tail", "en"), (9, "solo", "b"), (9, "solo", "a"), (-4, "minus", "en"),
            (None, None, "en")]
    docs = spark.createDataFrame([(i, t, l, "s", 1) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text, r.lang) for r in P.near_dedup(spark, docs, SF).collect()]
    want = {"text a of one", "quite another text b", "zero", None, "no id", "other words, no id", "solo", "minus"}
    texts = [t for _, t, _ in out]
    assert set(texts) - {long, long + "tail"} == want and set(out) <= set(rows)
    assert texts.count(None) == 2 and sum(t in (long, long + "tail") for t in texts) == 1 and len(texts) == len(want) + 2
    assert (0, "zero", "en") in out and (9, "solo", "a") in out


def test_run_applies_all_stages(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert P.ORACLE_SQL is None and out.columns[0] == "doc_id" and out.count() > 50
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_without_labels_keep_all(spark, tmp_dir):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "", "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    tables = {"none": [], "null": [(1, None, None)], "other": [(99, 1, 0), (98, 0, 1)], "toxic": [(99, 0, 1)]}
    for name, rows in tables.items():
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/{name}/labels.parquet")
        for stage in (P.drop_toxic, P.keep_quality):
            out = stage(spark, docs, f"{tmp_dir}/{name}")
            assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
