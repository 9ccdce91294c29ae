"""Property tests (hypothesis): Jaccard symmetry and range, TF-IDF self-cosine, name normalisation."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from schemaweave.functions.text import jaccard, tokenize, with_normalized
from schemaweave.operators.similarity import tfidf_cosine

WORDS = st.sampled_from(["case", "id", "date", "beat", "area", "x", "Case", "ID_no", "a_b", ""])
NAMES = st.lists(WORDS, min_size=0, max_size=4).map(lambda ws: "_".join(ws) if len(ws) % 2 else " ".join(ws))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(NAMES, NAMES), min_size=1, max_size=20))
def test_jaccard_symmetric_in_unit_interval(spark, pairs):
    df = spark.createDataFrame(pairs, "l string, r string")
    rows = df.select(jaccard(tokenize(F.col("l")), tokenize(F.col("r"))).alias("a"),
                     jaccard(tokenize(F.col("r")), tokenize(F.col("l"))).alias("b")).collect()
    for r in rows:
        assert r["a"] == r["b"] and 0.0 <= r["a"] <= 1.0


@settings(max_examples=10, deadline=None)
@given(st.lists(NAMES.filter(lambda s: any(len(t) > 1 for t in s.replace("_", " ").split())),
                min_size=1, max_size=12))
def test_tfidf_self_cosine_is_one(spark, texts):
    rows = [(f"a{i}", f"b{i}", t, t) for i, t in enumerate(texts)]
    pairs = spark.createDataFrame(rows, "left_city string, right_city string, l string, r string") \
        .withColumn("left_column_final", F.col("l")).withColumn("right_column_final", F.col("r"))
    for r in tfidf_cosine(pairs, "l", "r", "c").collect():
        assert r["c"] == pytest.approx(1.0, abs=1e-12)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=" _-#AbZz09.\t", max_size=12), min_size=1, max_size=15))
def test_normalisation_idempotent_and_clean(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "s string")
    once = with_normalized(df, "s").select("normalized_column_name")
    twice = with_normalized(once, "normalized_column_name", "n2", "t2").collect()
    for r in twice:
        n = r["normalized_column_name"]
        assert r["n2"] == n and r["t2"] == "no_change"
        assert not n.startswith("_") and not n.endswith("_") and "__" not in n
        assert all(c.isdigit() or ("a" <= c <= "z") or c == "_" for c in n)
