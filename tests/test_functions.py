"""Column functions: golden literals (typed from the published sample tables) and rules."""

import datetime as dt

from pyspark.sql import functions as F

from schemaweave.functions import (classify_column, clean_text, date_plus_hhmm, expand_abbreviations, is_ambiguous,
                                   jaccard, normalize_name, parse_bool, parse_timestamp, round_half_even,
                                   temporal_columns, tfidf_terms, to_float, to_int, tokenize, with_expanded,
                                   with_normalized)


def one(spark, value, expr_fn, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr_fn(F.col(schema.split()[0])).alias("o")).first()[0]


def test_normalize_golden(spark):
    cases = [
        ("DR Number", "dr_number", "lowercase | replace_special_chars"),
        ("Location ", "location", "trim_whitespace | lowercase"),
        ("PdId", "pdid", "lowercase"),
        ("Fix It Zones as of 2017-11-06  2 2", "fix_it_zones_as_of_2017_11_06_2_2",
         "lowercase | replace_special_chars"),
        ("beat", "beat", "no_change"),
        ("_x_", "x", "strip_edge_underscores"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "s string")
    col_form = df.select(*[c.alias(n) for c, n in zip(normalize_name(F.col("s")), ["n", "t"])]).collect()
    step_form = with_normalized(df, "s").collect()
    for (src, name, steps), a, b in zip(cases, col_form, step_form):
        assert (a["n"], a["t"]) == (name, steps), src
        assert (b["normalized_column_name"], b["normalization_steps"]) == (name, steps), src


def test_normalize_idempotent(spark):
    df = spark.createDataFrame([("A b--C",), ("  x  ",), ("Crime Code 1",)], "s string")
    once = with_normalized(df, "s").select("normalized_column_name")
    twice = with_normalized(once, "normalized_column_name", "n2", "t2")
    for r in twice.collect():
        assert r["n2"] == r["normalized_column_name"] and r["t2"] == "no_change"


def test_expand_golden(spark):
    cases = [("fbi_code", "federal_bureau_of_investigation_code_code", "fbi"),
             ("beat", "police_beat_area", "beat"),
             ("pdid", "police_department_incident_id", "pdid"),
             ("district", "district", "no_change")]
    df = spark.createDataFrame([(c[0],) for c in cases], "s string")
    a = df.select(*[c.alias(n) for c, n in zip(expand_abbreviations(F.col("s")), ["e", "r"])]).collect()
    b = with_expanded(df, "s").collect()
    for (src, exp, rules), x, y in zip(cases, a, b):
        assert (x["e"], x["r"]) == (exp, rules)
        assert (y["expanded_column_name"], y["abbreviation_rules_applied"]) == (exp, rules)


def test_expand_rules_chain(spark):
    df = spark.createDataFrame([("small_rod",)], "s string")
    r = with_expanded(df, "s", rules=[("rod", "rod_bar"), ("bar", "bar_stock")]).first()
    assert r["expanded_column_name"] == "small_rod_bar_stock"
    assert r["abbreviation_rules_applied"] == "rod | bar"


def test_ambiguous_golden(spark):
    for name, want in [("ID", True), ("IUCR", True), ("X", True), ("Crime Code 1", True),
                       ("Beat", False), ("FBI Code", False), ("", True), ("case_number", True)]:
        assert one(spark, name, is_ambiguous) is want, name


def test_tokenize_and_jaccard(spark):
    df = spark.createDataFrame([("case_number", "Case Number"), ("a b", "c"), ("", "x"), ("a_a b", "b")],
                               "l string, r string")
    out = df.select(jaccard(tokenize(F.col("l")), tokenize(F.col("r"))).alias("j"),
                    jaccard(tokenize(F.col("r")), tokenize(F.col("l"))).alias("k")).collect()
    assert [r["j"] for r in out] == [1.0, 0.0, 0.0, 0.5]
    assert all(r["j"] == r["k"] for r in out)  # symmetric


def test_tfidf_terms(spark):
    got = one(spark, "Case_Number | A theft", tfidf_terms)
    assert got == ["case_number", "theft", "case_number theft"]


def test_classify_column(spark):
    cases = {"incident": "code_or_id", "arrest_date": "date_or_time", "latitude": "location",
             "crime_description": "text_or_description", "premise_type": "text_or_description", "ward": "other"}
    for name, want in cases.items():
        assert one(spark, name, classify_column) == want, name


def test_parse_bool(spark):
    vals = [" Yes", "no", "T", "0", "maybe", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    assert [r[0] for r in df.select(parse_bool(F.col("s"))).collect()] == [True, False, True, False, None, None]


def test_numbers(spark):
    df = spark.createDataFrame([("10.0",), ("10.5",), ("abc",), (" 7 ",), (None,)], "s string")
    rows = df.select(to_int(F.col("s")).alias("i"), to_float(F.col("s")).alias("f")).collect()
    assert [r["i"] for r in rows] == [10, None, None, 7, None]
    assert [r["f"] for r in rows] == [10.0, 10.5, None, 7.0, None]


def test_timestamps_and_hhmm(spark):
    df = spark.createDataFrame([("05/03/2016 11:40:00 PM", "01/25/2010", "5"),
                                ("2010-01-25T00:00:00", "01/25/2010", "2359"),
                                ("garbage", "01/25/2010", None)], "a string, d string, t string")
    rows = df.select(parse_timestamp(F.col("a")).alias("ts"),
                     date_plus_hhmm(F.col("d"), F.col("t")).alias("c")).collect()
    assert rows[0]["ts"] == dt.datetime(2016, 5, 3, 23, 40)
    assert rows[1]["ts"] == dt.datetime(2010, 1, 25)
    assert rows[2]["ts"] is None
    assert [r["c"] for r in rows] == ["01/25/2010 00:05", "01/25/2010 23:59", "01/25/2010"]


def test_clean_text(spark):
    df = spark.createDataFrame([('\\"A – B"  ',), ("nan",), ("  ",)], "s string")
    assert [r[0] for r in df.select(clean_text(F.col("s"))).collect()] == ["A - B", None, None]


def test_temporal_and_rounding(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 0), 0.125), (dt.datetime(2024, 7, 6, 12, 0), 0.375),
                                (None, None)], "ts timestamp_ntz, x double")
    cols = temporal_columns(F.col("ts"))
    rows = df.select(*[v.alias(k) for k, v in cols.items()], round_half_even(F.col("x")).alias("r")).collect()
    assert rows[0]["day_of_week"] == 0 and rows[0]["is_night"] == 1 and rows[0]["season"] == "winter"
    assert rows[1]["day_of_week"] == 5 and rows[1]["is_weekend"] == 1 and rows[1]["season"] == "summer"
    assert rows[2]["is_weekend"] == 0 and rows[2]["season"] is None
    assert [r["r"] for r in rows] == [0.12, 0.38, None]
