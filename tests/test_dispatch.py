"""Manifest scan, grouped validation and dispatch."""

import os

from schemaweave.cities import CITY_SPECS
from schemaweave.constants import CANONICAL_COLUMNS, EXPECTED_SCHEMAS
from schemaweave.operators.catalog import validate
from schemaweave.operators.dispatch import dispatch, validate_group
from schemaweave.sources.readers import open_groups, scan_directory, scan_manifest

CHICAGO = EXPECTED_SCHEMAS["chicago"]


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def chicago_row(key, date="05/03/2016 11:40:00 PM", rest="1"):
    return ",".join([key, "HY" + key, date, *[rest] * (len(CHICAGO) - 3)])


def folder(spark, root):
    head = ",".join(CHICAGO)
    write(f"{root}/p/t.csv", "\n".join([head, chicago_row("1"), chicago_row("2"), chicago_row("2"), chicago_row("3") + ",too,long"]) + "\n")
    write(f"{root}/q/t.csv", "\n".join([head, chicago_row("2"), chicago_row("9")]) + "\n")  # same stem in another folder
    write(f"{root}/nulls/t.csv", "\n".join([head, "7,c,01/01/2020" + "," * (len(CHICAGO) - 3)]) + "\n")
    write(f"{root}/short/a.csv", "ID,Case Number,Date\n5,c,x\n")
    write(f"{root}/other.csv", '"a b","say ""hi"""\n1,2\n')
    write(f"{root}/empty.csv", "\n")
    write(f"{root}/bad/t.parquet", "no parquet")
    la = spark.createDataFrame([("1", "02/01/2011", "0930")], "`Report ID` string, `Arrest Date` string, Time string")
    for c in EXPECTED_SCHEMAS["la_arrests"]:
        if c not in la.columns:
            la = la.selectExpr("*", f"'1' as `{c}`")
    la.write.parquet(f"{root}/la")
    spark.range(2).write.parquet(f"{root}/p/deep")
    return root


def test_manifest_keeps_same_stems_and_failures(spark, tmp_dir):
    files = scan_manifest(spark, folder(spark, f"{tmp_dir}/in"))
    assert sorted({f.dataset for f in files}) == ["bad", "empty", "la", "nulls", "other", "p", "p/deep", "q", "short"]
    assert sorted(f.dataset for f in files if f.error) == ["bad", "empty"] and all(f.columns for f in files if not f.error)
    tables = scan_directory(spark, f"{tmp_dir}/in")
    assert sorted(tables) == ["la", "nulls", "other", "p", "p/deep", "q", "short"]
    assert tables["p"].count() == 3 and tables["q"].count() == 2 and tables["p/deep"].columns == ["id"]
    assert tables["other"].columns == ["a b", 'say "hi"'] or len(tables["other"].columns) == 2


def test_dispatch_of_a_folder(spark, tmp_dir):
    groups = open_groups(spark, scan_manifest(spark, folder(spark, f"{tmp_dir}/in")))
    assert sorted((g.dataset_type, len(g.columns)) for g in groups) == [("chicago", 3), ("chicago", 22), ("la_arrests", 11), ("unknown", 1), ("unknown", 2)]
    report, cleaned = dispatch(groups, CITY_SPECS, EXPECTED_SCHEMAS)
    got = {r.dataset: (r.dataset_type, r.status, r.row_count) for r in report.collect()}
    assert got == {"p": ("chicago", "processed", 3), "q": ("chicago", "processed", 2), "nulls": ("chicago", "invalid", 1), "short": ("chicago", "invalid", 1),
                   "other": ("unknown", "unknown", 1), "p/deep": ("unknown", "unknown", 2), "la": ("la_arrests", "processed", 1)}
    rows = cleaned["chicago"].collect()
    assert sorted(r.incident_id for r in rows) == ["1", "2", "9"] and cleaned["chicago"].columns == [*CANONICAL_COLUMNS, "dataset_source"]
    assert cleaned["la_arrests"].first().arrest_made is True and set(cleaned) == {"chicago", "la_arrests"}


def test_grouped_validation_equals_one_by_one(spark, tmp_dir):
    for g in open_groups(spark, scan_manifest(spark, folder(spark, f"{tmp_dir}/in"))):
        expected = EXPECTED_SCHEMAS.get(g.dataset_type, [])
        got = {r.dataset: tuple(r)[1:] for r in validate_group(g, expected).collect()}
        for name, facts in got.items():
            one = validate(g.rows.where(g.rows._dataset == name).drop("_dataset"), name, expected, g.dataset_type).first()
            assert facts == tuple(one)[1:]
