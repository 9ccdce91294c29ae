"""Sources and sinks: CSV reads, delimiter sniffing, registry, metadata files, incident loads."""

import json
import os

from pyspark.sql import functions as F

from schemaweave.constants import CANONICAL_COLUMNS
from schemaweave.operators.clean import CleanSpec, clean_source, drop_index_artifacts
from schemaweave.sources.readers import (dataset_registry, read_column_metadata, read_csv_robust, read_csv_sniff,
                                         scan_directory)
from schemaweave.sources.sinks import load_incidents, write_canonical, write_codebook


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_robust_csv_all_strings_and_artifacts(spark, tmp_dir):
    p = os.path.join(tmp_dir, "chi.csv")
    _write(p, 'Unnamed: 0,ID,Block,Arrest\n0,10,"12 \\"X\\" ST",true\n1,11,"A, B",false\n')
    df = drop_index_artifacts(read_csv_robust(spark, p))
    assert df.columns == ["ID", "Block", "Arrest"]
    assert dict(df.dtypes) == {"ID": "string", "Block": "string", "Arrest": "string"}
    assert sorted(r["Block"] for r in df.collect()) == ['12 "X" ST', "A, B"]


def test_sniff_semicolon(spark, tmp_dir):
    p = os.path.join(tmp_dir, "semi.csv")
    _write(p, "a;b\n1;2\n")
    assert read_csv_sniff(spark, p).columns == ["a", "b"]


def test_registry_and_scan(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "x.csv"), "a,b,c\n1,2,3\n")
    _write(os.path.join(tmp_dir, "x_metadata.json"), "{}")
    cfg = spark.createDataFrame([("x", "cx", "x.csv"), ("y", "cy", "y.csv")], "dataset_key string, city string, "
                                                                               "csv_file string")
    reg = {r["dataset_key"]: r for r in dataset_registry(spark, cfg, tmp_dir).collect()}
    assert reg["x"]["file_exists"] and reg["x"]["num_columns"] == 3 and reg["x"]["has_metadata_json"]
    assert not reg["y"]["file_exists"] and reg["y"]["num_columns"] is None
    assert set(scan_directory(spark, tmp_dir, ("*.csv",))) == {"x"}


def test_metadata_file(spark, tmp_dir):
    p = os.path.join(tmp_dir, "meta.json")
    _write(p, json.dumps({"meta": {"view": {"columns": [{"fieldName": "Case Number", "description": "The case"}]}}}))
    got = {r["key"]: r["description"] for r in read_column_metadata(spark, p).collect()}
    assert got == {"casenumber": "The case"}


def test_clean_write_and_idempotent_load(spark, tmp_dir):
    raw = spark.createDataFrame(
        [("1", "C1", "05/03/2016 11:40:00 PM", "ARREST MADE", "10.0"), ("1", "C1", "05/03/2016 11:40:00 PM", "x", "10"),
         ("2", "C2", "bad", "BOOKED", None)],
        "DR_NO string, case string, `DATE OCC` string, `Status Desc` string, AREA string")
    spec = CleanSpec(candidates={"incident_id": ["DR_NO"], "case_number": ["case"],
                                 "incident_datetime": ["DATE OCC"], "district": ["AREA"]},
                     flag={"arrest_made": (["Status Desc"], "ARREST|BOOKED")})
    clean = clean_source(raw, spec)
    assert clean.columns == CANONICAL_COLUMNS and clean.count() == 2
    r1 = clean.where("incident_id = '1'").first()
    # duplicates on the key: one survives (ties by smallest payload, deterministic)
    assert r1["arrest_made"] in (True, None) and r1["district"] == 10 and r1["year"] == 2016
    assert clean.where("incident_id = '2'").first()["arrest_made"] is True
    paths = write_canonical(clean, tmp_dir, "t")
    assert spark.read.parquet(paths["parquet"]).count() == 2
    doc = spark.read.json(paths["profile"]).first()
    assert doc["n_rows"] == 2 and doc["n_cols"] == len(CANONICAL_COLUMNS)
    assert doc["columns"]["beat"]["null_pct"] == 100.0 and doc["columns"]["district"]["dtype"] == "bigint"
    table = os.path.join(tmp_dir, "incidents")
    assert load_incidents(clean, table, "la").count() == 2
    assert load_incidents(clean, table, "la").count() == 0
    assert spark.read.parquet(table).where(F.col("dataset_source") == "la").count() == 2


def test_codebook_sink(spark, tmp_dir):
    from schemaweave.operators.sections import extract_sections
    items = ["RADIO CODES", "10-25", "RESPOND AS BACKUP", "Priorities", "A", "Emergency"]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(items)], "doc int, pos int, item string")
    path = os.path.join(tmp_dir, "codebook")
    write_codebook(extract_sections(df), path)
    got = {(r["section"], r["code"], r["description"]) for r in spark.read.json(path).collect()}
    assert got == {("radio_codes", "10-25", "RESPOND AS BACKUP"), ("priorities", "A", "Emergency")}
