"""City-shaped fixtures through validation, dispatch and the canonical mapping."""

import datetime as dt

from schemaweave.cities import CITY_SPECS
from schemaweave.constants import CANONICAL_COLUMNS, EXPECTED_SCHEMAS
from schemaweave.operators.clean import clean_source, process_dispatch

CHICAGO = ["ID", "Case Number", "Date", "Block", "IUCR", "Primary Type", "Description", "Location Description",
           "Arrest", "Domestic", "Beat", "District", "Ward", "Community Area", "FBI Code", "X Coordinate",
           "Y Coordinate", "Year", "Updated On", "Latitude", "Longitude", "Location"]


def _strings(spark, cols, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_chicago_mapping(spark):
    row = ("10", "HY1", "05/03/2016 11:40:00 PM", "0 X ST", "041A", "BATTERY", "SIMPLE", "STREET", "true",
           "False", "10.0", "7", "3", "25", "08B", "1.5", "2.5", None, "05/10/2016 03:56:50 PM", "41.8", "-87.7",
           "(41.8, -87.7)")
    out = clean_source(_strings(spark, CHICAGO, [row, row]), CITY_SPECS["chicago"])
    rows = out.collect()
    assert out.columns == CANONICAL_COLUMNS and len(rows) == 1
    r = rows[0]
    assert r["incident_datetime"] == dt.datetime(2016, 5, 3, 23, 40) and r["year"] == 2016
    assert r["arrest_made"] is True and r["domestic_flag"] is False and r["beat"] == 10 and r["latitude"] == 41.8


def test_la_specs(spark):
    crimes = _strings(spark, ["DR_NO", "Date Rptd", "DATE OCC", "TIME OCC", "AREA", "Crm Cd Desc", "Status Desc",
                              "LAT", "LON"],
                      [("1", "01/26/2010", "01/25/2010", "2230", "3", "THEFT", "Adult Arrest", "34.0", "-118.2"),
                       ("2", "01/26/2010", "01/25/2010", "5", "4", "THEFT", "Invest Cont", "34.1", "-118.3")])
    c = {r["incident_id"]: r for r in clean_source(crimes, CITY_SPECS["la_crimes"]).collect()}
    assert c["1"]["incident_datetime"] == dt.datetime(2010, 1, 25, 22, 30) and c["1"]["arrest_made"] is True
    assert c["2"]["incident_datetime"] == dt.datetime(2010, 1, 25, 0, 5) and c["2"]["arrest_made"] is None
    assert c["1"]["year"] == 2010 and c["1"]["district"] == 3
    arrests = _strings(spark, ["Report ID", "Arrest Date", "Time", "Area ID", "Charge Group Description", "LAT",
                               "LON"], [("9", "02/01/2011", "930", "12", "Robbery", "34", "-118")])
    a = clean_source(arrests, CITY_SPECS["la_arrests"]).first()
    assert a["arrest_made"] is True and a["incident_datetime"] == dt.datetime(2011, 2, 1, 9, 30)
    assert a["updated_on"] == dt.datetime(2011, 2, 1) and a["crime_category"] == "Robbery"


def test_process_dispatch(spark):
    good = _strings(spark, CHICAGO, [tuple(["1"] * len(CHICAGO))])
    missing = _strings(spark, ["ID", "Case Number", "Date"], [("1", "c", "05/03/2016 11:40:00 PM")])
    unknown = _strings(spark, ["foo"], [("x",)])
    cleaned, validation = process_dispatch({"chi": good, "chi_partial": missing, "other": unknown}, CITY_SPECS,
                                           EXPECTED_SCHEMAS)
    v = {r["dataset"]: r for r in validation.collect()}
    assert v["chi"]["is_valid"] and not v["chi_partial"]["is_valid"] and v["other"]["dataset_type"] == "unknown"
    assert set(cleaned) == {"chi"} and cleaned["chi"].first()["dataset_source"] == "chicago"
