"""Fixed values that results depend on.  Stated plainly, in natural order."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: canonical incident schema (22 columns, in order) ----------
CANONICAL_COLUMNS = [
    "incident_id", "case_number", "incident_datetime", "block_address", "iucr_code",
    "crime_category", "crime_subtype", "location_type", "arrest_made", "domestic_flag",
    "beat", "district", "ward", "community_area", "fbi_code", "x_coord", "y_coord",
    "year", "updated_on", "latitude", "longitude", "location_point",
]

BOOL_COLUMNS = ["arrest_made", "domestic_flag"]
INT_COLUMNS = ["beat", "district", "ward", "community_area", "year"]
FLOAT_COLUMNS = ["x_coord", "y_coord", "latitude", "longitude"]
DATETIME_COLUMNS = ["incident_datetime", "updated_on"]
TEXT_COLUMNS = ["block_address", "iucr_code", "crime_category", "crime_subtype",
                "location_type", "fbi_code", "location_point"]


def _canonical_type(name: str) -> T.DataType:
    if name in BOOL_COLUMNS:
        return T.BooleanType()
    if name in INT_COLUMNS:
        return T.LongType()
    if name in FLOAT_COLUMNS:
        return T.DoubleType()
    if name in DATETIME_COLUMNS:
        return T.TimestampNTZType()
    return T.StringType()


CANONICAL_SCHEMA = T.StructType([T.StructField(c, _canonical_type(c), True)
                                 for c in CANONICAL_COLUMNS])

# --- fixed values: default de-duplication key priority ------------------------
DEDUP_KEY_PRIORITY = [
    ["incident_id", "case_number", "incident_datetime"],
    ["case_number", "incident_datetime"],
    ["incident_id"],
]

# --- fixed values: boolean text map -------------------------------------------
BOOL_TRUE = ["true", "t", "1", "y", "yes"]
BOOL_FALSE = ["false", "f", "0", "n", "no"]

# --- fixed values: timestamp formats tried in order ---------------------------
TIMESTAMP_FORMATS = [
    "MM/dd/yyyy hh:mm:ss a",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "MM/dd/yyyy HH:mm",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
]

# --- fixed values: abbreviation rules (source_pattern, expanded_form) ---------
ABBREVIATION_RULES = [
    ("iucr", "illinois_uniform_crime_reporting_code"),
    ("fbi", "federal_bureau_of_investigation_code"),
    ("dr_no", "department_report_number"),
    ("pdid", "police_department_incident_id"),
    ("beat", "police_beat_area"),
]

# --- fixed values: expected source schemas and type detection -----------------
EXPECTED_SCHEMAS = {
    "chicago": ["ID", "Case Number", "Date", "Block", "IUCR", "Primary Type", "Description",
                "Location Description", "Arrest", "Domestic", "Beat", "District", "Ward",
                "Community Area", "FBI Code", "X Coordinate", "Y Coordinate", "Year",
                "Updated On", "Latitude", "Longitude", "Location"],
    "la_crimes": ["DR_NO", "Date Rptd", "DATE OCC", "TIME OCC", "AREA", "AREA NAME",
                  "Crm Cd Desc", "Premis Desc", "Status Desc", "LOCATION", "LAT", "LON"],
    "la_arrests": ["Report ID", "Arrest Date", "Time", "Area ID", "Area Name",
                   "Charge Group Description", "Charge Description", "Address",
                   "LAT", "LON", "Arrest Type Code"],
    "sf_radio": ["Radio Code", "Description", "Disposition", "Priority"],
}

# (type, required column subset) checked in order; first hit wins.
TYPE_DETECTORS = [
    ("chicago", ["ID", "Case Number", "Date"]),
    ("la_crimes", ["DR_NO", "DATE OCC"]),
    ("la_arrests", ["Report ID", "Arrest Date"]),
    ("sf_radio", ["Radio Code"]),
]

# --- fixed values: header hints of the LA tables, in order; every condition of a line must hold ---
LA_HINTS = [
    ("la_crimes", [("any", ["DR_NO", "DATE OCC", "TIME OCC"]), ("any", ["Crm Cd Desc", "CrmCdDesc"])]),
    ("la_arrests", [("all", ["Report ID", "Arrest Date"])]),
    ("la_arrests", [("any", ["Charge Description"])]),
]
LA_FALLBACK = "la_crimes"

# --- fixed values: column type keywords (substring rules, in order) ------------
COLUMN_TYPE_RULES = [
    ("code_or_id", ["id", "code", "number", "no"]),
    ("date_or_time", ["date", "time", "year", "month"]),
    ("location", ["lat", "lon", "location", "address", "area"]),
    ("text_or_description", ["desc", "description", "text", "type"]),
]
COLUMN_TYPE_ORDER = ["code_or_id", "date_or_time", "location", "text_or_description",
                     "other", "mixed"]

# --- fixed values: score columns and their display labels ---------------------
SCORE_METHODS = [
    ("lexical_jaccard", "lexical_jaccard", "Lexical (Jaccard)"),
    ("embedding_header_only_cosine", "embedding_header_only", "Embedding (Header-only)"),
    ("embedding_header_context_cosine", "embedding_header_context", "Embedding (Header+Context)"),
]
FIXED_THRESHOLDS = {
    "lexical_jaccard": 0.5,
    "embedding_header_only_cosine": 0.6,
    "embedding_header_context_cosine": 0.6,
}
PAIR_KEY = ["left_city", "right_city", "left_column_final", "right_column_final"]

# --- fixed values: code-book section headers and rules ------------------------
SECTION_HEADERS = {
    "RADIO CODES": "radio_codes",
    "Dispositions:": "dispositions",
    "Suffixes and Radio Code Modifiers:": "modifiers",
    "Priorities": "priorities",
    "RADIO CODES- S.F. Sheriff Dept.": "sheriff_codes",
    "RADIO CODES-S.F. Sheriff Dept.": "sheriff_codes",
}
# section -> (mode, pattern).  "next_not_code": pair a code with the next item
# unless that item is itself a code; "pair": pair with the next item and consume
# it; "inline": split one item into code and text.
SECTION_RULES = {
    "radio_codes": ("next_not_code", r"(10-\d{1,3}[A-Z]?|\d{2,4}[A-Z]?|CODE\s*\d+)"),
    "dispositions": ("pair", r"[A-Z]{2,4}"),
    "modifiers": ("inline", r"^([A-Z]{1,3}|RED)\s*-\s*(.+)$"),
    "priorities": ("pair", r"[A-Z]"),
    "sheriff_codes": ("pair", r"10-\d{1,3}[A-Z]?"),
}
