"""Source -> canonical mappings for the three city formats (configuration)."""

from __future__ import annotations

from schemaweave.operators.clean import CleanSpec

# --- fixed values: Chicago column -> canonical column ------------------------
CHICAGO_RENAME = {
    "ID": "incident_id",
    "Case Number": "case_number",
    "Date": "incident_datetime",
    "Block": "block_address",
    "IUCR": "iucr_code",
    "Primary Type": "crime_category",
    "Description": "crime_subtype",
    "Location Description": "location_type",
    "Arrest": "arrest_made",
    "Domestic": "domestic_flag",
    "Beat": "beat",
    "District": "district",
    "Ward": "ward",
    "Community Area": "community_area",
    "FBI Code": "fbi_code",
    "X Coordinate": "x_coord",
    "Y Coordinate": "y_coord",
    "Year": "year",
    "Updated On": "updated_on",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "Location": "location_point",
}

# --- fixed values: LA crimes candidate source columns (first present wins) ---
LA_CRIMES_CANDIDATES = {
    "incident_id": ["DR_NO", "DR Number"],
    "case_number": ["DR_NO", "DR Number"],
    "updated_on": ["Date Rptd", "DATE RPTD", "Report Date"],
    "block_address": ["LOCATION", "Address", "Location"],
    "crime_category": ["Crm Cd Desc", "CrmCdDesc", "Category"],
    "crime_subtype": ["MO Codes", "Weapon Desc", "Desc", "Status"],
    "location_type": ["Premis Desc", "PremisDesc", "Premise Description"],
    "district": ["AREA", "AREA NAME"],
    "latitude": ["LAT"],
    "longitude": ["LON"],
}
LA_CRIMES_DATE = ["DATE OCC", "Date Occurred", "DATE_OCC", "DateOccured", "DATE"]
LA_CRIMES_TIME = ["TIME OCC", "Time Occurred", "TIME_OCC", "TIME"]
LA_CRIMES_STATUS = ["Status Desc", "STATUS", "STATUS DESC"]

# --- fixed values: LA arrests candidate source columns -----------------------
LA_ARRESTS_CANDIDATES = {
    "incident_id": ["Report ID"],
    "case_number": ["Report ID"],
    "updated_on": ["Arrest Date"],
    "block_address": ["Address", "Location", "LOCATION"],
    "crime_category": ["Charge Group Description", "Charge"],
    "crime_subtype": ["Charge Description", "Charge", "Arrest Type"],
    "district": ["Area ID", "Area Name"],
    "latitude": ["LAT"],
    "longitude": ["LON"],
}
LA_ARRESTS_DATE = ["Arrest Date"]
LA_ARRESTS_TIME = ["Time", "Arrest Time", "TIME"]

LA_KEYS = [["incident_id"], ["case_number", "incident_datetime"]]

CITY_SPECS = {
    "chicago": CleanSpec(rename=CHICAGO_RENAME, year_from_datetime="fill"),
    "la_crimes": CleanSpec(candidates=LA_CRIMES_CANDIDATES, datetime=(LA_CRIMES_DATE, LA_CRIMES_TIME),
                           flag={"arrest_made": (LA_CRIMES_STATUS, "ARREST|BOOKED")},
                           year_from_datetime="override", key_priority=LA_KEYS),
    "la_arrests": CleanSpec(candidates=LA_ARRESTS_CANDIDATES, datetime=(LA_ARRESTS_DATE, LA_ARRESTS_TIME),
                            constants={"arrest_made": True}, year_from_datetime="override", key_priority=LA_KEYS),
}
