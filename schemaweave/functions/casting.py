"""Typed parsing of all-string source columns (ANSI-safe: only try_* casts)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaweave.constants import BOOL_FALSE, BOOL_TRUE, TIMESTAMP_FORMATS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_bool(col) -> Column:
    """true/false/t/f/1/0/y/n/yes/no (trimmed, any case) -> boolean, else null."""
    s = F.lower(F.trim(_c(col).cast("string")))
    return (F.when(s.isin(*BOOL_TRUE), F.lit(True))
             .when(s.isin(*BOOL_FALSE), F.lit(False))
             .otherwise(F.lit(None).cast("boolean")))


# a plain number: no letter suffix, no 'nan' or 'inf' words
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_float(col) -> Column:
    """Double, or null for anything that is not a plain number."""
    s = F.trim(_c(col).cast("string"))
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def to_int(col) -> Column:
    """64-bit integer: as written, else via double, so '10.0' parses; a
    fractional value gives null."""
    s = F.trim(_c(col).cast("string"))
    d = to_float(col)
    return F.coalesce(F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint")),
                      F.when(d == F.floor(d), d.try_cast("bigint")))


def literal_shape(fmt: str) -> str | None:
    """LIKE pattern (lower case) of the characters that every text of a datetime format holds, in order; none
    for formats with optional parts.  It never rejects a text that the format parses."""
    if any(c in fmt for c in "[]{}#\\"):
        return None
    plain = re.sub(r"'([^']*)'|([A-Za-z]+)", lambda m: "%" if m[1] is None else (m[1] or "'").replace("_", "%"), fmt)
    return re.sub("%+", "%", f"%{plain.lower()}%")


def parse_timestamp(col, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """First format that parses wins; failures give null (timestamp_ntz).

    A failed attempt costs an exception, so a format is tried on texts of its shape only."""
    s = F.trim(_c(col).cast("string"))

    def attempt(fmt: str) -> Column:
        parsed, shape = F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz"), literal_shape(fmt)
        return parsed if shape is None else F.when(F.lower(s).like(shape), parsed)

    return F.coalesce(*[attempt(f) for f in formats])


def date_plus_hhmm(date_col, time_col) -> Column:
    """'<date> HH:MM' from a date text and an HHMM-ish time text.

    A time of day in the date text is cut off first ('2010-01-25T00:00:00',
    '01/08/2020 12:00:00 AM').  Digits only, left-padded to 4 (lpad also cuts at
    4).  A null time yields the date alone, which parses as midnight.
    """
    day = F.regexp_replace(_c(date_col).cast("string"), r"[T ]\d{1,2}:\d{2}.*$", "")
    digits = F.regexp_replace(_c(time_col).cast("string"), r"\D", "")
    t = F.lpad(digits, 4, "0")
    hhmm = F.concat(F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2))
    return F.trim(F.concat_ws(" ", day, hhmm))


def flag_from_text(col, pattern: str = "ARREST|BOOKED") -> Column:
    """True where the upper-cased text matches ``pattern``; otherwise null."""
    return F.when(F.upper(_c(col)).rlike(pattern), F.lit(True)).otherwise(F.lit(None).cast("boolean"))


def bool_to_int(col) -> Column:
    return _c(col).cast("int")
