"""Mapping raw sources to the canonical incident schema (projections, filters, casts, de-dup)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweave.constants import (BOOL_COLUMNS, CANONICAL_COLUMNS, CANONICAL_SCHEMA,
                                   DATETIME_COLUMNS, DEDUP_KEY_PRIORITY, FLOAT_COLUMNS,
                                   INT_COLUMNS, TEXT_COLUMNS, TYPE_DETECTORS, LA_FALLBACK, LA_HINTS)
from schemaweave.functions.casting import (date_plus_hhmm, flag_from_text, parse_bool,
                                           parse_timestamp, to_float, to_int)
from schemaweave.functions.temporal import fill_year
from schemaweave.functions.text import clean_text
from schemaweave.operators.keyed import first_per_key


# --- P1, P2, P3, P4, P5, P6 ----------------------------------------------------
def drop_index_artifacts(df: DataFrame) -> DataFrame:
    """Drop blank-named columns and index artifacts ('Unnamed…', Spark's '_c0')."""
    junk = [c for c in df.columns if not c.strip() or c.startswith("Unnamed") or c == "_c0"]
    return df.drop(*junk) if junk else df


def rename_to_canonical(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def first_present(df, candidates: Sequence[str]) -> Column | None:
    """The first candidate column that exists (a schema-time choice).
    ``df`` is a DataFrame or its column list."""
    present = set(df.columns if isinstance(df, DataFrame) else df)
    for c in candidates:
        if c in present:
            return F.col(f"`{c}`")
    return None


def ensure_canonical(df: DataFrame, columns: Sequence[str] = CANONICAL_COLUMNS) -> DataFrame:
    """Add missing canonical columns as typed nulls, keep the rest."""
    types = {f.name: f.dataType for f in CANONICAL_SCHEMA.fields}
    missing = [F.lit(None).cast(types.get(c, "string")).alias(c) for c in columns if c not in df.columns]
    return df.select("*", *missing) if missing else df


def project_final(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df.select(*cols)


def select_available(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    keep = [c for c in cols if c in df.columns]
    if target and target in df.columns and target not in keep:
        keep.append(target)
    return df.select(*keep)


# --- P7, P8, P9, P10, P11 ------------------------------------------------------
def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def filter_isin(df: DataFrame, col: str, values) -> DataFrame:
    """Keep rows whose ``col`` is in ``values`` (a list, or a DataFrame -> semi join)."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(col)).distinct(), col, "left_semi")
    return df.where(F.col(col).isin(list(values)))


def filter_label(df: DataFrame, label: int, col: str = "is_match") -> DataFrame:
    return df.where(F.col(col) == label)


def clean_label(col) -> Column:
    """null / '' / non-numeric -> 0, else the integer."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.trim(c.cast("string")).try_cast("double").try_cast("int"), F.lit(0))


def predict(score, threshold: float) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.coalesce(s >= F.lit(threshold), F.lit(False)).cast("int")


# --- P12 -----------------------------------------------------------------------
def detect_type(columns: Sequence[str], detectors=TYPE_DETECTORS) -> str:
    cols = set(columns)
    for name, required in detectors:
        if set(required).issubset(cols):
            return name
    return "unknown"


def detect_by_hints(columns: Sequence[str], hints=LA_HINTS, fallback: str = LA_FALLBACK) -> str:
    """Type of a table known to belong to one family of types: the first line of
    hints whose conditions (any / all of some headers) hold, else the fallback."""
    cols = set(columns)
    for name, conditions in hints:
        if all((any if mode == "any" else all)(h in cols for h in headers) for mode, headers in conditions):
            return name
    return fallback


def route_by_type(catalog: DataFrame, dataset_col: str = "dataset", column_col: str = "column",
                  detectors=TYPE_DETECTORS) -> DataFrame:
    """Over a column catalog: the first detector whose required set is present."""
    sets = catalog.groupBy(dataset_col).agg(F.collect_set(column_col).alias("_cols"))
    out = F.lit("unknown")
    for name, required in reversed(list(detectors)):
        req = F.array(*[F.lit(r) for r in required])
        out = F.when(F.size(F.array_except(req, F.col("_cols"))) == 0, F.lit(name)).otherwise(out)
    return sets.select(dataset_col, out.alias("dataset_type"))


# --- P15 -------------------------------------------------------------------------
def label_map(col, mapping: Mapping[str, str]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c)


def presentation_rank(col, order: Sequence[str]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.array_position(F.array(*[F.lit(x) for x in order]), c)


# --- N14 ---------------------------------------------------------------------------
def finalize_types(df: DataFrame, timestamp_formats: Sequence[str] | None = None) -> DataFrame:
    """Canonical casts in one projection; extra columns are kept after the canonical ones."""
    df = ensure_canonical(df)
    dtypes = dict(df.dtypes)
    exprs = []
    for c in CANONICAL_COLUMNS:
        col = F.col(c)
        if c in BOOL_COLUMNS:
            e = col if dtypes[c] == "boolean" else parse_bool(col)
        elif c in INT_COLUMNS:
            e = to_int(col)
        elif c in FLOAT_COLUMNS:
            e = to_float(col)
        elif c in DATETIME_COLUMNS:
            e = (col.cast("timestamp_ntz") if dtypes[c].startswith("timestamp")
                 else parse_timestamp(col, timestamp_formats) if timestamp_formats else parse_timestamp(col))
        else:
            e = clean_text(col.cast("string")) if c in TEXT_COLUMNS else col.cast("string")
        exprs.append(e.alias(c))
    extra = [c for c in dtypes if c not in CANONICAL_COLUMNS]
    return df.select(*exprs, *extra)


# --- W1 ------------------------------------------------------------------------------
def deduplicate(df: DataFrame, key_priority: Sequence[Sequence[str]] = DEDUP_KEY_PRIORITY,
                order_by: Sequence[str] = (), null_keys: str = "keep") -> DataFrame:
    """First fully present key set wins; first row per key by ``order_by``.

    Skew-safe: ``row_number() = 1`` becomes a WindowGroupLimit, one row per key and map task.
    """
    for keys in key_priority:
        if all(k in df.columns for k in keys):
            order = list(order_by) or [c for c in df.columns if c not in keys][:1]
            return first_per_key(df, list(keys), order, null_keys=null_keys)
    return df


# --- P13: declarative source -> canonical mapping -------------------------------
@dataclass
class CleanSpec:
    """How one source maps to the canonical schema.

    ``rename``: exact source -> canonical renames.  ``candidates``: canonical ->
    ordered alternative source columns (first present wins).  ``datetime``:
    (date candidates, time candidates) combined as date + HH:MM.  ``flag``:
    canonical -> (source candidates, pattern) text flag.  ``constants``:
    canonical -> literal.  ``year_from_datetime``: 'fill' keeps a present year,
    'override' takes the timestamp's year where it parses.
    """

    rename: Mapping[str, str] = field(default_factory=dict)
    candidates: Mapping[str, Sequence[str]] = field(default_factory=dict)
    datetime: tuple[Sequence[str], Sequence[str]] | None = None
    flag: Mapping[str, tuple[Sequence[str], str]] = field(default_factory=dict)
    constants: Mapping[str, object] = field(default_factory=dict)
    year_from_datetime: str = "fill"
    key_priority: Sequence[Sequence[str]] = field(default_factory=lambda: DEDUP_KEY_PRIORITY)
    order_by: Sequence[str] = ()


def clean_source(df: DataFrame, spec: CleanSpec, null_keys: str = "keep",
                 timestamp_formats: Sequence[str] | None = None) -> DataFrame:
    """Source -> canonical, typed and de-duplicated, as one lazy plan."""
    df = drop_index_artifacts(df)
    names = df.columns
    cols: dict[str, Column] = {}
    for src, dst in spec.rename.items():
        if src in names:
            cols[dst] = F.col(f"`{src}`")
    for dst, cands in spec.candidates.items():
        if dst not in cols:
            c = first_present(names, cands)
            if c is not None:
                cols[dst] = c
    if spec.datetime is not None:
        d, t = first_present(names, spec.datetime[0]), first_present(names, spec.datetime[1])
        if d is not None and t is not None:
            cols["incident_datetime"] = date_plus_hhmm(d, t)
        elif d is not None:
            cols["incident_datetime"] = d
    for dst, (cands, pattern) in spec.flag.items():
        c = first_present(names, cands)
        if c is not None:
            cols[dst] = flag_from_text(c, pattern)
    for dst, value in spec.constants.items():
        cols[dst] = F.lit(value)
    out = df.select(*[v.alias(k) for k, v in cols.items()])
    out = finalize_types(out, timestamp_formats)
    if spec.year_from_datetime == "override":
        out = out.withColumn("year", F.coalesce(F.year("incident_datetime").cast("bigint"), F.col("year")))
    else:
        out = out.withColumn("year", fill_year("year", "incident_datetime"))
    out = out.select(*CANONICAL_COLUMNS)
    return deduplicate(out, spec.key_priority, spec.order_by or CANONICAL_COLUMNS[2:3], null_keys)


# --- P14 ------------------------------------------------------------------------------
def process_dispatch(tables: Mapping[str, DataFrame], specs: Mapping[str, CleanSpec],
                     expected: Mapping[str, Sequence[str]], detectors=TYPE_DETECTORS,
                     null_keys: str = "keep", families: Mapping[str, tuple] | None = None
                     ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Validate every table, then clean the valid ones with their type's spec.

    ``families`` names tables whose family is known, as {table: (hints, fallback)};
    they are routed by header hints instead of required columns.

    Returns ({name: canonical DataFrame tagged with ``dataset_source``}, the
    validation table).  A table of unknown type, failing validation, or
    without a spec is left out, as the reference skips it; one lazy plan per
    table, and nothing is read beyond the schema until an action runs.
    """
    from schemaweave.operators.catalog import validate

    def type_of(name: str, df: DataFrame) -> str:
        if families and name in families:
            return detect_by_hints(df.columns, *families[name])
        return detect_type(df.columns, detectors)

    results, cleaned = None, {}
    for name, df in tables.items():
        dtype = type_of(name, df)
        v = validate(df, name, expected.get(dtype, []), dtype)
        results = v if results is None else results.unionByName(v)
    valid = {r["dataset"] for r in results.where("is_valid").select("dataset").collect()} if results else set()
    for name, df in tables.items():
        dtype = type_of(name, df)
        if name in valid and dtype in specs:
            cleaned[name] = clean_source(df, specs[dtype], null_keys).withColumn("dataset_source", F.lit(dtype))
    return cleaned, results
