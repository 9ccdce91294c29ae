"""Feature construction over the canonical incident table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweave.functions.temporal import round_half_even, temporal_columns
from schemaweave.operators.clean import drop_nulls, select_available
from schemaweave.operators.keyed import attach_group_count, dense_codes, ranked_by_group
from schemaweave.session import scratch_path


# --- A4 --------------------------------------------------------------------------------
def frequency_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Value -> its count over the table; a null stays null (count + join back)."""
    return attach_group_count(df, [col], out or f"{col}_freq")


# --- J6 --------------------------------------------------------------------------------
def group_count(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    return attach_group_count(df, list(keys), out)


# --- N18 -------------------------------------------------------------------------------
def label_encode(df: DataFrame, col: str, out: str | None = None, as_string: bool = False,
                 null_label: str = "nan") -> DataFrame:
    """0-based code of the value in the sorted distinct values.

    ``as_string``: values are compared as text and null is its own class
    ``null_label`` (so ``10`` sorts before ``2``).  The code table comes from
    :func:`dense_codes` (range partitioned, no single-task window) and is joined
    back; AQE broadcasts it when it is small.
    """
    out = out or col
    src = F.coalesce(F.col(col).cast("string"), F.lit(null_label)) if as_string else F.col(col)
    keyed = df.withColumn("_lv", src)
    codes = dense_codes(keyed, "_lv", "_code")
    joined = keyed.join(codes, "_lv", "left").drop("_lv")
    if out == col:
        joined = joined.drop(col)
    return joined.withColumnRenamed("_code", out)


# --- M2 --------------------------------------------------------------------------------
def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (nulls ignored): one aggregate row."""
    row = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def apply_standard_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """z = (x - mean) / std; a constant column (std 0) becomes 0."""
    exprs = {}
    for c, (m, s) in params.items():
        if m is None:
            exprs[c] = F.lit(None).cast("double")
        else:
            exprs[c] = (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)
    return df.withColumns(exprs)


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_standard_scaler(df, fit_standard_scaler(df, cols))


# --- M5 --------------------------------------------------------------------------------
FEATURE_COLUMNS = [
    "crime_category", "crime_subtype", "location_type", "district", "ward",
    "community_area", "domestic_flag", "latitude", "longitude", "year",
    "hour", "day_of_week", "month", "is_weekend", "is_night",
    "lat_rounded", "lon_rounded", "location_cluster",
    "crime_subtype_freq", "location_type_freq", "district_hour_crime_count",
]
CATEGORICAL = ["crime_category", "crime_subtype", "location_type", "season"]
ORDINAL = ["district", "ward", "community_area"]
NUMERIC = ["latitude", "longitude", "year", "hour", "day_of_week", "month", "lat_rounded",
           "lon_rounded", "crime_subtype_freq", "location_type_freq", "district_hour_crime_count"]


def _code_key(col: str, null_label: str = "nan"):
    return F.coalesce(F.col(col).cast("string"), F.lit(null_label))


def _encode_many(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Label-encode several columns (as text, null as 'nan') from one table of
    (column, value, code), built by one distributed ranking of the distinct
    values and joined once per column; AQE broadcasts it from its real size."""
    if not cols:
        return df
    out = df.withColumns({f"_k_{c}": _code_key(c) for c in cols})
    pairs = out.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"_k_{c}").alias("v"))
                                          for c in cols]))).distinct()
    codes = ranked_by_group(pairs, ["c"], "v", "code")
    path = scratch_path(df.sparkSession, "codes")
    codes.write.parquet(path)
    codes = df.sparkSession.read.schema(codes.schema).parquet(path)
    for c in cols:
        table = codes.where(F.col("c") == c).select(F.col("v").alias(f"_k_{c}"), F.col("code").alias(f"_code_{c}"))
        out = out.join(table, f"_k_{c}", "left")
    return out.withColumns({c: F.col(f"_code_{c}") for c in cols}).drop(
        *[f"_k_{c}" for c in cols], *[f"_code_{c}" for c in cols])


def create_features(incidents: DataFrame, target: str = "arrest_made", clusters: DataFrame | None = None,
                    key: str = "incident_id", scale: bool = True, materialise: bool = True) -> DataFrame:
    """Temporal -> spatial -> frequency -> ordinal codes -> group counts ->
    projection -> null drop -> categorical codes -> 0/1 -> z-scores.

    Every lookup (frequencies, codes, group counts) is an aggregate of one
    shared base joined back once, never an aggregate of an already joined
    table, so the plan grows linearly with the number of features.
    ``clusters`` (key, location_cluster) comes from :func:`kmeans_clusters`;
    without it the column is absent, as when coordinates are few.
    """
    base = incidents.withColumns({k: v for k, v in temporal_columns(F.col("incident_datetime")).items()
                                  if k != "year"})
    base = base.withColumn("year", F.year("incident_datetime").cast("bigint"))
    base = base.withColumns({"lat_rounded": round_half_even(F.col("latitude"), 2),
                             "lon_rounded": round_half_even(F.col("longitude"), 2)})
    if clusters is not None:
        base = base.join(clusters, key, "left")
    df = base
    for c in ["crime_subtype", "location_type", "block_address"]:
        if c in base.columns:
            freq = base.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(f"{c}_freq"))
            df = df.join(freq, c, "left")
    # group counts use the encoded district ('nan' is a class), as the codes do
    if "district" in base.columns:
        dh = (base.where(F.col("hour").isNotNull())
              .groupBy(_code_key("district").alias("_dk"), F.col("hour").alias("_hk"))
              .agg(F.count(F.lit(1)).alias("district_hour_crime_count")))
        df = df.join(dh, (_code_key("district") == F.col("_dk")) & (F.col("hour") == F.col("_hk")), "left") \
               .drop("_dk", "_hk")
    df = _encode_many(df, [c for c in ORDINAL if c in df.columns])
    df = select_available(df, [key, *FEATURE_COLUMNS], target)
    df = drop_nulls(df, [c for c in df.columns if c != key])
    if materialise:
        # the code probe, the scaler fit and the output all read this table:
        # write it once to the shared checkpoint folder and cut the lineage
        path = scratch_path(df.sparkSession, "features")
        df.write.mode("overwrite").parquet(path)
        df = df.sparkSession.read.parquet(path)
    df = _encode_many(df, [c for c in CATEGORICAL if c in df.columns])
    df = df.withColumns({c: F.col(c).cast("int") for c in ["domestic_flag", "is_weekend", "is_night", target]
                         if c in df.columns})
    if scale:
        df = standard_scale(df, [c for c in NUMERIC if c in df.columns])
    return df
