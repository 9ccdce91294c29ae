"""Row-pipeline plans on the driver tables: orders / customer / events as incident sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.cities import CITY_SPECS
from schemaweave.constants import EXPECTED_SCHEMAS
from schemaweave.functions.casting import (date_plus_hhmm, flag_from_text, parse_bool, parse_timestamp,
                                           to_float, to_int)
from schemaweave.functions.temporal import fill_year, round_half_even, temporal_columns
from schemaweave.functions.text import alnum_key, clean_text, is_ambiguous, tokenize, with_expanded, with_normalized
from schemaweave.operators.catalog import column_profile, profile, validate
from schemaweave.operators.clean import (CleanSpec, clean_source, detect_type, drop_nulls, filter_isin,
                                         route_by_type, select_available)
from schemaweave.operators.dispatch import dispatch
from schemaweave.operators.features import create_features, frequency_encode, group_count, label_encode, standard_scale
from schemaweave.operators.keyed import attach_group_count, first_per_key
from schemaweave.plans.matching import PART_RULES, raw_header, table, written
from schemaweave.session import scratch_path
from schemaweave.sources.readers import open_groups, read_table, scan_manifest
from schemaweave.sources.sinks import load_counts, load_incidents, union_sources

# --- fixed values: how the driver tables map onto the canonical incident schema ---
ORDERS_SPEC = CleanSpec(
    rename={"order_id": "incident_id", "order_date_text": "incident_datetime", "priority_text": "crime_category",
            "segment": "crime_subtype", "status": "location_type", "nation_text": "district", "price_text": "x_coord"},
    candidates={"case_number": ["case_no", "cust"]},
    flag={"arrest_made": (["status"], "F")},
)
EVENTS_SPEC = CleanSpec(
    rename={"event_id_text": "incident_id", "user_text": "case_number", "ts": "incident_datetime",
            "event_type": "crime_category", "value_text": "x_coord"},
)
# expected column sets and type detectors for the driver tables
DRIVER_EXPECTED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_phone"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
}
DRIVER_DETECTORS = [("customer", ["c_custkey", "c_name"]), ("orders", ["o_orderkey", "o_orderdate"]),
                    ("events", ["event_id", "ts"]), ("supplier", ["s_suppkey"])]


def orders_raw(spark: SparkSession, d: str) -> DataFrame:
    """Orders (+ customer segment and nation) rendered as an all-text source."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    return j.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("cust"),
        F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a").alias("order_date_text"),
        F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')).alias("priority_text"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation_text"),
        F.col("o_totalprice").cast("string").alias("price_text"))


def canonical_orders(spark: SparkSession, d: str) -> DataFrame:
    return clean_source(orders_raw(spark, d), ORDERS_SPEC)


def canonical_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    raw = e.select(F.col("event_id").cast("string").alias("event_id_text"),
                   F.col("user_id").cast("string").alias("user_text"), "ts", "event_type",
                   F.col("value").cast("string").alias("value_text"))
    return clean_source(raw, EVENTS_SPEC)


def union_incidents(spark: SparkSession, d: str) -> DataFrame:
    return union_sources({"orders": canonical_orders(spark, d), "events": canonical_events(spark, d)})


def load_twice(spark: SparkSession, d: str) -> DataFrame:
    """S7 + S9: canonical orders and events, some without an id and some repeated,
    loaded twice into one table; per source and load the counts, and the rows that a
    partition-pruned read finds afterwards."""
    path = scratch_path(spark, "incidents")
    out = None
    for source, frame in (("orders", canonical_orders(spark, d)), ("events", canonical_events(spark, d))):
        frame = written(spark, f"canonical-{source}", frame)  # cleaned once: both loads and their counts read it
        batch = frame.withColumn("incident_id", F.when(~F.col("incident_id").endswith("0"), F.col("incident_id")))
        batch = batch.unionByName(batch.where(F.col("incident_id").endswith("3")))
        for load in (1, 2):
            counts = load_counts(batch, load_incidents(batch, path, source))
            counts = counts.select(F.lit(source).alias("dataset_source"), F.lit(load).cast("bigint").alias("load"), "*")
            out = counts if out is None else out.unionByName(counts)
    found = [read_table(spark, path, source=s).groupBy("dataset_source").agg(F.count(F.lit(1)).alias("table_rows")) for s in ("orders", "events")]
    return out.join(found[0].unionByName(found[1]), "dataset_source", "left").withColumn(
        "table_rows", F.coalesce("table_rows", F.lit(0)).cast("bigint"))


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return first_per_key(e, ["user_id", "event_type"], ["ts", "event_id"])


def events_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id",
                    F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"),
                    F.when(F.col("value") <= 50, F.col("value")).alias("value"), "props")


def profile_nulls(spark: SparkSession, d: str) -> DataFrame:
    return profile(events_with_nulls(spark, d))


def validation_results(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, expected in DRIVER_EXPECTED.items():
        df = table(spark, d, name)
        v = validate(df, name, expected, detect_type(df.columns, DRIVER_DETECTORS))
        out = v if out is None else out.unionByName(v)
    return out


def validate_columns(spark: SparkSession, d: str) -> DataFrame:
    """A2 per table, with P12 routing over the column catalog (U1 inside A2)."""
    rows = [(name, c) for name in DRIVER_EXPECTED for c in table(spark, d, name).columns]
    catalog = spark.createDataFrame(rows, "dataset string, column string")
    routed = route_by_type(catalog, detectors=DRIVER_DETECTORS).withColumnRenamed("dataset_type", "routed_type")
    return validation_results(spark, d).join(routed, "dataset", "left")


def process_valid(spark: SparkSession, d: str) -> DataFrame:
    """P14: only valid tables continue; their rows are counted per table."""
    v = validation_results(spark, d).where("is_valid").select("dataset", "row_count")
    return v.select("dataset", F.col("row_count").alias("rows_processed"))


def city_files(spark: SparkSession, d: str) -> str:
    """A folder of city-shaped files from the driver tables: Chicago incidents (orders) in two folders of one
    name, LA arrests (events) as Parquet, a Chicago file without most columns (supplier), a table of unknown
    type (nation) and a broken Parquet file."""
    root = scratch_path(spark, "city-files")
    date = F.date_format(F.col("o_orderdate").cast("timestamp"), "MM/dd/yyyy hh:mm:ss a")
    key = F.col("o_orderkey").cast("string")
    o = table(spark, d, "orders").select(
        key.alias("ID"), F.concat(F.lit("C"), key).alias("Case Number"), date.alias("Date"), F.lit("0 X ST").alias("Block"),
        F.lit("041A").alias("IUCR"), F.col("o_orderpriority").alias("Primary Type"), F.col("o_orderstatus").alias("Description"),
        *[F.lit("1").alias(c) for c in EXPECTED_SCHEMAS["chicago"][7:]])
    o.write.option("header", True).csv(f"{root}/chicago_2001")
    o.where(F.col("Description") == "F").write.option("header", True).csv(f"{root}/archive/chicago_2001")
    e = table(spark, d, "events")
    (e.select(F.col("event_id").cast("string").alias("Report ID"), F.date_format(F.col("ts").cast("timestamp"), "MM/dd/yyyy").alias("Arrest Date"),
              F.date_format(F.col("ts").cast("timestamp"), "HHmm").alias("Time"), F.lit("3").alias("Area ID"), F.lit("North").alias("Area Name"),
              F.col("event_type").alias("Charge Group Description"), F.col("event_type").alias("Charge Description"), F.lit("1 A ST").alias("Address"),
              F.lit("34").alias("LAT"), F.lit("-118").alias("LON"), F.lit("D").alias("Arrest Type Code")).write.parquet(f"{root}/la_arrests"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ID"), F.col("s_name").alias("Case Number"), F.lit("01/01/2020").alias("Date"))
    s.write.option("header", True).csv(f"{root}/partial")
    table(spark, d, "nation").write.option("header", True).csv(f"{root}/other")
    jvm = spark.sparkContext._jvm
    broken = jvm.org.apache.hadoop.fs.Path(f"{root}/broken/x.parquet")
    stream = broken.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(broken)
    stream.writeBytes("no parquet")
    stream.close()
    return root


def dispatch_files(spark: SparkSession, d: str) -> DataFrame:
    """S3 -> P12 -> A2 -> P13 -> W1 over a folder of files: one row per dataset with its status and rows, and
    one per type with the rows that its cleaner kept."""
    files = scan_manifest(spark, city_files(spark, d))
    report, cleaned = dispatch(open_groups(spark, files), CITY_SPECS, EXPECTED_SCHEMAS)
    out = report.select(F.lit("dataset").alias("kind"), F.col("dataset").alias("name"), "dataset_type", "status", "missing_cols", F.col("row_count").alias("n_rows"))
    failed = spark.createDataFrame([("dataset", f.dataset, None, "unreadable", None, None) for f in files if f.error],
                                   "kind string, name string, dataset_type string, status string, missing_cols string, n_rows long")
    out = out.unionByName(failed)
    for kind, rows in cleaned.items():
        n = rows.where(F.col("incident_datetime").isNotNull() & F.col("year").isNotNull()).agg(F.count(F.lit(1)).alias("n_rows"))
        out = out.unionByName(n.select(F.lit("type").alias("kind"), F.lit(kind).alias("name"), F.lit(kind).alias("dataset_type"),
                                       F.lit("cleaned").alias("status"), F.lit(None).cast("string").alias("missing_cols"), "n_rows"))
    return out


def column_profile_q(spark: SparkSession, d: str) -> DataFrame:
    return column_profile(table(spark, d, "customer"), "customer", "c_custkey", max_values=5)


def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    orig = F.concat(raw_header("p_name"), F.lit(" ("), F.col("p_type"), F.lit(") "))
    x = with_normalized(p.withColumn("original_name", orig), "original_name")
    x = attach_group_count(x, ["p_brand", "normalized_column_name"], "_dups")
    return x.select("p_partkey", "original_name", "normalized_column_name", "normalization_steps",
                    alnum_key(F.col("original_name")).alias("alnum_key"),
                    is_ambiguous(F.col("original_name")).alias("flag_ambiguous_or_abbrev"),
                    (F.length("normalized_column_name") == 0).alias("normalized_is_empty"),
                    F.coalesce(F.col("_dups") > 1, F.lit(False)).alias("normalized_is_duplicate"))


def expand_rules(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", "_").alias("normalized_column_name"))
    x = with_expanded(p, "normalized_column_name", rules=PART_RULES)
    return x.select("p_partkey", "normalized_column_name", "expanded_column_name", "abbreviation_rules_applied")


def clean_text_cols(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status_text = (F.when(F.col("o_orderstatus") == "F", F.lit(" Yes"))
                    .when(F.col("o_orderstatus") == "O", F.lit("n")).otherwise(F.lit("maybe")))
    return o.select(
        "o_orderkey",
        parse_bool(status_text).alias("status_bool"),
        to_float(F.col("o_totalprice").cast("string")).alias("price_float"),
        to_int(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("cust_int"),
        to_int(F.col("o_totalprice").cast("string")).alias("price_int"),
        parse_timestamp(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00"))).alias("ts_parsed"),
        clean_text(F.concat(F.lit('\\"'), F.col("o_orderpriority"), F.lit(" – x "))).alias("priority_clean"))


def date_hhmm(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    text = date_plus_hhmm(F.date_format("ts", "MM/dd/yyyy"),
                          (F.hour("ts") * 100 + F.minute("ts")).cast("string"))
    x = e.select("event_id", text.alias("datetime_text"))
    x = x.withColumn("incident_datetime", parse_timestamp(F.col("datetime_text"), ["MM/dd/yyyy HH:mm"]))
    return x.withColumn("year", fill_year(F.lit(None), F.col("incident_datetime")))


def temporal_features_q(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cols = temporal_columns(F.col("ts"))
    return e.select("event_id", *[v.alias(k) for k, v in cols.items()],
                    round_half_even(F.col("value") / 3.0, 2).alias("value_rounded"))


def freq_encode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("event_type"))
                                         .alias("event_type_n"))
    return frequency_encode(e, "event_type_n")


def group_count_q(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type_n"),
        F.hour("ts").alias("hour"))
    return group_count(e, ["event_type_n", "hour"], "type_hour_count")


def label_encode_q(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return label_encode(p, "p_brand", out="brand_code")


def scale_q(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    z = standard_scale(li, ["l_quantity", "l_extendedprice", "l_discount"])
    return z.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(f"z_{c[2:]}") for c in
                                                    ["l_quantity", "l_extendedprice", "l_discount"]])


def project_filter(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    x = select_available(o, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_comment"],
                         target="o_orderpriority")
    x = x.withColumn("o_totalprice", F.when(F.col("o_totalprice") <= 400000, F.col("o_totalprice")))
    x = drop_nulls(x, ["o_totalprice"])
    return filter_isin(x, "o_orderstatus", ["O", "F"])


def flags_to_int(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    flag = flag_from_text(F.col("o_orderpriority"), "URGENT|HIGH")
    return o.select("o_orderkey", flag.cast("int").alias("priority_flag"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("status_is_f"))


# --- fixed values: a reference token set for the overlap query ---
REFERENCE_TOKENS = ["small", "red", "ring"]


def token_sets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name")
    ref = F.array(*[F.lit(t) for t in REFERENCE_TOKENS])
    toks = tokenize(F.col("p_name"))
    return p.select("p_partkey",
                    F.size(F.array_intersect(toks, ref)).cast("bigint").alias("n_shared"),
                    F.size(F.array_union(toks, ref)).cast("bigint").alias("n_union"),
                    F.arrays_overlap(toks, ref).alias("overlaps"),
                    (F.size(F.array_except(toks, ref)) == 0).alias("subset_of_reference"))


def incidents_from_events(spark: SparkSession, d: str) -> DataFrame:
    """Events joined to their customer, laid out as canonical incidents."""
    e = table(spark, d, "events")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    j = e.join(c, e["user_id"] == c["c_custkey"], "left")
    return j.select(
        F.col("event_id").cast("string").alias("incident_id"),
        F.col("ts").alias("incident_datetime"),
        F.col("event_type").alias("crime_category"),
        F.col("c_mktsegment").alias("crime_subtype"),
        F.when(F.col("value") > 250, "high").otherwise("low").alias("location_type"),
        F.concat(F.lit("block "), (F.col("user_id") % 7).cast("string")).alias("block_address"),
        F.col("c_nationkey").cast("bigint").alias("district"),
        (F.col("user_id") % 5).cast("bigint").alias("ward"),
        (F.col("user_id") % 3).cast("bigint").alias("community_area"),
        (F.col("event_type") == "error").alias("domestic_flag"),
        (F.col("value") / 10.0).alias("latitude"),
        (F.col("c_acctbal") / 100.0).alias("longitude"),
        (F.col("value") > 100).alias("arrest_made"))


def features_full(spark: SparkSession, d: str) -> DataFrame:
    f = create_features(incidents_from_events(spark, d))
    return f.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes])

