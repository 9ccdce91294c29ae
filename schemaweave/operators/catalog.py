"""Column catalogs: profiles, validation, sample values, metadata descriptions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaweave.functions.text import alnum_key, is_ambiguous, normalize_name, strip_ws
from schemaweave.operators.keyed import attach_group_count
from schemaweave.session import ship_package


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# --- A1 ----------------------------------------------------------------------------
def profile(df: DataFrame) -> DataFrame:
    """(column, dtype, null_pct, n_rows, n_cols): one aggregate pass for all columns."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(_q(c).isNull()).alias(f"_z{i}") for i, c in enumerate(cols)])
    dtypes = dict(df.dtypes)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                                 F.col(f"_z{i}").alias("nulls")) for i, c in enumerate(cols)])
    return (agg.select("_n", F.inline(entries))
            .select("column", "dtype",
                    F.when(F.col("_n") > 0, F.round(F.col("nulls") * 100.0 / F.col("_n"), 2))
                     .otherwise(F.lit(None).cast("double")).alias("null_pct"),
                    F.col("_n").cast("bigint").alias("n_rows"),
                    F.lit(len(cols)).cast("bigint").alias("n_cols")))


# --- A2, U1 -----------------------------------------------------------------------
def validate(df: DataFrame, dataset: str, expected: Sequence[str], dataset_type: str = "unknown",
             max_null_pct: float = 50.0) -> DataFrame:
    """One row: counts, missing/extra columns, mean null % over columns, is_valid."""
    cols = df.columns
    n = F.count(F.lit(1))
    frac = [F.try_divide(F.count_if(_q(c).isNull()), n) for c in cols]  # null for an empty table
    mean_null = (sum(frac[1:], frac[0]) / len(cols) * 100.0) if cols else F.lit(None)
    exp = F.array(*[F.lit(c) for c in expected]) if expected else F.array().cast("array<string>")
    act = F.array(*[F.lit(c) for c in cols]) if cols else F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(exp, act))
    extra = F.array_sort(F.array_except(act, exp))
    out = df.agg(n.alias("row_count"), mean_null.alias("_null"))
    return out.select(
        F.lit(dataset).alias("dataset"), F.lit(dataset_type).alias("dataset_type"),
        F.col("row_count").cast("bigint").alias("row_count"),
        F.lit(len(cols)).cast("bigint").alias("col_count"),
        F.array_join(missing, ",").alias("missing_cols"),
        F.array_join(extra, ",").alias("extra_cols"),
        F.round("_null", 2).alias("null_percentage"),
        ((F.size(missing) == 0) & F.coalesce(F.col("_null") < max_null_pct, F.lit(False))).alias("is_valid"),
    )


def column_subset_check(columns: Column, required: Sequence[str]) -> Column:
    """U2: required set is a subset of an array-of-names column."""
    return F.size(F.array_except(F.array(*[F.lit(r) for r in required]), columns)) == 0


# --- A3 ----------------------------------------------------------------------------
def first_values(state: dict, pos: np.ndarray, values: np.ndarray, n: int) -> dict:
    """The mergeable state of a column: its ``n`` distinct values of smallest position, as {value: position}.

    A value that ``n`` others precede here cannot be among the first ``n`` of all rows, so states of
    parts of a table merge into that of the whole."""
    if len(state) >= n:  # only rows before the last of the first n can change it
        early = pos <= max(state.values())
        pos, values = pos[early], values[early]
    order = np.argsort(pos, kind="stable")
    seen, fresh, last = dict(state), set(), None
    for p, v in zip(pos[order].tolist(), values[order].tolist()):
        if last is not None and p > last:  # n distinct values lie before this row
            break
        if v not in seen or p < seen[v]:
            seen[v] = p
        fresh.add(v)
        if len(fresh) >= n:
            last = p
    return dict(sorted(seen.items(), key=lambda x: (x[1], x[0]))[:n])


def column_profile(df: DataFrame, dataset: str, order_by: str, max_values: int = 5,
                   show: int = 20) -> DataFrame:
    """Per column: dtype, non-null ratio (6 dp), first ``max_values`` distinct
    trimmed non-empty values in ``order_by`` order joined by ' | ' (equal positions by value).

    One scan: every task folds its rows into counts and a bounded state per column (see
    :func:`first_values`), so a task gives at most ``max_values`` rows a column to the shuffle,
    whatever the number of distinct values.  ``order_by`` is an integer, date or timestamp column."""
    n, cols, dtypes = min(max_values, show), df.columns, dict(df.dtypes)
    ship_package(df.sparkSession)
    position = F.col(f"`{order_by}`")
    kind = dtypes[order_by]
    if kind.startswith("timestamp"):
        position = F.unix_micros(position.cast("timestamp"))
    elif kind == "date":
        position = F.unix_date(position)
    cells = df.select(F.coalesce(position.cast("long"), F.lit(-2 ** 63)).alias("_pos"),
                      *[strip_ws(_q(c).cast("string")).alias(f"c{i}") for i, c in enumerate(cols)],
                      *[_q(c).isNotNull().alias(f"n{i}") for i, c in enumerate(cols)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, filled, states = 0, [0] * len(cols), [{} for _ in cols]
        for batch in batches:
            pos = batch.column("_pos").to_numpy(zero_copy_only=False)
            rows += batch.num_rows
            for i in range(len(cols)):
                filled[i] += pc.sum(batch.column(f"n{i}")).as_py() or 0
                text = batch.column(f"c{i}")
                there = pc.fill_null(pc.not_equal(text, ""), False).to_numpy(zero_copy_only=False)
                if n and len(states[i]) >= n:
                    there &= pos <= max(states[i].values())
                if there.any():
                    states[i] = first_values(states[i], pos[there], text.filter(pa.array(there)).to_numpy(zero_copy_only=False), n)
        out = [(i, None, None, rows, filled[i]) for i in range(len(cols))]
        out += [(i, v, p, 0, 0) for i in range(len(cols)) for v, p in states[i].items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                         names=["i", "value", "pos", "n", "filled"])

    parts = cells.mapInArrow(fold, "i int, value string, pos long, n long, filled long")
    folded = parts.groupBy("i", "value").agg(F.min("pos").alias("pos"), F.sum("n").alias("n"), F.sum("filled").alias("filled"))
    # per column at most n values a task, and one row of counts
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("pos", "value")))), 1, n)
    per = folded.groupBy("i").agg(F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.array_join(F.transform(first, lambda s: s["value"]), " | ").alias("sample_values"))
    named = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype")) for i, c in enumerate(cols)])
    listed = df.sparkSession.range(1).select(F.inline(named))
    return listed.join(per, "i", "left").select(
        F.lit(dataset).alias("dataset"), "column", "dtype",
        F.when(F.col("n") > 0, F.round(F.col("filled") / F.col("n"), 6)).otherwise(F.lit(0.0)).alias("non_null_ratio"),
        F.coalesce("sample_values", F.lit("")).alias("sample_values"))


# --- N2 + W2 on a catalog ------------------------------------------------------------
def normalize_catalog(catalog: DataFrame, name_col: str, group_cols: Sequence[str]) -> DataFrame:
    """Add normalized name, step trace, empty and duplicate flags (duplicates: all members)."""
    norm, steps = normalize_name(F.col(name_col))
    out = catalog.withColumns({"normalized_column_name": norm, "normalization_steps": steps})
    out = attach_group_count(out, [*group_cols, "normalized_column_name"], "_dup_n")
    return (out.withColumn("normalized_is_empty", F.length("normalized_column_name") == 0)
               .withColumn("normalized_is_duplicate", F.coalesce(F.col("_dup_n") > 1, F.lit(False)))
               .drop("_dup_n"))


def ambiguity_flags(name_col: str) -> dict[str, Column]:
    return {"flag_ambiguous_or_abbrev": is_ambiguous(F.col(name_col)),
            "alnum_key": alnum_key(F.col(name_col))}


# --- S5 core: descriptions from parsed metadata JSON ---------------------------------
METADATA_COLUMN = T.StructType([
    T.StructField("fieldName", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("field_name", T.StringType()), T.StructField("columnName", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("fieldDescription", T.StringType()),
    T.StructField("desc", T.StringType()),
])
METADATA_SCHEMA = T.StructType([
    T.StructField("columns", T.ArrayType(METADATA_COLUMN)),
    T.StructField("meta", T.StructType([T.StructField("view", T.StructType([
        T.StructField("columns", T.ArrayType(METADATA_COLUMN))]))])),
])


def _first_nonempty(*cs: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cs])


def metadata_descriptions(parsed: DataFrame, doc_col: str, order_col: str,
                          group_cols: Sequence[str] = ()) -> DataFrame:
    """(key, description) from documents shaped either ``{columns: [...]}`` or
    ``{meta: {view: {columns: [...]}}}``.  First non-empty name/description
    field wins; blank descriptions are dropped; the last document (by
    ``order_col``, then array position) wins per key.
    """
    doc = F.col(doc_col)
    cols = F.when(doc["columns"].isNotNull(), doc["columns"]).otherwise(doc["meta"]["view"]["columns"])
    entries = parsed.select(*group_cols, F.col(order_col).alias("_ord"),
                            F.posexplode(cols).alias("_pos", "_c"))
    c = F.col("_c")
    name = _first_nonempty(c["fieldName"], c["name"], c["field_name"], c["columnName"])
    desc = strip_ws(_first_nonempty(c["description"], c["fieldDescription"], c["desc"]))
    keyed = (entries.select(*group_cols, "_ord", "_pos", alnum_key(strip_ws(name)).alias("key"),
                            desc.alias("description"))
             .where(F.col("key").isNotNull() & F.col("description").isNotNull() & (F.col("description") != "")))
    last = keyed.groupBy(*group_cols, "key").agg(F.max(F.struct("_ord", "_pos", "description")).alias("_l"))
    return last.select(*group_cols, "key", F.col("_l.description").alias("description"))


# --- J4 ----------------------------------------------------------------------------
def attach_metadata(catalog: DataFrame, descriptions: DataFrame, name_col: str,
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Left lookup by alphanumeric key; '' and a flag when there is no description."""
    keyed = catalog.withColumn("_key", alnum_key(strip_ws(F.col(name_col))))
    d = descriptions.withColumnRenamed("key", "_key")
    joined = keyed.join(d, [*group_cols, "_key"], "left")
    return (joined.withColumn("has_metadata_description", F.col("description").isNotNull())
                  .withColumn("metadata_description", F.coalesce("description", F.lit("")))
                  .drop("_key", "description"))
