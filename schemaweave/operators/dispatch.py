"""Validate, route, clean and de-duplicate the datasets of a scanned folder (S3 + P12 + P14).

A scan gives groups: the datasets of one detected type and header, read as one table with
the dataset's name per row.  Validation is one aggregate per group for all of its
datasets; cleaning is one plan per type.  Datasets that are unreadable, of unknown
type, invalid or without a cleaner stay in the report as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweave.operators.clean import CleanSpec, clean_source, deduplicate
from schemaweave.session import scratch_path

DATASET = "_dataset"


@dataclass
class Group:
    """Datasets of one type and header: ``rows`` holds their columns and ``DATASET``."""

    dataset_type: str
    columns: list[str]
    rows: DataFrame


def validate_group(group: Group, expected: Sequence[str], max_null_pct: float = 50.0) -> DataFrame:
    """Validation (A2) of every dataset of a group: one aggregate."""
    cols = group.columns
    n = F.count(F.lit(1))
    frac = [F.count_if(F.col(f"`{c}`").isNull()) / n for c in cols]
    missing, extra = sorted(set(expected) - set(cols)), sorted(set(cols) - set(expected))
    out = group.rows.groupBy(DATASET).agg(n.alias("row_count"), (sum(frac[1:], frac[0]) / len(cols) * 100.0).alias("_null"))
    return out.select(F.col(DATASET).alias("dataset"), F.lit(group.dataset_type).alias("dataset_type"), "row_count",
                      F.lit(len(cols)).cast("bigint").alias("col_count"), F.lit(",".join(missing)).alias("missing_cols"),
                      F.lit(",".join(extra)).alias("extra_cols"), F.round("_null", 2).alias("null_percentage"),
                      (F.lit(not missing) & (F.col("_null") < max_null_pct)).alias("is_valid"))


def _written(facts: DataFrame) -> DataFrame:
    path = scratch_path(facts.sparkSession, "dataset-facts")
    facts.write.parquet(path)
    return facts.sparkSession.read.schema(facts.schema).parquet(path)


def dispatch(groups: Sequence[Group], specs: Mapping[str, CleanSpec], expected: Mapping[str, Sequence[str]],
             null_keys: str = "keep") -> tuple[DataFrame | None, dict[str, DataFrame]]:
    """(report, {type: canonical rows tagged with dataset_source}).

    The report has one row per dataset with its facts and ``status``: processed, invalid,
    unknown (no detector matches) or no_cleaner.  Rows of a type's valid datasets are cleaned
    together and keep the first of each key."""
    report, cleaned = None, {}
    for g in groups:
        facts = validate_group(g, expected.get(g.dataset_type, []))
        status = (F.lit("unknown") if g.dataset_type == "unknown" else
                  F.when(~F.col("is_valid"), "invalid").otherwise("processed" if g.dataset_type in specs else "no_cleaner"))
        facts = _written(facts.withColumn("status", status))  # read by the report and by the choice of rows: scanned once
        report = facts if report is None else report.unionByName(facts)
        if g.dataset_type in specs and not set(expected.get(g.dataset_type, [])) - set(g.columns):
            valid = facts.where(F.col("status") == "processed").select(F.col("dataset").alias(DATASET))
            rows = g.rows.join(F.broadcast(valid), DATASET, "left_semi")  # one row per dataset of the group
            rows = clean_source(rows.select(*[F.col(f"`{c}`") for c in g.columns]), specs[g.dataset_type], null_keys)
            cleaned.setdefault(g.dataset_type, []).append(rows)
    out = {}
    for kind, parts in cleaned.items():
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) > 1:
            spec = specs[kind]
            rows = deduplicate(rows, spec.key_priority, spec.order_by or rows.columns[2:3], null_keys)
        out[kind] = rows.withColumn("dataset_source", F.lit(kind))
    return report, out
