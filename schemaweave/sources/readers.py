"""File sources: robust CSV, delimiter sniffing, directory scans, registry, metadata JSON."""

from __future__ import annotations

import csv
import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaweave.constants import TYPE_DETECTORS
from schemaweave.operators.catalog import METADATA_SCHEMA, metadata_descriptions
from schemaweave.operators.clean import detect_type, drop_index_artifacts
from schemaweave.operators.dispatch import DATASET, Group

log = logging.getLogger(__name__)


# --- S1 --------------------------------------------------------------------------------
RAW = "_raw_record"


def ragged_reader(reader, schema: T.StructType, multi_line: bool = False):
    """A CSV reader that keeps the raw text of rows whose cells do not fit ``schema``, in a column ``RAW``."""
    wide = T.StructType([*schema.fields, T.StructField(RAW, T.StringType())])
    return (reader.schema(wide).option("header", True).option("quote", '"').option("escape", "\\")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).option("multiLine", multi_line)
            .option("columnPruning", False))  # cells are counted, so every row is split whole


def without_over_long(df: DataFrame, width: int | None = None) -> DataFrame:
    """Drop rows with more cells than columns (the first ``width`` ones); short rows stay, padded with null."""
    cols = [c for c in df.columns if c != RAW][:width]
    cells = F.regexp_count(F.regexp_replace(RAW, r'"(?:\\.|[^"\\])*"', ""), F.lit(",")) + 1
    short = F.col(f"`{cols[-1]}`").isNull() & (cells < len(cols))
    return df.where(F.col(RAW).isNull() | short).drop(RAW)


def read_csv_robust(spark: SparkSession, path: str, limit: int | None = None, multi_line: bool = False) -> DataFrame:
    """All-string CSV: '"' quote, '\\' escape; rows shorter than the header are
    padded with null, only longer ones are skipped; optional row cap.

    ``multi_line`` reads quoted line breaks (a file is then one task).  The rows
    are the same whatever columns are selected or counted."""
    names = spark.read.option("header", True).option("quote", '"').option("escape", "\\").option("multiLine", multi_line).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    df = without_over_long(ragged_reader(spark.read, schema, multi_line).csv(path))
    return df.limit(limit) if limit else df


# --- S2 --------------------------------------------------------------------------------
def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Comma first; a header without any comma means ';' (header line only is read)."""
    first = spark.read.text(path).limit(1).collect()
    header = first[0][0] if first else ""
    return "," if "," in header or ";" not in header else ";"


def read_csv_sniff(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", sniff_delimiter(spark, path)).csv(path)


# --- S3 --------------------------------------------------------------------------------
def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length) of data files under ``root``; contents are never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(root).select("path", "length"))


@dataclass
class SourceFile:
    """A discovered file: its dataset (folder under the root, or the stem of a file in the root itself),
    format and header; ``error`` says why it cannot be read."""

    path: str
    dataset: str
    format: str
    columns: list[str] | None
    error: str | None


def _csv_header(spark: SparkSession, path: str) -> list[str]:
    """The first line's cells; only the head of the file is read."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    if not line:
        raise ValueError("no header")
    return next(csv.reader([line.removeprefix("\ufeff")], escapechar="\\"))


def scan_manifest(spark: SparkSession, root: str, globs: Sequence[str] = ("*.csv", "*.parquet")) -> list[SourceFile]:
    """Every data file under ``root`` with its header, by path; files that cannot be read stay, with the error.

    The driver sees one entry and one header per file, no rows.  Files without a byte are not listed."""
    out = []
    for g in globs:
        for row in list_files(spark, root, g).select("path").collect():
            path = row["path"]
            inner = path.split(root.rstrip("/").split(":", 1)[-1].lstrip("/"), 1)[-1].lstrip("/")
            folder, _, name = inner.rpartition("/")
            columns, error, kind = None, None, "csv" if name.endswith(".csv") else "parquet"
            try:
                columns = _csv_header(spark, path) if kind == "csv" else spark.read.parquet(path).columns
            except Exception as e:  # noqa: BLE001 - one bad file leaves the others readable; the error is kept
                error = f"{type(e).__name__}: {e}"[:300]
                log.warning("%s cannot be read: %s", path, error)
            out.append(SourceFile(path, folder or name.rpartition(".")[0], kind, columns, error))
    return sorted(out, key=lambda f: f.path)


def open_groups(spark: SparkSession, files: Sequence[SourceFile], detectors=TYPE_DETECTORS) -> list[Group]:
    """The readable files, one scan per detected type, format and header, with the dataset of every row."""
    by: dict[tuple, list[SourceFile]] = {}
    for f in files:
        if f.error is None and f.columns:
            by.setdefault((detect_type(f.columns, detectors), f.format, tuple(f.columns)), []).append(f)
    groups = []
    for (kind, fmt, columns), members in sorted(by.items()):
        paths = [f.path for f in members]
        names = spark.createDataFrame([(f.path, f.dataset) for f in members], "_path string, _dataset string")
        if fmt == "csv":
            schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
            rows = ragged_reader(spark.read, schema).csv(paths).select("*", F.col("_metadata.file_path").alias("_path"))
            rows = without_over_long(rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in (RAW, "_path")], "_path", RAW), len(columns))
        else:
            rows = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("_path"))
        # scheme and slashes differ between listing and scan ("file:/" and "file:///"); no regex, as it is done per row
        plain = F.expr("ltrim('/', substring(_path, locate(':/', _path) + 1))")
        names = names.select(plain.alias("_p"), "_dataset")
        rows = rows.withColumn("_p", plain).join(F.broadcast(names), "_p").drop("_p", "_path")  # one row per file
        rows = drop_index_artifacts(rows)
        groups.append(Group(kind, [c for c in rows.columns if c != DATASET], rows))
    return groups


def scan_directory(spark: SparkSession, root: str, globs: Sequence[str] = ("*.csv", "*.parquet"),
                   limit: int | None = None) -> dict[str, DataFrame]:
    """One lazily read table per discovered dataset (folder under ``root``, or stem in it) and header; a
    dataset with several formats or headers gets a number from its second one on.  Unreadable files are logged."""
    out: dict[str, DataFrame] = {}
    for g in open_groups(spark, scan_manifest(spark, root, globs)):
        for r in g.rows.select(DATASET).distinct().orderBy(DATASET).collect():
            df = g.rows.where(F.col(DATASET) == r[0]).drop(DATASET)
            name, n = r[0], 2
            while name in out:
                name, n = f"{r[0]}#{n}", n + 1
            out[name] = df.limit(limit) if limit else df
    return out


def scan_with_provenance(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """All matching files as one scan, schemas merged, file name kept per row."""
    df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
          .option("mergeSchema", "true").parquet(root))
    return drop_index_artifacts(df).select("*", F.col("_metadata.file_name").alias("source_file"))


# --- S4 --------------------------------------------------------------------------------
def dataset_registry(spark: SparkSession, config: DataFrame, root: str) -> DataFrame:
    """Per configured (dataset_key, city, csv_file): exists, size MB (2 dp),
    number of columns (header only), has-metadata flag.  Missing -> False + nulls."""
    files = list_files(spark, root).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("csv_file"), "path", "length")
    meta = files.where(F.col("csv_file").endswith(".json")).select(
        F.regexp_replace("csv_file", r"(_metadata)?\.json$", "").alias("_stem"))
    reg = config.join(files, "csv_file", "left")
    widths = []
    for r in reg.where(F.col("path").isNotNull()).select("csv_file", "path").collect():
        p = r["path"]
        cols = (spark.read.parquet(p).columns if p.endswith(".parquet")
                else read_csv_robust(spark, p).columns)
        widths.append((r["csv_file"], len(cols)))
    wdf = spark.createDataFrame(widths, "csv_file string, num_columns bigint")
    out = (reg.join(wdf, "csv_file", "left")
              .withColumn("_stem", F.regexp_replace("csv_file", r"\.[^.]+$", ""))
              .join(meta.withColumn("has_metadata_json", F.lit(True)), "_stem", "left"))
    return out.select(
        "dataset_key", "city", "csv_file", F.col("path").isNotNull().alias("file_exists"),
        F.round(F.col("length") / (1024.0 * 1024.0), 2).alias("file_size_mb"),
        F.col("num_columns").cast("bigint").alias("num_columns"),
        F.coalesce("has_metadata_json", F.lit(False)).alias("has_metadata_json"))


# --- S5 --------------------------------------------------------------------------------
def read_column_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(key, description) from metadata JSON files of either shape; a bad or
    missing file gives an empty result."""
    try:
        raw = spark.read.schema(METADATA_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except Exception:  # noqa: BLE001
        return spark.createDataFrame([], "key string, description string")
    parsed = raw.select(F.struct(*raw.columns).alias("doc"), F.col("_metadata.file_path").alias("_file"))
    return metadata_descriptions(parsed, "doc", "_file")


# --- S9 --------------------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, limit: int | None = None,
               source: str | None = None) -> DataFrame:
    """A written canonical table; ``source`` prunes the dataset_source partition."""
    df = spark.read.parquet(path)
    if source is not None:
        df = df.where(F.col("dataset_source") == source)
    return df.limit(limit) if limit else df
