"""Code-book extraction from ordered text items with section headers (W9).

The reference walks the items with a cursor that skips an item once it has
been used as a description.  Here the same result comes from a segmented scan:
items are range-partitioned by (document, position), so a document of any length
spreads over many tasks, and a segment passes on a small composable state: the last
header seen, the length of the run of code-like items it ends with, and its first
item.  The section is the last header before an item, the description is the next
item, and the "consumed" state is the parity of the item's offset inside its run of
code-like items.  A header is never consumed as a description.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweave.constants import SECTION_HEADERS, SECTION_RULES
from schemaweave.operators.keyed import dealt_by_range
from schemaweave.session import scratch_path


def items_from_text(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """Split texts into ordered items: one per non-empty trimmed line."""
    docs = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("_text"))
    lines = docs.select("doc", F.posexplode(F.split(F.col("_text"), "\n")).alias("pos", "raw"))
    item = F.translate(F.regexp_replace(F.col("raw"), r"^\s+|\s+$", ""), "–—", "--")
    return (lines.select("doc", "pos", item.alias("item"))
                 .where((F.col("item") != "") & (F.lower(F.col("item")) != "nan")))


def _by_section(section: Column, rules: Mapping[str, tuple[str, str]], value) -> Column:
    out = F.lit(None)
    for name, rule in rules.items():
        out = F.when(section == name, value(rule)).otherwise(out)
    return out


def _with_segments(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` with their segment's ``state``; a null document is one like any other."""
    renamed = state.withColumnsRenamed({"doc": "_d", "_pid": "_p"})
    return rows.join(renamed, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("_pid") == F.col("_p"))).drop("_d", "_p")


def extract_sections(items: DataFrame, headers: Mapping[str, str] = SECTION_HEADERS,
                     rules: Mapping[str, tuple[str, str]] = SECTION_RULES,
                     default_section: str = "radio_codes") -> DataFrame:
    """(section, code, description), distinct.  ``items``: (doc, pos, item), pos unique in its document."""
    spark = items.sparkSession
    hdr = F.create_map(*[F.lit(x) for kv in headers.items() for x in kv])
    dealt = dealt_by_range(items.select("doc", "pos", "item", F.try_element_at(hdr, F.col("item")).alias("_hdr")), ["doc", "pos"])
    own = Window.partitionBy("doc", "_pid").orderBy("pos")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    segments = Window.partitionBy("doc").orderBy("_pid")  # one row per document and partition
    before = segments.rowsBetween(Window.unboundedPreceding, -1)

    # the section: the last header here, else the last one of an earlier segment
    last = dealt.groupBy("doc", "_pid").agg(F.max_by("_hdr", F.when(F.col("_hdr").isNotNull(), F.col("pos"))).alias("_lh"))
    carried = last.select("doc", "_pid", F.last("_lh", ignorenulls=True).over(before).alias("_carry"))
    x = _with_segments(dealt, carried)
    x = x.withColumn("section", F.coalesce(F.last("_hdr", ignorenulls=True).over(so_far), "_carry", F.lit(default_section)))
    x = x.withColumn("_is_hdr", F.col("_hdr").isNotNull())

    def full(pattern: str, col: Column) -> Column:
        return col.rlike(f"^(?:{pattern})$")

    code_like = _by_section(F.col("section"), rules, lambda r: full(r[1], F.col("item")) if r[0] != "inline" else F.lit(False))
    x = x.withColumn("_m", F.coalesce(code_like, F.lit(False)) & ~F.col("_is_hdr")).withColumn("_idx", F.row_number().over(own))
    path = scratch_path(spark, "section-items")
    x.select("doc", "_pid", "pos", "item", "section", "_is_hdr", "_m", "_idx").write.parquet(path)
    x = spark.read.parquet(path)

    # the run of code-like items before the segment: a segment of such items alone lengthens it
    state = x.groupBy("doc", "_pid").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.max(F.when(~F.col("_m"), F.col("_idx"))), F.lit(0)).alias("_break"),
        F.min_by(F.struct("item", "_is_hdr", "_m"), "pos").alias("_first"))
    state = state.withColumn("_upto", F.sum("_n").over(segments.rowsBetween(Window.unboundedPreceding, 0)))
    tail = F.last(F.when(F.col("_break") > 0, F.struct((F.col("_n") - F.col("_break")).alias("run"), F.col("_upto").alias("at"))), ignorenulls=True).over(before)
    state = state.select("doc", "_pid", (F.coalesce(F.lag("_upto").over(segments), F.lit(0)) - F.coalesce(tail["at"], F.lit(0))
                                         + F.coalesce(tail["run"], F.lit(0))).alias("_run_in"), F.lead("_first").over(segments).alias("_after"))
    x = _with_segments(x, state)
    following = F.lead(F.struct("item", "_is_hdr", "_m")).over(own)
    x = x.withColumn("_f", F.coalesce(following, "_after"))
    since = F.last(F.when(~F.col("_m"), F.col("_idx")), ignorenulls=True).over(so_far)  # the last item that is not code-like
    # offset in the run: from that item on, or from the segments before
    offset = F.when(since.isNull(), F.col("_run_in") + F.col("_idx") - 1).otherwise(F.col("_idx") - since - 1)
    x = x.withColumn("_even", offset % 2 == 0)
    has_next = F.col("_f").isNotNull() & ~F.col("_f._is_hdr")
    mode = _by_section(F.col("section"), rules, lambda r: F.lit(r[0]))
    paired = (F.when(mode == "next_not_code", F.col("_m") & has_next & ~F.col("_f._m"))
               .when(mode == "pair", F.col("_m") & F.col("_even") & has_next)
               .otherwise(F.lit(False)))
    entry = F.when(paired, F.struct(F.col("item").alias("code"), F.col("_f.item").alias("description")))
    for name, (kind, pattern) in rules.items():
        if kind == "inline":  # each inline section splits its items by a pattern of its own
            entry = entry.when((F.col("section") == name) & ~F.col("_is_hdr") & F.col("item").rlike(pattern),
                               F.struct(F.regexp_extract("item", pattern, 1).alias("code"), F.regexp_extract("item", pattern, 2).alias("description")))
    out = x.select("section", entry.alias("_e")).where(F.col("_e").isNotNull())
    return out.select("section", "_e.code", "_e.description").distinct()
