"""Scores of all column pairs without the table of all pairs.

A pair's scores depend on the two columns' texts alone, and most pairs share no term,
so they score 0 in every method.  The catalog's columns are reduced to their distinct
texts (name and description) with the number of columns; texts meet over posting
lists (term -> texts), which gives exactly the text pairs with a score or label
other than 0, each with its inner products; and the number of column pairs that a text
pair stands for follows from group sizes.  What is left over is counted, not listed:
``zero_rows`` are a handful of weighted rows that stand for all other pairs.

Metric tables read the weighted text pairs and the zero rows (``weight`` of the
operators in :mod:`evaluate`).  Ranked views expand only the text pairs they need into
columns, and fill up with pairs of score 0 in key order where there are too few.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweave.constants import PAIR_KEY
from schemaweave.functions.classify import classify_column
from schemaweave.functions.text import context_text, tokenize
from schemaweave.operators.keyed import ranked_by_group
from schemaweave.operators.pairs import last_descriptions, paired_columns
from schemaweave.operators.similarity import tfidf_postings

SCORES = ["lexical_jaccard", "embedding_header_only_cosine", "embedding_header_context_cosine"]
Write = Callable[[str, DataFrame], DataFrame]  # writes a table under a name and reads it back


@dataclass
class SparseScores:
    """columns: city, ord, column_original, column_final, u (its text); texts: u, column_final, description;
    sizes: city, ord, n; pairs: u <= v with scores, exact_match, is_match and n, the number of column pairs of
    different cities with these texts; total: number of all such pairs."""

    columns: DataFrame
    texts: DataFrame
    sizes: DataFrame
    pairs: DataFrame
    total: int
    write: Write
    _ranked: DataFrame | None = None

    def ranked(self) -> DataFrame:
        """columns with rank, 0-based by name within the city; written when first asked for."""
        if self._ranked is None:
            order = F.struct("column_final", "column_original", F.monotonically_increasing_id().alias("i"))
            self._ranked = self.write("sparse_ranked", ranked_by_group(self.columns.withColumn("_k", order), ["city"], "_k", "rank").drop("_k"))
        return self._ranked


def catalog_columns(catalog: DataFrame, write: Write) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, texts, sizes) of a catalog; equal to the pair operators in names, descriptions and order."""
    last = last_descriptions(catalog).withColumnsRenamed({"city": "_c", "column_final": "_f", "description": "_d"})
    sizes = catalog.groupBy("city").agg(F.min("ds_order").alias("ord"), F.count(F.lit(1)).alias("n"))
    named = catalog.join(last, F.col("city").eqNullSafe(F.col("_c")) & F.col("column_final").eqNullSafe(F.col("_f")), "left").select(
        "city", "column_original", "column_final", F.coalesce("_d", F.lit("")).alias("description"))
    texts = write("sparse_texts", named.select("column_final", "description").distinct().withColumn("u", F.monotonically_increasing_id()))
    key = texts.withColumnsRenamed({"column_final": "_f", "description": "_d"})
    columns = (named.join(key, F.col("column_final").eqNullSafe(F.col("_f")) & (F.col("description") == F.col("_d")))
               .join(sizes.select("city", "ord"), "city").select("city", "ord", "column_original", "column_final", "u"))
    return write("sparse_columns", columns), texts, sizes


def _postings(columns: DataFrame, texts: DataFrame, sizes: DataFrame, total: int, max_features: int) -> DataFrame:
    """(kind, term, u, w): tokens, both TF-IDF spaces, and equal names and descriptions."""
    # a column is a side of as many pairs as there are columns in the other datasets
    occ = (columns.join(sizes.select("city", "n"), "city").groupBy("u").agg(F.sum(F.lit(total) - F.col("n")).alias("occ")))
    t = texts.join(occ, "u").withColumn("context", context_text(F.col("column_final"), F.col("description")))
    kind = lambda name, value, as_: F.struct(F.lit(name).alias("kind"), value.alias(as_))
    spaces = t.select("u", "occ", F.inline(F.array(kind("header", F.col("column_final"), "text"), kind("context", F.col("context"), "text"))))
    plain = t.select("u", F.inline(F.concat(
        F.transform(tokenize(F.coalesce("column_final", F.lit(""))), lambda x: kind("token", x, "term")),
        F.array(kind("name", F.col("column_final"), "term"), kind("description", F.col("description"), "term")))))
    return plain.select("kind", "term", "u", F.lit(1.0).alias("w")).union(tfidf_postings(spaces, ["kind"], "u", max_features).select("kind", "term", "u", "w"))


def sparse_scores(catalog: DataFrame, write: Write, max_features: int = 100, digits: int = 9) -> SparseScores:
    """Every text pair with a score or label other than 0 (see the module)."""
    columns, texts, sizes = catalog_columns(catalog, write)
    n, squares = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()
    posts = write("sparse_postings", _postings(columns, texts, sizes, n, max_features))
    a, b = posts.alias("a"), posts.alias("b")
    of = lambda kind, x: F.sum(F.when(F.col("a.kind") == kind, x).otherwise(0.0))
    met = (a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.u") <= F.col("b.u")))
           .groupBy(F.col("a.u").alias("u"), F.col("b.u").alias("v"))
           .agg(of("token", F.lit(1.0)).alias("shared"), F.max((F.col("a.kind") == "name").cast("int")).alias("exact_match"),
                F.max((F.col("a.kind") == "description").cast("int")).alias("is_match"),
                of("header", F.col("a.w") * F.col("b.w")).alias("header"), of("context", F.col("a.w") * F.col("b.w")).alias("context")))
    # column pairs of a text pair: all, less those inside one city
    held = columns.groupBy("u", "city").agg(F.count(F.lit(1)).alias("k"))
    one, two = held.withColumnsRenamed({"k": "ku"}), held.withColumnsRenamed({"u": "v", "k": "kv"})
    inside = (met.select("u", "v").join(one, "u").join(two, ["v", "city"]).groupBy("u", "v")
              .agg(F.sum(F.col("ku") * F.col("kv")).alias("inside")))
    side = (columns.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
            .join(texts.select("u", F.col("column_final").alias("final"), F.size(tokenize("column_final")).alias("m")), "u"))
    left = side.select("u", F.col("k").alias("nu"), F.col("m").alias("mu"), F.col("final").alias("u_final"))
    right = side.select(F.col("u").alias("v"), F.col("k").alias("nv"), F.col("m").alias("mv"), F.col("final").alias("v_final"))
    j = met.join(inside, ["u", "v"], "left").withColumn("inside", F.coalesce("inside", F.lit(0))).join(left, "u").join(right, "v")
    pairs_n = F.when(F.col("u") == F.col("v"), F.expr("(nu * nu - inside) div 2")).otherwise(F.col("nu") * F.col("nv") - F.col("inside"))
    union = F.col("mu") + F.col("mv") - F.col("shared")
    lexical = F.when(F.col("shared") > 0, F.col("shared") / union).otherwise(0.0)
    pairs = j.select("u", "v", "u_final", "v_final", F.round(lexical, digits).alias(SCORES[0]), F.round("header", digits).alias(SCORES[1]),
                     F.round("context", digits).alias(SCORES[2]), "exact_match", "is_match", pairs_n.alias("n"),
                     _type_of(F.col("u_final"), F.col("v_final")).alias("column_type"))
    return SparseScores(columns, texts, sizes, write("sparse_pairs", pairs.where("n > 0")), (n * n - squares) // 2, write)


def _type_of(a: Column, b: Column) -> Column:
    return F.when(classify_column(a) == classify_column(b), classify_column(a)).otherwise(F.lit("mixed"))


def zero_rows(s: SparseScores) -> DataFrame:
    """column_type, n: the column pairs that ``pairs`` does not list, whose scores and label are 0; one row per type."""
    typed = s.columns.select("city", classify_column(F.col("column_final")).alias("t"))
    by_city = typed.groupBy("city", "t").agg(F.count(F.lit(1)).alias("k"))
    # a city's row holds at most one count per type
    per = by_city.groupBy("city").agg(F.collect_list(F.struct("t", "k")).alias("x"))
    inside = (per.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b"))
              .groupBy(F.col("a.t").alias("a"), F.col("b.t").alias("b")).agg(F.sum(F.col("a.k") * F.col("b.k")).alias("inside")))
    of = by_city.groupBy("t").agg(F.sum("k").alias("k")).agg(F.collect_list(F.struct("t", "k")).alias("x"))
    whole = (of.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b"))
             .select(F.col("a.t").alias("a"), F.col("b.t").alias("b"), (F.col("a.k") * F.col("b.k")).alias("all")))
    kind = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit("mixed"))
    ordered = whole.join(inside, ["a", "b"], "left").groupBy(kind.alias("column_type")).agg(
        (F.sum(F.col("all") - F.coalesce("inside", F.lit(0))) / 2).cast("long").alias("all"))
    listed = s.pairs.groupBy("column_type").agg(F.sum("n").alias("listed"))
    return (ordered.join(listed, "column_type", "left").select("column_type", (F.col("all") - F.coalesce("listed", F.lit(0))).alias("n")).where("n > 0"))


def weighted_pairs(s: SparseScores) -> DataFrame:
    """Scores, is_match, column_type and n: text pairs and zero rows, together all column pairs."""
    cols = [*SCORES, "is_match", "column_type", "u_final", "v_final", "n"]
    zero = zero_rows(s).select(*[F.lit(0.0).alias(c) for c in SCORES], F.lit(0).alias("is_match"), "column_type",
                               F.lit(None).cast("string").alias("u_final"), F.lit(None).cast("string").alias("v_final"), "n")
    return s.pairs.select(*cols).unionByName(zero)


# --- expansion into columns ------------------------------------------------------------------
def expand(s: SparseScores, pairs: DataFrame) -> DataFrame:
    """The column pairs of text pairs, each once with the earlier dataset on the left: key and the
    columns of ``pairs``."""
    extra = [c for c in pairs.columns if c not in ("u", "v", "u_final", "v_final")]
    back = pairs.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), *extra)
    both = pairs.select("u", "v", *extra).union(back)
    left = s.columns.select("u", F.col("city").alias("left_city"), F.col("ord").alias("_lo"), F.col("column_final").alias("left_column_final"))
    right = s.columns.select(F.col("u").alias("v"), F.col("city").alias("right_city"), F.col("ord").alias("_ro"),
                             F.col("column_final").alias("right_column_final"))
    before = (F.col("_lo") < F.col("_ro")) | ((F.col("_lo") == F.col("_ro")) & (F.col("left_city") < F.col("right_city")))
    return both.join(left, "u").join(right, "v").where(before).select(*PAIR_KEY, *extra)


def _grids(s: SparseScores) -> DataFrame:
    """Every two datasets once with the number of their column pairs (the configuration's size)."""
    listed = s.sizes.agg(F.array_sort(F.collect_list(F.struct("ord", "city", "n"))).alias("ds"))
    left = listed.select("ds", F.posexplode("ds").alias("i", "l"))
    return (left.select("l", F.explode(F.expr("slice(ds, i + 2, size(ds))")).alias("r"))
            .select(F.col("l.city").alias("left_city"), F.col("r.city").alias("right_city"), F.col("r.n").alias("width"),
                    (F.col("l.n") * F.col("r.n")).alias("cells")))


def _cells(s: SparseScores, grids: DataFrame) -> DataFrame:
    """The first ``take`` column pairs in key order of every dataset pair of ``grids``."""
    at = grids.where("take > 0").select("left_city", "right_city", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)).alias("i"))
    at = at.select("left_city", "right_city", F.expr("i div width").alias("_lr"), (F.col("i") % F.col("width")).alias("_rr"))
    columns = s.ranked()
    left = columns.select(F.col("city").alias("left_city"), F.col("rank").alias("_lr"), F.col("column_final").alias("left_column_final"), F.col("u").alias("_lu"))
    right = columns.select(F.col("city").alias("right_city"), F.col("rank").alias("_rr"), F.col("column_final").alias("right_column_final"), F.col("u").alias("_ru"))
    return at.join(left, ["left_city", "_lr"]).join(right, ["right_city", "_rr"])


def _scored(s: SparseScores, cells: DataFrame) -> DataFrame:
    """Column pairs (with _lu, _ru) with their scores, exact match and label; pairs that are not listed have 0."""
    extra = [*SCORES, "exact_match", "is_match"]
    p = s.pairs.select("u", "v", *extra)
    j = cells.join(p, (F.least("_lu", "_ru") == F.col("u")) & (F.greatest("_lu", "_ru") == F.col("v")), "left")
    return j.select(*[c for c in cells.columns if c not in ("_lu", "_ru")], *[F.coalesce(c, F.lit(0.0 if c in SCORES else 0)).alias(c) for c in extra])


def all_pairs_scored(s: SparseScores) -> DataFrame:
    """Every column pair with its scores and label: the square of the catalog, looked up per text pair."""
    pairs = paired_columns(s.columns, _grids(s), ["column_final", "u"])
    return _scored(s, pairs.withColumnsRenamed({"left_u": "_lu", "right_u": "_ru"}))


def _best(s: SparseScores, part: DataFrame, by: str, n: int, ascending: bool) -> tuple[DataFrame, int]:
    """Column pairs of the text pairs in ``part`` with the best values of ``by``, n at least, and the
    number of pairs: the ``n`` best distinct values hold at least n, so only those are expanded."""
    steps = part.groupBy(by).agg(F.sum("n").alias("n")).orderBy(F.asc(by) if ascending else F.desc(by)).limit(n).collect()
    found, last = 0, None
    for r in steps:
        found, last = found + r["n"], r[by]
        if found >= n:
            break
    reach = F.lit(False) if last is None else F.col(by) <= last if ascending else F.col(by) >= last
    return expand(s, part.where(reach)).select(*PAIR_KEY, *SCORES, "is_match"), found


def top_pairs(s: SparseScores, by: str, n: int, label: int | None = None, ascending: bool = False) -> DataFrame:
    """The ``n`` best column pairs by ``by``, ties by key: key, scores, is_match."""
    part = s.pairs if label is None else s.pairs.where(F.col("is_match") == label)
    if label == 1:  # every match is listed, also those of score 0
        top, _ = _best(s, part, by, n, ascending)
    else:
        top, found = _best(s, part.where(F.col(by) > 0), by, n, ascending)
        if ascending or found < n:
            zeros = _first_zeros(s, by, n if ascending else n - found, label)
            top = top.union(zeros.select(*PAIR_KEY, *SCORES, "is_match"))
    return top.orderBy(F.asc(by) if ascending else F.desc(by), *[F.asc(k) for k in PAIR_KEY]).limit(n)


def _first_zeros(s: SparseScores, by: str, n: int, label: int | None) -> DataFrame:
    """The first ``n`` column pairs in key order whose ``by`` is 0 (and label is ``label``)."""
    running = F.coalesce(F.sum("cells").over(Window.orderBy("left_city", "right_city").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grids = _grids(s).withColumn("_before", running)  # one row per dataset pair
    depth = 4 * n
    while True:
        part = grids.where(F.col("_before") < depth).withColumn("take", F.least(F.col("cells"), F.lit(depth) - F.col("_before")))
        got = _scored(s, _cells(s, part)).where(F.col(by) == 0)
        if label is not None:
            got = got.where(F.col("is_match") == label)
        if depth >= s.total or got.limit(n).count() >= n:
            return got.orderBy(*PAIR_KEY).limit(n)
        depth *= 4


def top_per_grid(s: SparseScores, by: str, n: int) -> DataFrame:
    """Per dataset pair its ``n`` best column pairs by ``by``, ties by key: key, scores, exact_match.

    A dataset pair with fewer than n scored pairs is filled with its first pairs in key order that
    score 0; so many of its pairs are looked through as it has scored ones, and n."""
    cols = [*PAIR_KEY, *SCORES, "exact_match"]
    hits = expand(s, s.pairs.where(F.col(by) > 0)).select(*cols)
    city = ["left_city", "right_city"]
    counted = hits.groupBy(*city).agg(F.count(F.lit(1)).alias("hits"))
    short = (_grids(s).join(counted, city, "left").withColumn("hits", F.coalesce("hits", F.lit(0))).where(F.col("hits") < n)
             .withColumn("take", F.least(F.col("cells"), F.col("hits") + n)))
    short = s.write("sparse_short", short)
    if short.take(1):
        hits = hits.union(_scored(s, _cells(s, short)).where(F.col(by) == 0).select(*cols))
    best = Window.partitionBy(*city).orderBy(F.desc(by), *[F.asc(k) for k in PAIR_KEY[2:]])
    return hits.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= n).drop("_rn")


def labels_per_grid(s: SparseScores) -> DataFrame:
    """left_city, right_city, is_match, n of every two datasets, from group sizes and the listed matches."""
    city = ["left_city", "right_city"]
    held = s.columns.join(s.texts.select("u", "description"), "u").groupBy("city", "ord", "description").agg(F.count(F.lit(1)).alias("k"))
    a = held.withColumnsRenamed({"city": "left_city", "ord": "_lo", "k": "_lk"})
    b = held.withColumnsRenamed({"city": "right_city", "ord": "_ro", "k": "_rk"})
    before = (F.col("_lo") < F.col("_ro")) | ((F.col("_lo") == F.col("_ro")) & (F.col("left_city") < F.col("right_city")))
    match = a.join(b, "description").where(before).groupBy(*city).agg(F.sum(F.col("_lk") * F.col("_rk")).alias("m"))
    j = _grids(s).join(match, city, "left").withColumn("m", F.coalesce("m", F.lit(0)))
    rows = F.array(F.struct(F.lit(1).alias("is_match"), F.col("m").alias("n")), F.struct(F.lit(0).alias("is_match"), (F.col("cells") - F.col("m")).alias("n")))
    return j.select(*city, F.inline(rows)).where("n > 0")
