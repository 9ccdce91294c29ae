"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each SQL text is assembled from small helpers that mirror the Spark column
functions, so the two sides share one definition of every step.
"""

from __future__ import annotations

from schemaweave.constants import COLUMN_TYPE_RULES, FIXED_THRESHOLDS, SCORE_METHODS
from schemaweave.operators.evaluate import threshold_grid
from schemaweave.plans.evaluation import METHOD_LABELS, METHOD_ORDER
from schemaweave.plans.matching import PART_RULES

KEYS = "left_city, right_city, left_column_final, right_column_final"
KEY_LIST = ["left_city", "right_city", "left_column_final", "right_column_final"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({q(repr(float(x)))} AS DOUBLE)"


# --- scalar twins ----------------------------------------------------------------------------
def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm_steps(x: str) -> list[str]:
    s1 = strip_ws(x)
    s2 = f"lower({s1})"
    s3 = f"regexp_replace({s2}, '[^a-z0-9]+', '_', 'g')"
    s4 = f"regexp_replace({s3}, '_+', '_', 'g')"
    s5 = f"regexp_replace({s4}, '^_+|_+$', '', 'g')"
    return [x, s1, s2, s3, s4, s5]


def normalized(x: str) -> str:
    return norm_steps(x)[-1]


def trace(flags: list[str]) -> str:
    j = f"concat_ws(' | ', {', '.join(flags)})"
    return f"CASE WHEN {j} = '' THEN 'no_change' ELSE {j} END"


def norm_trace(x: str) -> str:
    s = norm_steps(x)
    names = ["trim_whitespace", "lowercase", "replace_special_chars", "collapse_underscores", "strip_edge_underscores"]
    return trace([f"CASE WHEN {s[i + 1]} <> {s[i]} THEN {q(n)} END" for i, n in enumerate(names)])


def expanded(x: str, rules) -> tuple[str, str]:
    cur, flags = x, []
    for p, r in rules:
        flags.append(f"CASE WHEN instr({cur}, {q(p)}) > 0 THEN {q(p)} END")
        cur = f"replace({cur}, {q(p)}, {q(r)})"
    return cur, trace(flags)


def alnum_key(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


def ambiguous(x: str) -> str:
    s = strip_ws(x)
    c = f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return (f"(length({s}) = 0 OR length({c}) <= 3 OR (upper({c}) = {c} AND lower({c}) <> {c} AND length({c}) <= 6)"
            f" OR regexp_matches({s}, '[0-9]') OR instr({s}, '_') > 0)")


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower(replace({x}, '_', ' ')), '\\s+'), lambda t: t <> ''))"


def jaccard(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE "
            f"len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END")


def classify(x: str) -> str:
    n = f"lower({x})"
    parts = []
    for label, words in COLUMN_TYPE_RULES:
        cond = " OR ".join(f"instr({n}, {q(w)}) > 0" for w in words)
        parts.append(f"WHEN {cond} THEN {q(label)}")
    return f"CASE {' '.join(parts)} ELSE 'other' END"


def raw_header(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


def prf_cols(tp: str, fp: str, fn: str) -> str:
    p = f"(CASE WHEN ({tp} + {fp}) > 0 THEN {tp}::DOUBLE / ({tp} + {fp}) ELSE 0.0::DOUBLE END)"
    r = f"(CASE WHEN ({tp} + {fn}) > 0 THEN {tp}::DOUBLE / ({tp} + {fn}) ELSE 0.0::DOUBLE END)"
    f1 = f"(CASE WHEN ({p} + {r}) > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0::DOUBLE END)"
    return f"{p} AS precision, {r} AS recall, {f1} AS f1"


# --- the matching chain as CTEs ------------------------------------------------------------------
def _tfidf_ctes(prefix: str, lcol: str, rcol: str, out: str) -> str:
    toks = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
    return f"""
{prefix}_docs AS (SELECT {lcol} AS t FROM repr UNION ALL SELECT {rcol} AS t FROM repr),
{prefix}_occ AS (SELECT t AS text, count(*) AS occ FROM {prefix}_docs GROUP BY t),
{prefix}_tk AS (SELECT text, occ, {toks} AS tk FROM {prefix}_occ),
{prefix}_terms AS (SELECT text, occ, unnest(list_concat(tk, CASE WHEN len(tk) > 1 THEN
    list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]) ELSE [] END)) AS term FROM {prefix}_tk),
{prefix}_tf AS (SELECT text, occ, term, count(*) AS tf FROM {prefix}_terms GROUP BY text, occ, term),
{prefix}_stats AS (SELECT term, sum(occ * tf) AS freq, sum(occ) AS df FROM {prefix}_tf GROUP BY term),
{prefix}_vocab AS (SELECT term, df FROM {prefix}_stats ORDER BY freq DESC, term ASC LIMIT 100),
{prefix}_n AS (SELECT sum(occ) AS n FROM {prefix}_occ),
{prefix}_w AS (SELECT f.text, f.term, f.tf * (ln((1.0::DOUBLE + n.n) / (1.0::DOUBLE + v.df)) + 1.0::DOUBLE) AS w
    FROM {prefix}_tf f JOIN {prefix}_vocab v USING (term), {prefix}_n n),
{prefix}_norm AS (SELECT text, sqrt(sum(w * w)) AS nrm FROM {prefix}_w GROUP BY text),
{prefix}_u AS (SELECT w.text, w.term, w.w / nm.nrm AS u FROM {prefix}_w w JOIN {prefix}_norm nm USING (text)),
{prefix}_pairs AS (SELECT DISTINCT {lcol} AS a, {rcol} AS b FROM repr),
{prefix}_cos AS (SELECT p.a, p.b, coalesce(sum(lu.u * ru.u), 0.0::DOUBLE) AS {out}
    FROM {prefix}_pairs p LEFT JOIN {prefix}_u lu ON lu.text = p.a
    LEFT JOIN {prefix}_u ru ON ru.text = p.b AND ru.term = lu.term GROUP BY p.a, p.b)"""


def matching_ctes() -> str:
    final, _ = expanded(normalized("column_original"), PART_RULES)
    return f"""
cat0 AS (SELECT p_brand, p_name, p_type, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY p_brand, p_name, p_type),
cat1 AS (SELECT p_brand, p_name, p_type, min(k) OVER (PARTITION BY p_brand, p_name) AS pos,
    row_number() OVER (PARTITION BY p_brand, p_name ORDER BY n DESC, p_type) AS rn FROM cat0),
cat2 AS (SELECT p_brand AS city, {raw_header('p_name')} AS column_original, p_type AS description, pos FROM cat1 WHERE rn = 1),
cat AS (SELECT city, column_original, {final} AS column_final, description, pos FROM cat2),
pairs AS (SELECT l.city AS left_city, r.city AS right_city, l.column_original AS left_column_original,
    l.column_final AS left_column_final, r.column_original AS right_column_original, r.column_final AS right_column_final
    FROM cat l JOIN cat r ON l.city < r.city),
lastd AS (SELECT city, column_final, arg_max(coalesce(description, ''), pos) AS description FROM cat GROUP BY city, column_final),
repr AS (SELECT p.*, p.left_column_final AS left_header_only, p.right_column_final AS right_header_only,
    CASE WHEN coalesce(ld.description, '') = '' THEN p.left_column_final ELSE p.left_column_final || ' | ' || ld.description END
        AS left_header_with_context,
    CASE WHEN coalesce(rd.description, '') = '' THEN p.right_column_final ELSE p.right_column_final || ' | ' || rd.description END
        AS right_header_with_context
    FROM pairs p LEFT JOIN lastd ld ON ld.city = p.left_city AND ld.column_final = p.left_column_final
    LEFT JOIN lastd rd ON rd.city = p.right_city AND rd.column_final = p.right_column_final),
{_tfidf_ctes('h', 'left_header_only', 'right_header_only', 'embedding_header_only_cosine')},
{_tfidf_ctes('c', 'left_header_with_context', 'right_header_with_context', 'embedding_header_context_cosine')},
scores AS (SELECT r.left_city, r.right_city, r.left_column_final, r.right_column_final,
    round({jaccard(tokens('r.left_header_only'), tokens('r.right_header_only'))}, 9) AS lexical_jaccard,
    CASE WHEN r.left_header_only = r.right_header_only THEN 1 ELSE 0 END AS exact_match,
    round(h.embedding_header_only_cosine, 9) AS embedding_header_only_cosine,
    round(c.embedding_header_context_cosine, 9) AS embedding_header_context_cosine
    FROM repr r JOIN h_cos h ON h.a = r.left_header_only AND h.b = r.right_header_only
    JOIN c_cos c ON c.a = r.left_header_with_context AND c.b = r.right_header_with_context),
truth AS (SELECT p.left_city, p.right_city, p.left_column_final, p.right_column_final,
    CASE WHEN ld.description = rd.description THEN 1 ELSE 0 END AS is_match
    FROM (SELECT DISTINCT left_city, right_city, left_column_final, right_column_final FROM pairs) p JOIN lastd ld ON ld.city = p.left_city AND ld.column_final = p.left_column_final
    JOIN lastd rd ON rd.city = p.right_city AND rd.column_final = p.right_column_final),
labelled AS (SELECT s.left_city, s.right_city, s.left_column_final, s.right_column_final, s.lexical_jaccard,
    s.embedding_header_only_cosine, s.embedding_header_context_cosine, t.is_match
    FROM scores s JOIN truth t USING (left_city, right_city, left_column_final, right_column_final))"""


def with_matching(select: str) -> str:
    return f"WITH {matching_ctes()}\n{select}"


def _confusion_select(specs, source: str = "labelled", extra_group: str = "") -> str:
    parts = []
    for method, score, th in specs:
        pred = f"coalesce({score} >= {dbl(th)}, false)"
        tp = f"count_if({pred} AND is_match = 1)"
        fp = f"count_if({pred} AND is_match = 0)"
        fn = f"count_if(NOT {pred} AND is_match = 1)"
        parts.append(f"""SELECT {extra_group}{q(method)} AS method, {q(score)} AS score_column, {dbl(th)} AS threshold,
    {prf_cols('tp', 'fp', 'fn')}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn
    FROM (SELECT {extra_group}{tp} AS tp, {fp} AS fp, {fn} AS fn FROM {source}
    {'GROUP BY ' + extra_group.rstrip(', ') if extra_group else ''})""")
    return "\nUNION ALL\n".join(parts)


FIXED = [(m, s, FIXED_THRESHOLDS[s]) for s, m, _ in SCORE_METHODS]
SWEEP = [(label, s, t) for t in threshold_grid() for s, _, label in SCORE_METHODS]


def _long_scores(cols: str = "") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {q(label)} AS method, {s} AS score{cols} FROM labelled" for s, _, label in SCORE_METHODS)


def _error_view(where: str, order: str, n: int) -> str:
    return with_matching(f"""SELECT {KEYS}, round(lexical_jaccard, 3) AS lexical_jaccard,
    round(embedding_header_only_cosine, 3) AS embedding_header_only_cosine,
    round(embedding_header_context_cosine, 3) AS embedding_header_context_cosine, is_match, '' AS note
    FROM (SELECT * FROM labelled WHERE {where} ORDER BY {order}, {KEYS} LIMIT {n})""")


def _pair_type() -> str:
    lt, rt = classify("left_column_final"), classify("right_column_final")
    return f"CASE WHEN {lt} = {rt} THEN {lt} ELSE 'mixed' END"


def matching_sql() -> dict[str, str]:
    out = {
        "schema_pairs": with_matching("SELECT * FROM pairs"),
        "pair_context": with_matching("SELECT * FROM repr"),
        "jaccard_pairs": with_matching(f"SELECT {KEYS}, lexical_jaccard, exact_match FROM scores"),
        "exact_match": with_matching(
            f"SELECT {KEYS}, lexical_jaccard, embedding_header_only_cosine FROM scores WHERE exact_match = 1"),
        "tfidf_cosine": with_matching(
            f"SELECT {KEYS}, embedding_header_only_cosine, embedding_header_context_cosine FROM scores"),
        "merge_scores": with_matching("SELECT * FROM scores"),
        "merge_scores_join": with_matching("SELECT * FROM scores"),
        "top_n_template": with_matching(f"""SELECT {KEYS}, lexical_jaccard, exact_match, embedding_header_only_cosine,
    embedding_header_context_cosine, CAST(NULL AS INTEGER) AS is_match, '' AS match_notes FROM scores
    QUALIFY row_number() OVER (PARTITION BY left_city || '__' || right_city
        ORDER BY embedding_header_context_cosine DESC, {KEYS}) <= 20"""),
        "metrics_fixed": with_matching(_confusion_select(FIXED)),
        "threshold_sweep": with_matching(_confusion_select(SWEEP)),
        "curves": with_matching(f"SELECT method, threshold, precision, recall, f1 FROM ({_confusion_select(SWEEP)})"),
        "f1_by_type": with_matching(f"""SELECT column_type, method, f1, CAST(n AS BIGINT) AS n FROM (
    SELECT column_type, method, {prf_cols('tp', 'fp', 'fn')}, n FROM (
    {" UNION ALL ".join(f'''SELECT column_type, {q(m)} AS method, count(*) AS n,
        count_if(coalesce({s} >= {dbl(t)}, false) AND is_match = 1) AS tp,
        count_if(coalesce({s} >= {dbl(t)}, false) AND is_match = 0) AS fp,
        count_if(NOT coalesce({s} >= {dbl(t)}, false) AND is_match = 1) AS fn
        FROM (SELECT *, {_pair_type()} AS column_type FROM labelled) GROUP BY column_type''' for m, s, t in FIXED)}))"""),
        "type_counts": with_matching(f"""SELECT column_type, count(*) AS count FROM (
    SELECT {classify('column_name')} AS column_type FROM (
        SELECT left_column_final AS column_name FROM labelled WHERE is_match = 1
        UNION ALL SELECT right_column_final FROM labelled WHERE is_match = 1)) GROUP BY column_type"""),
        "precision_at_k": with_matching(f"""SELECT method, CAST(k AS BIGINT) AS k,
    CASE WHEN least(k, count(*)) > 0 THEN sum(CASE WHEN rn <= k THEN is_match ELSE 0 END)::DOUBLE / least(k, count(*))
         ELSE 0.0::DOUBLE END AS precision_at_k
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, {KEYS}) AS rn
          FROM ({_long_scores(', ' + KEYS + ', is_match')})) WHERE rn <= 100), (VALUES (10), (20), (50), (100)) ks(k)
    GROUP BY method, k"""),
        "false_pos": _error_view("is_match = 0", "embedding_header_context_cosine DESC", 10),
        "false_neg": _error_view("is_match = 1", "embedding_header_context_cosine ASC", 10),
        "error_types": with_matching(f"""SELECT error_type, count(*) AS count FROM (
    SELECT CASE WHEN {classify('left_column_final')} <> {classify('right_column_final')} THEN 'structural_mismatch'
        WHEN len(list_intersect({tokens('left_column_final')}, {tokens('right_column_final')})) > 0
             AND lexical_jaccard > 0 THEN 'abbreviation_or_token_overlap'
        WHEN embedding_header_context_cosine >= 0.6::DOUBLE THEN 'semantic_near_miss' ELSE 'other' END AS error_type
    FROM (SELECT * FROM labelled WHERE is_match = 0 ORDER BY embedding_header_context_cosine DESC, {KEYS} LIMIT 200))
    GROUP BY error_type"""),
        "match_pivot": with_matching("""SELECT left_city || ' — ' || right_city AS city_pair,
    CAST(count_if(is_match = 0) AS BIGINT) AS non_match, CAST(count_if(is_match = 1) AS BIGINT) AS match
    FROM labelled GROUP BY left_city || ' — ' || right_city"""),
        "bars": with_matching(f"""SELECT CASE method {' '.join(f'WHEN {q(m)} THEN {q(METHOD_LABELS[m])}' for m in METHOD_ORDER)}
        ELSE method END AS method_label,
    CAST(CASE method {' '.join(f'WHEN {q(m)} THEN {i + 1}' for i, m in enumerate(METHOD_ORDER))} ELSE 0 END AS BIGINT)
        AS rank,
    f1, precision, recall, tp, fp, fn FROM ({_confusion_select(FIXED)})"""),
        "best_vs_lexical": with_matching(f"""SELECT 'lexical_jaccard' AS base_method,
    (SELECT f1 FROM m WHERE method = 'lexical_jaccard') AS base_value,
    (SELECT method FROM m WHERE method <> 'lexical_jaccard' ORDER BY f1 DESC, method DESC LIMIT 1) AS best_method,
    (SELECT max(f1) FROM m WHERE method <> 'lexical_jaccard') AS best_value,
    (SELECT max(f1) FROM m WHERE method <> 'lexical_jaccard') - (SELECT f1 FROM m WHERE method = 'lexical_jaccard') AS gap
    FROM (SELECT 1)"""),
        "column_types": with_matching(f"SELECT city, column_final, {classify('column_final')} AS column_type FROM cat"),
    }
    out["best_vs_lexical"] = out["best_vs_lexical"].replace(
        "\nSELECT 'lexical_jaccard' AS base_method", f",\nm AS ({_confusion_select(FIXED)})\nSELECT 'lexical_jaccard' AS base_method")
    hist = f"""WITH {matching_ctes()},
long AS ({_long_scores(', is_match')}),
bounds AS (SELECT method, is_match, min(score) AS mn, max(score) AS mx, count(*) AS n FROM long GROUP BY method, is_match),
b2 AS (SELECT method, is_match, n, CASE WHEN mn = mx THEN mn - 0.5::DOUBLE ELSE mn END AS lo,
              CASE WHEN mn = mx THEN mx + 0.5::DOUBLE ELSE mx END AS hi FROM bounds),
binned AS (SELECT l.method, l.is_match, CAST(least(floor((l.score - b.lo) / (b.hi - b.lo) * 20), 19) AS BIGINT) AS bin
           FROM long l JOIN b2 b USING (method, is_match)),
counts AS (SELECT method, is_match, bin, count(*) AS c FROM binned GROUP BY method, is_match, bin),
grid AS (SELECT method, is_match, n, lo, hi, unnest(range(0, 20)) AS bin FROM b2)
SELECT g.method, g.is_match, CAST(g.bin AS BIGINT) AS bin, round(g.lo + g.bin * ((g.hi - g.lo) / 20), 9) AS bin_lo,
    round(g.lo + (g.bin + 1) * ((g.hi - g.lo) / 20), 9) AS bin_hi, CAST(coalesce(c.c, 0) AS BIGINT) AS count,
    round(coalesce(c.c, 0) / (g.n * ((g.hi - g.lo) / 20)), 6) AS density
FROM grid g LEFT JOIN counts c ON c.method = g.method AND c.is_match = g.is_match AND c.bin = g.bin"""
    out["histogram"] = hist
    return out


# --- mapping evaluation ------------------------------------------------------------------------------
def mapping_ctes() -> str:
    lev = ("CASE WHEN greatest(length(lower(source)), length(t)) = 0 THEN 1.0::DOUBLE ELSE "
           "1.0::DOUBLE - levenshtein(lower(source), t) / greatest(length(lower(source)), length(t)) END")
    return f"""{matching_ctes()},
targets AS (SELECT t, row_number() OVER (ORDER BY t) AS idx FROM (SELECT DISTINCT lower(p_type) AS t FROM part)),
src AS (SELECT city AS dataset, column_original AS source, lower(description) AS true_target FROM cat),
lex_s AS (SELECT dataset, source, t, idx, {lev} AS sc FROM src, targets),
lex AS (SELECT dataset, 'lexical' AS method, source, t AS target FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, source ORDER BY sc DESC, idx) AS rn FROM lex_s)
    WHERE rn = 1 AND sc >= 0.3::DOUBLE AND sc > 0),
tok_s AS (SELECT dataset, source, t, idx, {jaccard(tokens('source'), tokens('t'))} AS sc FROM src, targets),
tokm AS (SELECT dataset, 'token' AS method, source, t AS target FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, source ORDER BY sc DESC, idx) AS rn FROM tok_s)
    WHERE rn = 1 AND sc >= 0.3::DOUBLE AND sc > 0),
pred AS (SELECT * FROM lex UNION ALL SELECT * FROM tokm),
truel AS (SELECT dataset, m.method, source, true_target AS target FROM src, (VALUES ('lexical'), ('token')) m(method)),
j AS (SELECT coalesce(t.dataset, p.dataset) AS dataset, coalesce(t.method, p.method) AS method,
    t.target AS tt, p.target AS pt FROM truel t FULL OUTER JOIN pred p
    ON t.dataset = p.dataset AND t.method = p.method AND t.source = p.source),
cnt AS (SELECT dataset, method, count(*) AS n,
    count_if(tt IS NOT NULL AND coalesce(pt IS NOT NULL AND pt = tt, false)) AS tp,
    count_if(tt IS NULL AND coalesce(pt IS NOT NULL AND pt = tt, false)) AS fp,
    count_if(tt IS NOT NULL AND NOT coalesce(pt IS NOT NULL AND pt = tt, false)) AS fn,
    count_if(tt IS NULL AND NOT coalesce(pt IS NOT NULL AND pt = tt, false)) AS tn FROM j GROUP BY dataset, method),
results AS (SELECT dataset, method, round(CASE WHEN n > 0 THEN (tp + tn)::DOUBLE / n ELSE 0.0::DOUBLE END, 9) AS accuracy,
    round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM (
    SELECT *, {prf_cols('tp', 'fp', 'fn')} FROM cnt)),
rlong AS (SELECT dataset, method, 'precision' AS metric, precision AS value FROM results
    UNION ALL SELECT dataset, method, 'accuracy', accuracy FROM results
    UNION ALL SELECT dataset, method, 'recall', recall FROM results
    UNION ALL SELECT dataset, method, 'f1', f1 FROM results),
xtr AS (SELECT dataset AS train, source, true_target AS p FROM src),
xte AS (SELECT dataset AS test, source, true_target AS t FROM src),
common AS (SELECT train, test, count(*) AS nc, count_if(p = t) AS tp FROM xtr JOIN xte USING (source) GROUP BY train, test),
sizes AS (SELECT dataset, count(*) AS n FROM src GROUP BY dataset),
cross_pairs AS (SELECT c.train, c.test,
    round((c.tp + (c.na - c.nc))::DOUBLE / (c.nb + c.na - c.nc), 9) AS accuracy,
    round(CASE WHEN (2 * c.tp + (c.nb - c.tp)) > 0 THEN {f1_expr('c.tp', '(c.nb - c.tp)')} ELSE 0.0::DOUBLE END, 9) AS f1
    FROM (SELECT a.dataset AS train, b.dataset AS test, a.n AS na, b.n AS nb, coalesce(m.nc, 0) AS nc, coalesce(m.tp, 0) AS tp
          FROM sizes a CROSS JOIN sizes b LEFT JOIN common m ON m.train = a.dataset AND m.test = b.dataset) c)"""


def f1_expr(tp: str, fn: str) -> str:
    p = f"(CASE WHEN {tp} > 0 THEN {tp}::DOUBLE / {tp} ELSE 0.0::DOUBLE END)"
    r = f"(CASE WHEN ({tp} + {fn}) > 0 THEN {tp}::DOUBLE / ({tp} + {fn}) ELSE 0.0::DOUBLE END)"
    return f"(CASE WHEN ({p} + {r}) > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0::DOUBLE END)"


def with_mapping(select: str) -> str:
    return f"WITH {mapping_ctes()}\n{select}"


def mapping_sql() -> dict[str, str]:
    metrics = ["precision", "accuracy", "recall", "f1"]
    wide = ", ".join(f"max(CASE WHEN method = {q(m)} THEN {x} END) AS {m}_{x}" for m in ["lexical", "token"] for x in metrics)
    return {
        "matching_eval": with_mapping("SELECT * FROM results"),
        "match_quality": with_mapping("SELECT * FROM results WHERE method = 'lexical'"),
        "method_summary": with_mapping("""SELECT method, metric, round(avg(value), 9) AS mean,
            round(stddev_pop(value), 9) AS std FROM rlong GROUP BY method, metric"""),
        "win_loss": with_mapping("""SELECT outcome, count(*) AS count FROM (
            SELECT CASE WHEN c > b + 0.05::DOUBLE THEN 'token' WHEN b > c + 0.05::DOUBLE THEN 'lexical' ELSE 'tie' END AS outcome
            FROM (SELECT dataset, metric, max(CASE WHEN method = 'token' THEN value END) AS c,
                         max(CASE WHEN method = 'lexical' THEN value END) AS b FROM rlong GROUP BY dataset, metric))
            GROUP BY outcome"""),
        "improve": with_mapping("""SELECT dataset, metric, round(max(CASE WHEN method = 'token' THEN value END)
            - max(CASE WHEN method = 'lexical' THEN value END), 9) AS improvement FROM rlong GROUP BY dataset, metric"""),
        "best_method": with_mapping("""SELECT metric, CASE WHEN round(avg(CASE WHEN method = 'token' THEN value END), 9)
            > round(avg(CASE WHEN method = 'lexical' THEN value END), 9) THEN 'token' ELSE 'lexical' END AS best_method
            FROM rlong GROUP BY metric"""),
        "results_wide": with_mapping(f"SELECT dataset, {wide} FROM results GROUP BY dataset"),
        "cross_matrix": with_mapping("SELECT * FROM cross_pairs"),
        # one column per brand of the part table
        "cross_matrix_wide": with_mapping("SELECT train, " + ", ".join(
            f"max(CASE WHEN test = 'Brand#{i}' THEN f1 END) AS \"Brand#{i}\"" for i in range(1, 26)) + " FROM cross_pairs GROUP BY train"),
        "generalise": with_mapping("""SELECT train, max(CASE WHEN train = test THEN f1 END) AS same_score,
            round(avg(CASE WHEN train <> test THEN f1 END), 9) AS mean_other,
            round(max(CASE WHEN train = test THEN f1 END) - avg(CASE WHEN train <> test THEN f1 END), 9) AS drop
            FROM cross_pairs GROUP BY train"""),
        "generalise_tests": generalise_tests_sql(),
        "metric_pairs": with_mapping("SELECT train, test, accuracy, f1 FROM cross_pairs WHERE train <> test"),
    }


def generalise_tests_sql() -> str:
    return with_mapping("""SELECT o.test, round(avg(o.f1), 9) AS mean_from_others,
        (SELECT x.train FROM cross_pairs x WHERE x.test = o.test AND x.train <> x.test ORDER BY x.f1 DESC, x.train DESC LIMIT 1)
            AS best_train,
        (SELECT x.train FROM cross_pairs x WHERE x.test = o.test AND x.train <> x.test ORDER BY x.f1 ASC, x.train ASC LIMIT 1)
            AS worst_train
        FROM cross_pairs o WHERE o.train <> o.test GROUP BY o.test""")
