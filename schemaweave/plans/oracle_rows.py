"""DuckDB SQL twins of the row-pipeline, source and classification queries."""

from __future__ import annotations

from schemaweave.constants import CANONICAL_SCHEMA, EXPECTED_SCHEMAS
from schemaweave.plans.evaluation import DOC_HEADERS, DOC_RULES, LENGTH_THRESHOLD
from schemaweave.plans.matching import PART_RULES
from schemaweave.plans.oracle import (alnum_key, ambiguous, expanded, norm_trace, normalized, q, raw_header, strip_ws,
                                      tokens)
from schemaweave.plans.rows import DRIVER_EXPECTED, REFERENCE_TOKENS
from schemaweave.plans.schema_catalog import FINAL_COLUMNS

MISSING_CHICAGO = ",".join(sorted(set(EXPECTED_SCHEMAS["chicago"]) - {"ID", "Case Number", "Date"}))


NULLS = {"s": "CAST(NULL AS VARCHAR)", "b": "CAST(NULL AS BOOLEAN)", "i": "CAST(NULL AS BIGINT)",
         "d": "CAST(NULL AS DOUBLE)", "t": "CAST(NULL AS TIMESTAMP)"}


def canonical_select(values: dict[str, str]) -> str:
    kinds = {"incident_id": "s", "case_number": "s", "incident_datetime": "t", "block_address": "s",
             "iucr_code": "s", "crime_category": "s", "crime_subtype": "s", "location_type": "s",
             "arrest_made": "b", "domestic_flag": "b", "beat": "i", "district": "i", "ward": "i",
             "community_area": "i", "fbi_code": "s", "x_coord": "d", "y_coord": "d", "year": "i",
             "updated_on": "t", "latitude": "d", "longitude": "d", "location_point": "s"}
    return ", ".join(f"{values.get(c, NULLS[k])} AS {c}" for c, k in kinds.items())


ORDERS_CANON = canonical_select({
    "incident_id": "CAST(o_orderkey AS VARCHAR)", "case_number": "CAST(o_custkey AS VARCHAR)",
    "incident_datetime": "CAST(o_orderdate AS TIMESTAMP)", "crime_category": "o_orderpriority",
    "crime_subtype": "c_mktsegment", "location_type": "o_orderstatus",
    "arrest_made": "CASE WHEN regexp_matches(upper(o_orderstatus), 'F') THEN true END",
    "district": "CAST(c_nationkey AS BIGINT)", "x_coord": "o_totalprice", "year": "CAST(year(o_orderdate) AS BIGINT)"})
EVENTS_CANON = canonical_select({
    "incident_id": "CAST(event_id AS VARCHAR)", "case_number": "CAST(user_id AS VARCHAR)",
    "incident_datetime": "CAST(ts AS TIMESTAMP)", "crime_category": "event_type", "x_coord": "value",
    "year": "CAST(year(ts) AS BIGINT)"})

EVENTS_NULLED = """(SELECT event_id, ts, user_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
    CASE WHEN value <= 50 THEN value END AS value, props FROM events)"""

EVENT_DTYPES = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
                ("value", "double"), ("props", "string")]
CUSTOMER_DTYPES = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                   ("c_mktsegment", "string")]
TABLE_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
}


def profile_sql() -> str:
    parts = [f"""SELECT {q(c)} AS "column", {q(t)} AS dtype,
        round(count_if({c} IS NULL)::DOUBLE * 100.0::DOUBLE / count(*), 2) AS null_pct,
        count(*) AS n_rows, CAST({len(EVENT_DTYPES)} AS BIGINT) AS n_cols FROM {EVENTS_NULLED}""" for c, t in EVENT_DTYPES]
    return "\nUNION ALL\n".join(parts)


def validation_sql(only_valid: bool = False) -> str:
    parts = []
    for name, expected in DRIVER_EXPECTED.items():
        cols = TABLE_COLUMNS[name]
        missing = ",".join(sorted(set(expected) - set(cols)))
        extra = ",".join(sorted(set(cols) - set(expected)))
        frac = " + ".join(f"count_if({c} IS NULL)::DOUBLE / count(*)" for c in cols)
        mean = f"(({frac}) / {len(cols)} * 100.0::DOUBLE)"
        valid = f"({'true' if not missing else 'false'} AND coalesce({mean} < 50.0::DOUBLE, false))"
        parts.append(f"""SELECT {q(name)} AS dataset, {q(name)} AS dataset_type, count(*) AS row_count,
            CAST({len(cols)} AS BIGINT) AS col_count, {q(missing)} AS missing_cols, {q(extra)} AS extra_cols,
            round({mean}, 2) AS null_percentage, {valid} AS is_valid, {q(name)} AS routed_type FROM {name}""")
    body = "\nUNION ALL\n".join(parts)
    if only_valid:
        return f"SELECT dataset, row_count AS rows_processed FROM ({body}) WHERE is_valid"
    return body


def column_profile_sql() -> str:
    cells = "\nUNION ALL\n".join(
        f"SELECT c_custkey AS pos, {q(c)} AS \"column\", {strip_ws(f'CAST({c} AS VARCHAR)')} AS value FROM customer"
        for c, _ in CUSTOMER_DTYPES)
    ratios = "\nUNION ALL\n".join(
        f"SELECT {q(c)} AS \"column\", {q(t)} AS dtype, round(count({c}) / count(*), 6) AS non_null_ratio FROM customer"
        for c, t in CUSTOMER_DTYPES)
    return f"""WITH cells AS ({cells}),
firsts AS (SELECT "column", value, min(pos) AS pos FROM cells WHERE value IS NOT NULL AND value <> ''
    GROUP BY "column", value),
top AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY pos, value) AS rn FROM firsts),
samples AS (SELECT "column", string_agg(value, ' | ' ORDER BY rn) AS sample_values FROM top WHERE rn <= 5
    GROUP BY "column"),
ratios AS ({ratios})
SELECT 'customer' AS dataset, r."column", r.dtype, r.non_null_ratio, coalesce(s.sample_values, '') AS sample_values
FROM ratios r LEFT JOIN samples s USING ("column")"""


def normalize_sql() -> str:
    orig = f"({raw_header('p_name')} || ' (' || p_type || ') ')"
    return f"""WITH x AS (SELECT p_partkey, p_brand, {orig} AS original_name FROM part),
y AS (SELECT *, {normalized('original_name')} AS normalized_column_name, {norm_trace('original_name')} AS normalization_steps
      FROM x)
SELECT p_partkey, original_name, normalized_column_name, normalization_steps, {alnum_key('original_name')} AS alnum_key,
    {ambiguous('original_name')} AS flag_ambiguous_or_abbrev, length(normalized_column_name) = 0 AS normalized_is_empty,
    count(*) OVER (PARTITION BY p_brand, normalized_column_name) > 1 AS normalized_is_duplicate FROM y"""


def expand_sql() -> str:
    e, t = expanded("normalized_column_name", PART_RULES)
    return f"""SELECT p_partkey, normalized_column_name, {e} AS expanded_column_name, {t} AS abbreviation_rules_applied
FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS normalized_column_name FROM part)"""


def token_sets_sql() -> str:
    ref = "[" + ", ".join(q(t) for t in REFERENCE_TOKENS) + "]"
    return f"""SELECT p_partkey, CAST(len(list_intersect(tk, {ref})) AS BIGINT) AS n_shared,
    CAST(len(list_distinct(list_concat(tk, {ref}))) AS BIGINT) AS n_union,
    len(list_intersect(tk, {ref})) > 0 AS overlaps,
    len(list_filter(tk, lambda x: NOT list_contains({ref}, x))) = 0 AS subset_of_reference
    FROM (SELECT p_partkey, {tokens('p_name')} AS tk FROM part)"""


def sections_sql() -> str:
    hdr = "CASE item " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in DOC_HEADERS.items()) + " END"
    code = "CASE section " + " ".join(
        f"WHEN {q(s)} THEN " + (f"regexp_full_match(item, {q(r[1])})" if r[0] != "inline" else "false")
        for s, r in DOC_RULES.items()) + " END"
    mode = "CASE section " + " ".join(f"WHEN {q(s)} THEN {q(r[0])}" for s, r in DOC_RULES.items()) + " END"
    inline = [r[1] for r in DOC_RULES.values() if r[0] == "inline"][0]
    inline_secs = ", ".join(q(s) for s, r in DOC_RULES.items() if r[0] == "inline")
    item = f"translate({strip_ws('raw')}, '–—', '--')"
    return f"""WITH lines AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS raw,
        unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
items AS (SELECT doc, pos, {item} AS item FROM lines),
items2 AS (SELECT * FROM items WHERE item <> '' AND lower(item) <> 'nan'),
h AS (SELECT *, {hdr} AS hdr FROM items2),
s AS (SELECT *, coalesce(last_value(hdr IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'body') AS section, hdr IS NOT NULL AS is_hdr FROM h),
m AS (SELECT *, coalesce({code}, false) AND NOT is_hdr AS m FROM s),
n AS (SELECT *, lead(item) OVER w AS nxt, coalesce(lead(is_hdr) OVER w, false) AS next_hdr,
        coalesce(lead(m) OVER w, false) AS next_m, coalesce(lag(m) OVER w, false) AS prev_m,
        row_number() OVER w AS idx FROM m WINDOW w AS (PARTITION BY doc ORDER BY pos)),
r AS (SELECT *, last_value(CASE WHEN m AND NOT prev_m THEN idx END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start, {mode} AS mode FROM n),
pairs AS (SELECT section, item AS code, nxt AS description FROM r WHERE
    (mode = 'next_not_code' AND m AND nxt IS NOT NULL AND NOT next_hdr AND NOT next_m)
    OR (mode = 'pair' AND m AND (idx - start) % 2 = 0 AND nxt IS NOT NULL AND NOT next_hdr)),
inl AS (SELECT section, regexp_extract(item, {q(inline)}, 1) AS code, regexp_extract(item, {q(inline)}, 2) AS description
    FROM r WHERE section IN ({inline_secs}) AND NOT is_hdr AND regexp_matches(item, {q(inline)}))
SELECT DISTINCT * FROM (SELECT * FROM pairs UNION ALL SELECT * FROM inl)"""


def rows_sql() -> dict[str, str]:
    hh = "lpad(CAST(hour(ts) * 100 + minute(ts) AS VARCHAR), 4, '0')"
    return {
        "canonical_orders": f"SELECT {ORDERS_CANON} FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
        "union_incidents": f"""SELECT {ORDERS_CANON}, 'orders' AS dataset_source FROM orders
            LEFT JOIN customer ON o_custkey = c_custkey
            UNION ALL SELECT {EVENTS_CANON}, 'events' AS dataset_source FROM events""",
        "load_twice": f"""WITH u AS (SELECT incident_id, 'orders' AS dataset_source FROM (SELECT {ORDERS_CANON} FROM orders
                LEFT JOIN customer ON o_custkey = c_custkey)
            UNION ALL SELECT incident_id, 'events' FROM (SELECT {EVENTS_CANON} FROM events)),
            n AS (SELECT dataset_source, count(*) + count_if(incident_id LIKE '%3') AS n_rows,
                count_if(incident_id NOT LIKE '%0') AS kept, count_if(incident_id LIKE '%0') AS null_keys FROM u GROUP BY dataset_source)
            SELECT dataset_source, CAST(load AS BIGINT) AS load, CAST(n_rows AS BIGINT) AS n_rows,
                CAST(CASE load WHEN 1 THEN kept ELSE 0 END AS BIGINT) AS inserted,
                CAST(n_rows - CASE load WHEN 1 THEN kept ELSE 0 END AS BIGINT) AS rejected,
                CAST(null_keys AS BIGINT) AS null_keys, CAST(kept AS BIGINT) AS table_rows FROM n, (VALUES (1), (2)) l(load)""",
        "dedup_first": """SELECT event_id, ts, user_id, event_type, value FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
        "profile_nulls": profile_sql(),
        "validate_columns": validation_sql(),
        "process_valid": validation_sql(only_valid=True),
        "column_profile": column_profile_sql(),
        "normalize_names": normalize_sql(),
        "expand_rules": expand_sql(),
        "clean_text_cols": """SELECT o_orderkey,
            CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END AS status_bool,
            o_totalprice AS price_float, o_custkey AS cust_int,
            CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice AS BIGINT) END AS price_int,
            CAST(o_orderdate AS TIMESTAMP) AS ts_parsed, o_orderpriority || ' - x' AS priority_clean FROM orders""",
        "date_hhmm": f"""SELECT event_id, strftime(ts, '%m/%d/%Y') || ' ' || substr({hh}, 1, 2) || ':' || substr({hh}, 3, 2)
            AS datetime_text, date_trunc('minute', ts) AS incident_datetime, CAST(year(ts) AS BIGINT) AS year FROM events""",
        "temporal_features": """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour,
            CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month,
            CAST(year(ts) AS INTEGER) AS year, CASE WHEN isodow(ts) - 1 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
            CASE WHEN hour(ts) >= 22 OR hour(ts) <= 6 THEN 1 ELSE 0 END AS is_night,
            CASE WHEN month(ts) > 0 AND month(ts) <= 3 THEN 'winter' WHEN month(ts) > 3 AND month(ts) <= 6 THEN 'spring'
                 WHEN month(ts) > 6 AND month(ts) <= 9 THEN 'summer' WHEN month(ts) > 9 AND month(ts) <= 12 THEN 'fall' END
                AS season,
            round_even((value / 3.0::DOUBLE) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS value_rounded FROM events""",
        "freq_encode": """SELECT event_id, event_type_n, CASE WHEN event_type_n IS NULL THEN NULL
            ELSE count(*) OVER (PARTITION BY event_type_n) END AS event_type_n_freq FROM (
            SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS event_type_n FROM events)""",
        "group_count": """SELECT event_id, event_type_n, hour, CASE WHEN event_type_n IS NULL OR hour IS NULL THEN NULL
            ELSE count(*) OVER (PARTITION BY event_type_n, hour) END AS type_hour_count FROM (
            SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type_n,
                   CAST(hour(ts) AS INTEGER) AS hour FROM events)""",
        "label_encode": """SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS brand_code
            FROM part""",
        "scale": """SELECT l_orderkey, l_linenumber,
            round((l_quantity - avg(l_quantity) OVER ()) / nullif(stddev_pop(l_quantity) OVER (), 0), 6) AS z_quantity,
            round((l_extendedprice - avg(l_extendedprice) OVER ()) / nullif(stddev_pop(l_extendedprice) OVER (), 0), 6)
                AS z_extendedprice,
            round((l_discount - avg(l_discount) OVER ()) / nullif(stddev_pop(l_discount) OVER (), 0), 6) AS z_discount
            FROM lineitem""",
        "project_filter": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
            WHERE o_totalprice <= 400000 AND o_orderstatus IN ('O', 'F')""",
        "flags_to_int": """SELECT o_orderkey,
            CASE WHEN regexp_matches(upper(o_orderpriority), 'URGENT|HIGH') THEN 1 END AS priority_flag,
            CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS status_is_f FROM orders""",
        "token_sets": token_sets_sql(),
        "features_full": features_sql(),
        "schema_catalog": schema_catalog_sql(),
        "final_schema": f"SELECT {', '.join(FINAL_COLUMNS)} FROM ({schema_catalog_sql()})",
        "catalog_pairs": catalog_pairs_sql(),
        "section_extract": sections_sql(),
        "canonical_write": "\nUNION ALL\n".join(
            f"""SELECT '{f.name}' AS "column", '{f.dataType.simpleString()}' AS dtype, round(count_if({f.name} IS NULL) * 100.0::DOUBLE / count(*), 2) AS null_pct,
            count(*) AS n_rows, CAST({len(CANONICAL_SCHEMA.fields)} AS BIGINT) AS n_cols, count(*) AS parquet_rows, count(*) AS csv_rows
            FROM (SELECT {ORDERS_CANON} FROM orders LEFT JOIN customer ON o_custkey = c_custkey)""" for f in CANONICAL_SCHEMA.fields),
        "source_roundtrip": """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
            FROM customer""",
        "scan_files": """SELECT 'customer.parquet' AS source_file, count(*) AS n_rows FROM customer
            UNION ALL SELECT 'supplier.parquet', count(*) FROM supplier""",
        "json_meta": """WITH d AS (SELECT event_id,
                lower(regexp_replace(CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE upper(event_type) END,
                    '[^\\p{L}\\p{N}]', '', 'g')) AS key,
                CASE WHEN event_type IN ('click', 'view') THEN 'k=' || json_extract_string(props, '$.k')
                     ELSE trim(' k=' || json_extract_string(props, '$.k') || ' ') END AS description FROM events),
            last AS (SELECT key, arg_max(description, event_id) AS description FROM d
                     WHERE description IS NOT NULL AND description <> '' GROUP BY key),
            cat AS (SELECT DISTINCT event_type AS "column" FROM events)
            SELECT "column", last.description IS NOT NULL AS has_metadata_description,
                coalesce(last.description, '') AS metadata_description
            FROM cat LEFT JOIN last ON last.key = lower(regexp_replace("column", '[^\\p{L}\\p{N}]', '', 'g'))""",
        "stratified_split": """SELECT o_orderkey, o_orderstatus, rn <= round(0.2::DOUBLE * n) AS is_test FROM (
            SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n,
                row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '42'), o_orderkey)
                AS rn FROM orders)""",
        "auc_exact": f"""WITH ls AS (SELECT l.quality AS label, CAST(d.n_chars AS DOUBLE) AS score FROM labels l
                JOIN documents d USING (doc_id)),
            g AS (SELECT score, count_if(label = 1) AS p, count_if(label = 0) AS q FROM ls GROUP BY score),
            c AS (SELECT *, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                AS below FROM g)
            SELECT round(CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * (below + 0.5::DOUBLE * q)) / (sum(p) * sum(q)) END, 9)
                AS auc, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg FROM c""",
        "class_report": f"""WITH ls AS (SELECT l.quality AS label, CASE WHEN d.n_chars >= {LENGTH_THRESHOLD} THEN 1 ELSE 0 END
                AS prediction FROM labels l JOIN documents d USING (doc_id)),
            cls AS (SELECT DISTINCT label AS c FROM ls UNION SELECT DISTINCT prediction FROM ls),
            per AS (SELECT c, count_if(label = c AND prediction = c) AS tp, count_if(label <> c AND prediction = c) AS fp,
                count_if(label = c AND prediction <> c) AS fn FROM ls, cls GROUP BY c),
            m AS (SELECT CAST(c AS VARCHAR) AS class,
                CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS precision,
                CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS recall, tp + fn AS support, tp
                FROM per),
            m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                ELSE 0.0::DOUBLE END AS f1 FROM m),
            tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
                sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM m2)
            SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
                CAST(support AS BIGINT) AS support FROM m2
            UNION ALL SELECT 'accuracy', round(tp / n, 9), round(tp / n, 9), round(tp / n, 9), CAST(n AS BIGINT) FROM tot
            UNION ALL SELECT 'macro avg', round(mp, 9), round(mr, 9), round(mf, 9), CAST(n AS BIGINT) FROM tot
            UNION ALL SELECT 'weighted avg', round(wp / n, 9), round(wr / n, 9), round(wf / n, 9), CAST(n AS BIGINT) FROM tot""",
        "best_match_vector": """WITH ex AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i
                FROM embeddings),
            cen AS (SELECT label, list(x ORDER BY i) AS v FROM (
                SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM ex GROUP BY label, i) GROUP BY label),
            sc AS (SELECT e.vec_id, c.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v) AS s
                FROM embeddings e, cen c),
            best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC NULLS LAST, label) AS rn FROM sc)
            SELECT vec_id, 'label_' || label AS best_target, round(s, 6) AS best_score FROM best
            WHERE rn = 1 AND s > 0.3::DOUBLE""",
        "best_match_fuzzy": """WITH targets AS (SELECT t, row_number() OVER (ORDER BY t) AS idx FROM (
                SELECT DISTINCT lower(p_type) AS t FROM part)),
            s AS (SELECT p_partkey, t, idx, CASE WHEN greatest(length(lower(p_name)), length(t)) = 0 THEN 1.0::DOUBLE
                ELSE 1.0::DOUBLE - levenshtein(lower(p_name), t) / greatest(length(lower(p_name)), length(t)) END AS sc
                FROM part, targets),
            b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sc DESC, idx) AS rn FROM s)
            SELECT p_partkey, t AS best_target, round(sc, 9) AS best_score FROM b WHERE rn = 1 AND sc >= 0.3::DOUBLE AND sc > 0""",
        "dispatch_files": f"""SELECT 'dataset' AS kind, 'chicago_2001' AS name, 'chicago' AS dataset_type, 'processed' AS status,
                '' AS missing_cols, count(*) AS n_rows FROM orders
            UNION ALL SELECT 'dataset', 'archive/chicago_2001', 'chicago', 'processed', '', count(*) FROM orders WHERE o_orderstatus = 'F'
            UNION ALL SELECT 'dataset', 'la_arrests', 'la_arrests', 'processed', '', count(*) FROM events
            UNION ALL SELECT 'dataset', 'partial', 'chicago', 'invalid', '{MISSING_CHICAGO}', count(*) FROM supplier
            UNION ALL SELECT 'dataset', 'other', 'unknown', 'unknown', '', count(*) FROM nation
            UNION ALL SELECT 'dataset', 'broken', NULL, 'unreadable', NULL, NULL
            UNION ALL SELECT 'type', 'chicago', 'chicago', 'cleaned', NULL, count(DISTINCT o_orderkey) FROM orders
            UNION ALL SELECT 'type', 'la_arrests', 'la_arrests', 'cleaned', NULL, count(DISTINCT event_id) FROM events""",
        "best_match_names": """WITH p AS (SELECT p_partkey, concat_ws(' ', p_name, lower(p_type)) AS f FROM part),
            x AS (SELECT p_partkey, translate(f, 'aeiou', '') AS short FROM p),
            t AS (SELECT DISTINCT f AS t FROM p),
            s AS (SELECT short, t, CASE WHEN greatest(length(short), length(t)) = 0 THEN 1.0::DOUBLE
                ELSE 1.0::DOUBLE - levenshtein(lower(short), lower(t)) / greatest(length(short), length(t)) END AS sc
                FROM (SELECT DISTINCT short FROM x), t),
            b AS (SELECT * FROM s WHERE sc >= 0.55::DOUBLE AND sc > 0
                QUALIFY row_number() OVER (PARTITION BY short ORDER BY sc DESC, t) = 1)
            SELECT p_partkey, x.short, t AS best_target, round(sc, 9) AS best_score FROM x JOIN b ON x.short = b.short""",
    }


NUMERIC = ["latitude", "longitude", "year", "hour", "day_of_week", "month", "lat_rounded", "lon_rounded",
           "crime_subtype_freq", "location_type_freq", "district_hour_crime_count"]


def features_sql() -> str:
    """M5 over events x customer, step for step with create_features."""
    z = ",\n    ".join(f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}"
                       for c in NUMERIC)
    return f"""WITH inc AS (
    SELECT CAST(e.event_id AS VARCHAR) AS incident_id, e.ts AS incident_datetime, e.event_type AS crime_category,
        c.c_mktsegment AS crime_subtype, CASE WHEN e.value > 250 THEN 'high' ELSE 'low' END AS location_type,
        'block ' || CAST(e.user_id % 7 AS VARCHAR) AS block_address, CAST(c.c_nationkey AS BIGINT) AS district,
        CAST(e.user_id % 5 AS BIGINT) AS ward, CAST(e.user_id % 3 AS BIGINT) AS community_area,
        e.event_type = 'error' AS domestic_flag, e.value / 10.0::DOUBLE AS latitude,
        c.c_acctbal / 100.0::DOUBLE AS longitude, e.value > 100 AS arrest_made
    FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey),
base AS (SELECT *, CAST(hour(incident_datetime) AS INTEGER) AS hour,
        CAST(isodow(incident_datetime) - 1 AS INTEGER) AS day_of_week, CAST(month(incident_datetime) AS INTEGER) AS month,
        CASE WHEN isodow(incident_datetime) - 1 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
        CASE WHEN hour(incident_datetime) >= 22 OR hour(incident_datetime) <= 6 THEN 1 ELSE 0 END AS is_night,
        CAST(year(incident_datetime) AS BIGINT) AS year,
        round_even(latitude * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS lat_rounded,
        round_even(longitude * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS lon_rounded,
        coalesce(CAST(district AS VARCHAR), 'nan') AS dk, coalesce(CAST(ward AS VARCHAR), 'nan') AS wk,
        coalesce(CAST(community_area AS VARCHAR), 'nan') AS ck FROM inc),
f1 AS (SELECT *,
        CASE WHEN crime_subtype IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY crime_subtype) END AS crime_subtype_freq,
        CASE WHEN location_type IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY location_type) END AS location_type_freq,
        CASE WHEN hour IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY dk, hour) END AS district_hour_crime_count,
        dense_rank() OVER (ORDER BY dk) - 1 AS district_code, dense_rank() OVER (ORDER BY wk) - 1 AS ward_code,
        dense_rank() OVER (ORDER BY ck) - 1 AS community_code FROM base),
sel AS (SELECT incident_id, crime_category, crime_subtype, location_type, district_code AS district, ward_code AS ward,
        community_code AS community_area, domestic_flag, latitude, longitude, year, hour, day_of_week, month,
        is_weekend, is_night, lat_rounded, lon_rounded, crime_subtype_freq, location_type_freq,
        district_hour_crime_count, arrest_made FROM f1),
kept AS (SELECT * FROM sel WHERE crime_category IS NOT NULL AND crime_subtype IS NOT NULL AND location_type IS NOT NULL
        AND district IS NOT NULL AND ward IS NOT NULL AND community_area IS NOT NULL AND domestic_flag IS NOT NULL
        AND latitude IS NOT NULL AND longitude IS NOT NULL AND year IS NOT NULL AND hour IS NOT NULL
        AND day_of_week IS NOT NULL AND month IS NOT NULL AND is_weekend IS NOT NULL AND is_night IS NOT NULL
        AND lat_rounded IS NOT NULL AND lon_rounded IS NOT NULL AND crime_subtype_freq IS NOT NULL
        AND location_type_freq IS NOT NULL AND district_hour_crime_count IS NOT NULL AND arrest_made IS NOT NULL)
SELECT incident_id,
    dense_rank() OVER (ORDER BY coalesce(crime_category, 'nan')) - 1 AS crime_category,
    dense_rank() OVER (ORDER BY coalesce(crime_subtype, 'nan')) - 1 AS crime_subtype,
    dense_rank() OVER (ORDER BY coalesce(location_type, 'nan')) - 1 AS location_type,
    district, ward, community_area, CAST(domestic_flag AS INTEGER) AS domestic_flag,
    CAST(is_weekend AS INTEGER) AS is_weekend, CAST(is_night AS INTEGER) AS is_night,
    CAST(arrest_made AS INTEGER) AS arrest_made,
    {z}
FROM kept"""


TABLE_DTYPES = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
}


def schema_catalog_sql() -> str:
    from schemaweave.constants import ABBREVIATION_RULES
    from schemaweave.plans.schema_catalog import PROFILED_TABLES
    cells, ratios = [], []
    for name, key in PROFILED_TABLES.items():
        for i, (c, t) in enumerate(TABLE_DTYPES[name], start=1):
            cells.append(f"SELECT {q(name)} AS dataset, {key} AS pos, {q(c)} AS col, "
                         f"{strip_ws(f'CAST({c} AS VARCHAR)')} AS value FROM {name}")
            ratios.append(f"SELECT {q(name)} AS dataset, {q(c)} AS col, {q(t)} AS dtype, CAST({i} AS INTEGER) AS pos, "
                          f"round(count({c}) / count(*), 6) AS non_null_ratio FROM {name}")
    e, tr = expanded("normalized_column_name", ABBREVIATION_RULES)
    return f"""WITH cells AS ({' UNION ALL '.join(cells)}),
firsts AS (SELECT dataset, col, value, min(pos) AS pos FROM cells WHERE value IS NOT NULL AND value <> ''
    GROUP BY dataset, col, value),
top AS (SELECT *, row_number() OVER (PARTITION BY dataset, col ORDER BY pos, value) AS rn FROM firsts),
samples AS (SELECT dataset, col, string_agg(value, ' | ' ORDER BY rn) AS sample_values FROM top WHERE rn <= 5
    GROUP BY dataset, col),
ratios AS ({' UNION ALL '.join(ratios)}),
prof AS (SELECT r.dataset AS dataset_key, r.col AS original_column_name, r.dtype AS inferred_dtype,
    r.non_null_ratio AS non_null_ratio_est, coalesce(s.sample_values, '') AS sample_values, r.pos,
    {ambiguous('r.col')} AS flag_ambiguous_or_abbrev,
    {normalized('r.col')} AS normalized_column_name, {norm_trace('r.col')} AS normalization_steps
    FROM ratios r LEFT JOIN samples s ON s.dataset = r.dataset AND s.col = r.col)
SELECT *, {e} AS expanded_column_name, {tr} AS abbreviation_rules_applied FROM prof"""


def catalog_pairs_sql() -> str:
    from schemaweave.plans.oracle import jaccard
    return f"""WITH cat AS ({schema_catalog_sql()}),
ent AS (SELECT dataset_key AS city, expanded_column_name AS column_final FROM cat),
pairs AS (SELECT l.city AS left_city, r.city AS right_city, l.column_final AS left_column_final,
    r.column_final AS right_column_final FROM ent l JOIN ent r ON l.city < r.city)
SELECT left_city, right_city, left_column_final, right_column_final,
    {jaccard(tokens('left_column_final'), tokens('right_column_final'))} AS lexical_jaccard,
    CASE WHEN left_column_final = right_column_final THEN 1 ELSE 0 END AS exact_match FROM pairs"""
