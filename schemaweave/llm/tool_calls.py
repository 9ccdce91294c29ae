"""Tool-call linking, native: identifiers, order, schemas, canonical JSON.

Calls and results are joined by conversation and identifier: equal identifiers of
two conversations are two calls, and a null conv_id is one conversation.  Calls of a conversation are ordered
topologically: a call comes after the calls it depends on, else in the order of
turns.  Arguments are JSON, checked against a table of parameters (tool, param,
kind, required), and every call is written as one line of canonical JSON (keys
sorted, no white space) through the variant type.

Calls: conv_id, turn, call_id, tool, arguments (JSON text), depends_on (call_id or
null, of the same conversation).  Results: conv_id, call_id, turn, content.  Repeated calls or
results of one conversation and identifier: the smallest row stands, with the count (n_calls, n_results).  A
dependency that does not exist, or on the call itself, is no constraint.  Calls
on a cycle have no position (null) and the error ``cycle``.  Null or malformed
arguments give the error ``arguments``; a tool without parameters in the schema
table gives ``tool``.  Results without a call are returned with kind ``result``.
Null identifiers never link: such calls and results are left out and counted by
``unlinked``.  Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.llm.common import WORD, materialise, range_ranked, table


def unlinked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """How many rows have no identifier: (kind, n)."""
    n = lambda df, kind: df.where(F.col("call_id").isNull()).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(calls, "call").union(n(results, "result"))


def argument_errors(calls: DataFrame, schema: DataFrame) -> DataFrame:
    """(key, errors): sorted error texts of the calls that have any."""
    schema = schema.select(F.col("tool").alias("s_tool"), "param", "kind", "required")
    args = calls.select("key", "tool", F.try_parse_json("arguments").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    bad = args.where(~is_object).select("key", F.lit("arguments").alias("e"))
    good = args.where(is_object)
    tools = schema.select(F.col("s_tool").alias("tool")).distinct()
    no_tool = good.join(tools, "tool", "left_anti").select("key", F.lit("tool").alias("e"))
    good = good.join(tools, "tool", "left_semi")
    given = (good.alias("g").lateralJoin(good.sparkSession.tvf.variant_explode(F.col("v").outer()).alias("e"))
             .select("g.key", "tool", F.col("e.key").alias("param"), F.regexp_extract(F.schema_of_variant("e.value"), "^[A-Z]+", 0).alias("type"))
             .where("param is not null"))
    kind = (F.when(F.col("type").isin("BIGINT"), "integer").when(F.col("type").isin("DECIMAL", "DOUBLE", "FLOAT"), "number")
            .when(F.col("type") == "STRING", "string").when(F.col("type") == "BOOLEAN", "boolean")
            .when(F.col("type") == "ARRAY", "array").when(F.col("type") == "OBJECT", "object").otherwise("null"))
    given = given.select("key", "tool", "param", kind.alias("is_kind"))
    known = given.join(schema.withColumnRenamed("s_tool", "tool"), ["tool", "param"], "left")
    fits = (F.col("is_kind") == F.col("kind")) | ((F.col("kind") == "number") & (F.col("is_kind") == "integer")) \
        | (~F.col("required") & (F.col("is_kind") == "null"))
    wrong = known.where(F.col("kind").isNull() | ~fits).select(
        "key", F.concat(F.when(F.col("kind").isNull(), F.lit("unknown ")).otherwise(F.lit("kind ")), "param").alias("e"))
    needed = good.select("key", "tool").join(schema.where("required").withColumnRenamed("s_tool", "tool"), "tool")
    missing = needed.join(given.select("key", "param"), ["key", "param"], "left_anti").select(
        "key", F.concat(F.lit("missing "), F.col("param")).alias("e"))
    return (bad.union(no_tool).union(wrong).union(missing).groupBy("key")
            .agg(F.sort_array(F.collect_set("e")).alias("errors")))


def topological_level(calls: DataFrame) -> DataFrame:
    """(key, level): the longest chain of dependencies before the call; null on or after a cycle.
    ``calls`` has key, needs (the key depended on, or null), conv (its conversation) and turn.

    Conversations whose dependencies all point to earlier turns need no levels
    (their turns are an order already) and get 0.  The others are peeled: in each
    round the calls whose dependencies are all placed get the next level.
    """
    calls = calls.select("conv", "key", "turn", "needs")
    other = calls.select(F.col("key").alias("needs"), F.col("turn").alias("d_turn"))
    edges = calls.join(other, "needs").where("key <> needs")
    back = edges.where("d_turn > turn or (d_turn = turn and needs >= key)").select("conv").distinct()
    hard = materialise(calls.join(back, "conv", "left_semi").select("key"), "calls-hard")
    easy = calls.join(hard, "key", "left_anti").select("key", F.lit(0).alias("level"))
    left = materialise(hard.join(edges.select("key", "needs"), "key", "left"), "calls-left")
    done, level = easy, 0
    while left.take(1):
        waits = left.join(left.select(F.col("key").alias("needs")).distinct(), "needs", "left_semi").select("key")
        free = materialise(left.select("key").distinct().join(waits.distinct(), "key", "left_anti"), "calls-free")
        if not free.take(1):
            break
        done = done.union(free.withColumn("level", F.lit(level)))
        left = materialise(left.join(free, "key", "left_anti"), "calls-left")
        level += 1
    return done


def link_tool_calls(calls: DataFrame, results: DataFrame, schema: DataFrame) -> DataFrame:
    """One row per conversation and call identifier (kind ``call``) and per result's without a call (kind ``result``)."""
    pick = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    calls = calls.where(F.col("call_id").isNotNull()).select(*pick, "call_id", "tool", "arguments", "depends_on")
    results = results.where(F.col("call_id").isNotNull()).select(*pick, "call_id", "content")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    keyed = lambda c: F.concat(conv, F.lit(":"), F.col(c).cast("string"))
    one = lambda df, cols, n: (df.withColumn("key", keyed("call_id")).groupBy("key").agg(F.min(F.struct(*cols)).alias("r"), F.count(F.lit(1)).alias(n))
                               .select("key", *[F.col(f"r.{c}").alias(c) for c in cols], n))
    calls = one(calls, ["turn", "conv_id", "call_id", "tool", "arguments", "depends_on"], "n_calls")
    calls = materialise(calls.withColumns({"conv": conv, "needs": keyed("depends_on")}), "calls")
    results = one(results, ["turn", "conv_id", "call_id", "content"], "n_results").select(
        "key", F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), F.col("turn").alias("r_turn"), "content", "n_results")
    level = topological_level(calls)
    placed = calls.join(level, "key", "left")
    order = placed.where("level is not null").select(F.col("conv").alias("k"), "level", "turn", "call_id", "key")
    order = range_ranked(order, ["k"], ["level", "turn", "call_id"], name="calls-order").select("key", F.col("rank").alias("seq"))
    linked = (placed.join(results, "key", "full").join(order, "key", "left").join(argument_errors(calls, schema), "key", "left")
              .withColumn("call_id", F.coalesce("call_id", "r_call")))
    is_call = F.col("n_calls").isNotNull()
    cycle = is_call & F.col("level").isNull()
    errors = F.concat(F.when(cycle, F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")), F.coalesce("errors", F.array().cast("array<string>")))
    valid = is_call & (F.size(errors) == 0)
    # one variant for the whole line: its objects keep their keys sorted
    args = F.coalesce(F.when(F.try_parse_json("arguments").isNotNull(), F.to_json(F.try_parse_json("arguments"))), F.lit("null"))
    text = lambda c: F.coalesce(F.substring(F.to_json(F.struct(F.col(c).alias("x"))), 6, 1 << 30), F.lit("null}"))
    json = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.regexp_replace(text(c), r"\}$", ""))
    line = F.concat(F.lit('{"arguments":'), args, F.lit(',"id":'), json("call_id"), F.lit(',"name":'), json("tool"),
                    F.lit(',"result":'), json("content"), F.lit("}"))
    return linked.select(
        F.when(is_call, F.lit("call")).otherwise(F.lit("result")).alias("kind"), F.coalesce("conv_id", "r_conv").alias("conv_id"),
        F.coalesce("turn", "r_turn").alias("turn"), "call_id", "tool", "seq",
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        valid.alias("valid"), F.when(is_call, F.array_join(errors, ";")).alias("errors"), F.when(is_call, line).alias("canonical"))


#: Parameters of the two tools that stand for system and user turns.
SCHEMA = [("configure", "instructions", "string", True), ("configure", "turn", "integer", True),
          ("answer", "prompt", "string", True), ("answer", "words", "integer", True), ("answer", "turn", "integer", False)]


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a conversation table holds: a system turn configures,
    a user turn asks for an answer and depends on the call two turns earlier, and an
    assistant turn is the result of the call one turn earlier."""
    ident = lambda turn: F.concat_ws(":", F.lit("c"), F.col("conv_id").cast("string"), turn.cast("string"))
    known = turns.where("conv_id is not null and turn is not null")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    turn = F.col("turn").cast("long")
    ask = F.to_json(F.struct(words.alias("words"), F.col("text").alias("prompt"), turn.alias("turn")))
    put = F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("instructions")))
    system = F.col("role") == "system"
    calls = known.where(F.col("role").isin("system", "user")).select(
        "conv_id", "turn", ident(turn).alias("call_id"), F.when(system, F.lit("configure")).otherwise(F.lit("answer")).alias("tool"),
        F.when(system, put).otherwise(ask).alias("arguments"), F.when(~system, ident(turn - 2)).alias("depends_on"))
    results = known.where(F.col("role") == "assistant").select("conv_id", "turn", ident(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def other_turns(turns: DataFrame) -> DataFrame:
    """The turns that give no call and no result (another or no role, no conv_id or turn), as rows of kind ``turn``."""
    used = F.col("role").isin("system", "user", "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    none = F.lit(None).cast("string")
    return turns.where(~F.coalesce(used, F.lit(False))).select(
        F.lit("turn").alias("kind"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        none.alias("call_id"), none.alias("tool"), F.lit(None).cast("long").alias("seq"), F.lit(0).cast("long").alias("n_calls"),
        F.lit(0).cast("long").alias("n_results"), F.lit(False).alias("valid"), none.alias("errors"), none.alias("canonical"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived calls depend on earlier turns only and their arguments are written here, so of all checks
    only a missing text can fail; cycles, malformed JSON and unknown or mistyped parameters cannot occur."""
    turns = table(spark, sf_dir, "conversations")
    calls, results = conversation_calls(turns)
    schema = spark.createDataFrame(SCHEMA, "tool string, param string, kind string, required boolean")
    return link_tool_calls(calls, results, schema).unionByName(other_turns(turns))


ORACLE = r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, 'c:' || conv_id || ':' || turn AS call_id,
    CASE WHEN role = 'system' THEN 'configure' ELSE 'answer' END AS tool,
    CASE WHEN role = 'system' THEN
        '{' || CASE WHEN text IS NULL THEN '' ELSE '"instructions":' || CAST(to_json(text) AS VARCHAR) || ',' END || '"turn":' || turn || '}'
      ELSE '{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',' END || '"turn":' || turn ||
        ',"words":' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) || '}' END AS args,
    CASE WHEN text IS NULL THEN CASE WHEN role = 'system' THEN 'missing instructions' ELSE 'missing prompt' END ELSE '' END AS errors
  FROM t WHERE role IN ('system', 'user')),
c1 AS (SELECT call_id, count(*) AS n_calls, min({'tool': tool, 'args': args, 'conv_id': conv_id, 'turn': turn, 'errors': errors}) AS r FROM c GROUP BY call_id),
r1 AS (SELECT 'c:' || conv_id || ':' || (turn - 1) AS call_id, count(*) AS n_results, min(conv_id) AS r_conv, min(turn) AS r_turn,
    CASE WHEN count(text) < count(*) THEN NULL ELSE min(text) END AS content FROM t WHERE role = 'assistant' GROUP BY conv_id, turn)
SELECT CASE WHEN n_calls IS NULL THEN 'result' ELSE 'call' END AS kind, coalesce(c1.r.conv_id, r_conv) AS conv_id,
  coalesce(c1.r.turn, r_turn) AS turn, coalesce(c1.call_id, r1.call_id) AS call_id, c1.r.tool AS tool,
  CASE WHEN n_calls IS NOT NULL THEN row_number() OVER (PARTITION BY c1.r.conv_id ORDER BY c1.r.turn) - 1 END AS seq,
  coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, n_calls IS NOT NULL AND c1.r.errors = '' AS valid,
  c1.r.errors AS errors,
  CASE WHEN n_calls IS NOT NULL THEN '{"arguments":' || c1.r.args || ',"id":"' || c1.call_id || '","name":"' || c1.r.tool || '","result":' ||
    coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' END AS canonical
FROM c1 FULL JOIN r1 ON c1.call_id = r1.call_id
UNION ALL
SELECT 'turn', CAST(conv_id AS BIGINT), CAST(turn AS BIGINT), NULL, NULL, NULL, 0, 0, false, NULL, NULL FROM conversations
WHERE conv_id IS NULL OR turn IS NULL OR role IS NULL OR role NOT IN ('system', 'user', 'assistant')
"""
