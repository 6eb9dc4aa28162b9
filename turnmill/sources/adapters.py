"""The operators' tables, derived by Spark from the given star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """One turn for each order; the session is its customer."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    started = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 86400) * 1000
    first = F.substring("o_orderpriority", 1, 1)
    tier = F.when(first == "1", "frontier").when(first == "2", "deep").when(first == "3", "balanced").when(first == "4", "fast")
    prompt = F.floor(F.col("o_totalprice") / 10)
    return o.select(
        F.col("o_orderkey").alias("turn_id"), F.col("o_custkey").alias("session_id"), F.col("c_mktsegment").alias("source"), F.concat(F.lit("h"), F.col("o_custkey") % 4).alias("host"),
        started.alias("started_at"), F.when(F.col("o_orderkey") % 3 != 0, started + F.floor("o_totalprice")).alias("ended_at"), tier.alias("tier"),
        F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "error").alias("outcome"), F.floor("o_totalprice").alias("wall_ms"), prompt.alias("prompt_tokens"),
        F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_totalprice") / 40)).alias("completion_tokens"), F.lit(200000).cast("long").alias("context_window"),
        F.when(F.col("o_orderkey") % 5 != 0, prompt * 4).alias("context_peak"), (F.col("o_orderkey") % 11 == 0).cast("int").alias("judged"), (F.col("o_orderkey") % 13 == 0).cast("int").alias("is_subagent"),
    )


TURNS = """turns AS (
    SELECT o_orderkey AS turn_id, o_custkey AS session_id, c_mktsegment AS source, 'h' || (o_custkey % 4) AS host,
        epoch_ms(o_orderdate) + (o_orderkey % 86400) * 1000 AS started_at,
        CASE WHEN o_orderkey % 3 <> 0 THEN epoch_ms(o_orderdate) + (o_orderkey % 86400) * 1000 + CAST(floor(o_totalprice) AS BIGINT) END AS ended_at,
        CASE o_orderpriority[1] WHEN '1' THEN 'frontier' WHEN '2' THEN 'deep' WHEN '3' THEN 'balanced' WHEN '4' THEN 'fast' END AS tier,
        CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'error' END AS outcome, CAST(floor(o_totalprice) AS BIGINT) AS wall_ms,
        CAST(floor(o_totalprice / 10) AS BIGINT) AS prompt_tokens, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice / 40) AS BIGINT) END AS completion_tokens,
        CAST(200000 AS BIGINT) AS context_window, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice / 10) AS BIGINT) * 4 END AS context_peak,
        CAST(o_orderkey % 11 = 0 AS INTEGER) AS judged, CAST(o_orderkey % 13 = 0 AS INTEGER) AS is_subagent
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """One event for each line item, its kind by line number."""
    n, even = F.col("l_linenumber"), F.col("l_suppkey") % 2 == 0
    kind = F.when(n == 5, "edit").when(n == 6, F.when(even, "revert").otherwise("compaction")).when(n == 7, F.when(even, "permission").otherwise("interrupt")).when(n == 8, "todo").when(n == 9, "critic").otherwise("tool_call")
    opened = F.floor(F.col("l_quantity") / 5)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("turn_id"), (F.unix_millis(F.col("l_shipdate").cast("timestamp")) + n).alias("ts"), kind.alias("kind"), F.concat(F.lit("tool"), F.col("l_suppkey") % 12).alias("name"),
        F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") != "N", 1).alias("ok"), F.when(kind.isin("edit", "revert"), F.concat(F.lit("p"), F.col("l_partkey") % 50)).alias("path"),
        F.when(kind == "permission", "deny").alias("decision"), F.when(kind == "critic", F.when(F.col("l_partkey") % 2 == 0, "fail").otherwise("pass")).alias("verdict"),
        F.when(kind == "todo", opened).alias("opened"), F.when(kind == "todo", F.least(opened, F.floor(F.col("l_tax") * 100))).alias("closed"), F.col("l_partkey").cast("string").alias("dedupe_id"),
    )


EVENTS = """timeline AS (
    SELECT l_orderkey AS turn_id, epoch_ms(l_shipdate) + l_linenumber AS ts, kind, 'tool' || (l_suppkey % 12) AS name,
        CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag <> 'N' THEN 1 END AS ok, CASE WHEN kind IN ('edit', 'revert') THEN 'p' || (l_partkey % 50) END AS path,
        CASE WHEN kind = 'permission' THEN 'deny' END AS decision, CASE WHEN kind = 'critic' THEN CASE WHEN l_partkey % 2 = 0 THEN 'fail' ELSE 'pass' END END AS verdict,
        CASE WHEN kind = 'todo' THEN CAST(floor(l_quantity / 5) AS BIGINT) END AS opened,
        CASE WHEN kind = 'todo' THEN least(CAST(floor(l_quantity / 5) AS BIGINT), CAST(floor(l_tax * 100) AS BIGINT)) END AS closed, CAST(l_partkey AS VARCHAR) AS dedupe_id
    FROM (SELECT *, CASE WHEN l_linenumber = 5 THEN 'edit' WHEN l_linenumber = 6 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'revert' ELSE 'compaction' END
        WHEN l_linenumber = 7 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'permission' ELSE 'interrupt' END WHEN l_linenumber = 8 THEN 'todo' WHEN l_linenumber = 9 THEN 'critic' ELSE 'tool_call' END AS kind FROM lineitem))"""

#: Openings that make rules of the text operators fire; by conv_id modulo their number.
OPENINGS = ["", "no, that's wrong: ", "you forgot to add ", "can you refactor everything in ", "why is ", "please fix src/main.py ", "actually I meant ", "research options and then improve ", "go ahead", "let's update the docs "]


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """(session, idx, text) of human turns, with an opening that depends on the conversation and turn."""
    c = table(spark, d, "conversations").filter(F.col("role") == "user")
    n = ((F.col("conv_id") + F.col("turn")) % len(OPENINGS)).cast("int")
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("idx"), F.concat(F.element_at(F.array(*map(F.lit, OPENINGS)), n + 1), F.coalesce("text", F.lit(""))).alias("text"))


PROMPTS = """prompts AS (SELECT conv_id AS session, turn AS idx, (%s)[(conv_id + turn) %% %d + 1] || coalesce(text, '') AS text FROM conversations WHERE role = 'user')""" % (
    "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in OPENINGS) + "]", len(OPENINGS),
)


def actions(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, ts ms, kind, value, seq) of the event stream."""
    return table(spark, d, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("kind"), "value", F.col("event_id").alias("seq"))


ACTIONS = "actions AS (SELECT user_id, epoch_us(ts) // 1000 AS ts, event_type AS kind, value, event_id AS seq FROM events)"
