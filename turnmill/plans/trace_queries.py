"""Queries over timelines, keyed writes, scope measures, arms and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, health, keyed, policy, review, scope, trace
from ..sources.adapters import ACTIONS, EVENTS, PROMPTS, TURNS, actions, prompts, table, timeline, turns
from ..streaming import ingest
from .queries import query
from .score_queries import SCORED, rounded, scored
from .text_queries import _sql_families

NOW = 915_148_800_000


@query("w2_turn_windows", f"WITH {TURNS} SELECT session_id, turn_id, started_at AS lo, coalesce(ended_at, lead(started_at) OVER (PARTITION BY session_id ORDER BY started_at, turn_id)) AS hi FROM turns")
def w2(spark, d):
    return trace.turn_windows(turns(spark, d))


def usage_rows(spark, d):
    e = actions(spark, d)
    return e.select(F.col("user_id").alias("session_id"), "seq", "ts", F.when(F.col("kind") != "error", F.concat("kind", F.lit("-"), F.floor(F.col("seq") / 400))).alias("message_id"), F.floor("value").alias("tokens"), F.lit("m").alias("model"), F.col("seq").alias("line"))


USAGE = f"{ACTIONS}, rows_ AS (SELECT user_id AS session_id, seq AS line, ts, CASE WHEN kind <> 'error' THEN kind || '-' || CAST(floor(seq / 400) AS BIGINT) END AS message_id FROM actions)"


@query("w4_usage_groups", f"""WITH {USAGE}, a AS (SELECT *, lag(ts) OVER w AS prev, message_id IS NULL OR row_number() OVER (PARTITION BY session_id, message_id ORDER BY line) = 1 AS closer FROM rows_ WINDOW w AS (PARTITION BY session_id ORDER BY line)),
    b AS (SELECT *, sum(CAST(closer AS INTEGER)) OVER (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS cc FROM a), c AS (SELECT *, min(cc) OVER (PARTITION BY session_id, message_id) AS low FROM b WHERE message_id IS NOT NULL),
    g AS (SELECT session_id, message_id, min(line) AS line, arg_min(struct_pack(p := prev), line).p AS s, arg_max(ts, line) AS ended_at, count(*) AS n_rows FROM c WHERE cc = low GROUP BY 1, 2)
    SELECT session_id, message_id, line, ended_at, n_rows, CASE WHEN ended_at - s BETWEEN 0 AND 900000 THEN ended_at - s END AS model_ms FROM g""")
def w4(spark, d):
    return trace.usage_groups(usage_rows(spark, d).drop("seq", "tokens", "model"))


_ONE = f"""{ACTIONS}, a0 AS (SELECT seq AS line, ts, CASE WHEN kind <> 'error' THEN kind || '-' || CAST(floor(seq / 40) AS BIGINT) END AS message_id FROM actions), f AS (SELECT message_id, min(line) AS line, true AS first FROM a0 WHERE message_id IS NOT NULL GROUP BY 1)"""


@query("w4_one_session", f"""WITH {_ONE}, b AS (SELECT a0.*, lag(ts) OVER (ORDER BY a0.line) AS prev, sum(CASE WHEN a0.message_id IS NULL OR first THEN 1 ELSE 0 END) OVER (ORDER BY a0.line ROWS UNBOUNDED PRECEDING) AS cc FROM a0 LEFT JOIN f ON f.line = a0.line),
    c AS (SELECT *, min(cc) OVER (PARTITION BY message_id) AS low FROM b WHERE message_id IS NOT NULL), g AS (SELECT message_id, min(line) AS line, arg_min(struct_pack(p := prev), line).p AS s, arg_max(ts, line) AS ended_at, count(*) AS n_rows FROM c WHERE cc = low GROUP BY 1)
    SELECT message_id, line, ended_at, n_rows, CASE WHEN ended_at - s BETWEEN 0 AND 900000 THEN ended_at - s END AS model_ms FROM g""")
def w4_one(spark, d):
    """All events as one session."""
    rows = usage_rows(spark, d).select(F.lit("all").alias("session_id"), "line", "ts", F.when(F.col("message_id").isNotNull(), F.concat(F.split_part("message_id", F.lit("-"), F.lit(1)), F.lit("-"), F.floor(F.col("line") / 40))).alias("message_id"))
    return trace.usage_groups(rows).drop("session_id")


@query("w5_edit_episodes", f"""WITH {EVENTS}, e AS (SELECT turn_id % 100 AS session_id, ts, path, path IS DISTINCT FROM lag(path) OVER (PARTITION BY turn_id % 100 ORDER BY ts, path) AS fresh FROM timeline WHERE kind = 'edit')
    SELECT session_id, path, CAST(sum(CAST(fresh AS INTEGER)) AS BIGINT) AS episodes FROM e GROUP BY 1, 2""")
def w5(spark, d):
    e = timeline(spark, d).filter("kind = 'edit'").select((F.col("turn_id") % 100).alias("session_id"), "ts", "path")
    return trace.edit_episodes(e)


@query("j5_attribute_asof", f"""WITH {TURNS}, w AS (SELECT session_id, turn_id, started_at AS lo, coalesce(ended_at, lead(started_at) OVER (PARTITION BY session_id ORDER BY started_at, turn_id)) AS hi FROM turns),
    r AS (SELECT o_orderkey AS row_id, o_custkey AS session_id, epoch_ms(o_orderdate) + (o_orderkey % 90000) * 1000 + 500 AS ts FROM orders)
    SELECT row_id, ts, CASE WHEN hi IS NULL OR ts < hi THEN turn_id END AS turn_id FROM (SELECT r.row_id, r.ts, w.turn_id, w.hi, row_number() OVER (PARTITION BY r.row_id ORDER BY w.lo DESC NULLS LAST, w.turn_id DESC) AS k FROM r LEFT JOIN w ON w.session_id = r.session_id AND w.lo <= r.ts) WHERE k = 1""")
def j5(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("session_id"), (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 90000) * 1000 + 500).alias("ts"), F.col("o_orderkey").alias("row_id"))
    return trace.attribute_asof(rows, trace.turn_windows(turns(spark, d))).select("row_id", "ts", "turn_id")


def calls(spark, d):
    e = timeline(spark, d).filter("kind = 'tool_call'")
    return e.select((F.col("turn_id") % 200).alias("session_id"), F.concat_ws("-", "turn_id", F.floor(F.col("ts") / 10_000_000_000)).alias("message_id"), "name", (F.col("ok") == 0).cast("int").alias("is_error"), F.col("ok").isNotNull().alias("matched"), F.col("dedupe_id").alias("target"))


CALLS = f"{EVENTS}, calls AS (SELECT turn_id % 200 AS session_id, turn_id || '-' || CAST(floor(ts / 10000000000) AS BIGINT) AS message_id, name, CAST(ok = 0 AS INTEGER) AS is_error, ok IS NOT NULL AS matched, dedupe_id AS target FROM timeline WHERE kind = 'tool_call')"


@query("a14_batch_stats", f"WITH {CALLS}, s AS (SELECT message_id, count(*) AS size FROM calls GROUP BY 1) SELECT count(*) FILTER (size = 1) AS single, count(*) FILTER (size > 1) AS multi, CAST(sum(size) FILTER (size > 1) AS BIGINT) AS batched_calls, round(sum(size) FILTER (size > 1) / sum(size), 6) AS batch_rate FROM s")
def a14(spark, d):
    return rounded(trace.batch_stats(calls(spark, d)), "batch_rate")


@query("a15_repeated_targets", f"WITH {CALLS} SELECT name, target, count(*) AS n FROM calls GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, name, target LIMIT 20")
def a15(spark, d):
    return trace.repeated_targets(calls(spark, d))


@query("a16_failure_stats", f"WITH {CALLS} SELECT name, count(*) AS total, count(*) FILTER (matched AND is_error = 1) AS errored, count(*) FILTER (NOT matched) AS unmatched, CAST(grouping(name) AS INTEGER) AS overall, round(count(*) FILTER (matched AND is_error = 1) / count(*), 6) AS error_rate, round(count(*) FILTER (NOT matched) / count(*), 6) AS unmatched_rate FROM calls GROUP BY ROLLUP (name)")
def a16(spark, d):
    return rounded(trace.failure_stats(calls(spark, d)).withColumn("overall", F.col("overall").cast("int")), "error_rate", "unmatched_rate")


@query("w7_hash_changes", f"WITH {ACTIONS}, a AS (SELECT user_id, kind, lag(kind) OVER (PARTITION BY user_id ORDER BY ts, seq) AS b FROM actions) SELECT user_id, count(*) FILTER (b IS NOT NULL AND b <> kind) AS changes FROM a GROUP BY 1")
def w7(spark, d):
    return trace.hash_changes(actions(spark, d), "user_id", "kind", ["ts", "seq"])


@query("u1_fold_turns", """WITH r AS (SELECT o_custkey AS turn_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS outcome, CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS wall_ms, CASE WHEN o_orderkey % 4 = 0 THEN 1 END AS flagged, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS tier FROM orders)
    SELECT turn_id, arg_max(outcome, seq) FILTER (outcome IS NOT NULL) AS outcome, arg_max(wall_ms, seq) FILTER (wall_ms IS NOT NULL) AS wall_ms, coalesce(arg_max(flagged, seq) FILTER (flagged IS NOT NULL), 0) AS flagged, arg_max(struct_pack(t := tier), seq).t AS tier FROM r GROUP BY 1""")
def u1(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("turn_id"), k.alias("seq"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("outcome"), F.when(k % 2 == 0, F.floor("o_totalprice")).alias("wall_ms"), F.when(k % 4 == 0, 1).alias("flagged"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("tier"))
    return keyed.fold_turns(o)


@query("u2_dedup_events", f"WITH {EVENTS} SELECT turn_id, ts, kind, name, dedupe_id, min(coalesce(ok, -1)) AS ok FROM timeline GROUP BY 1, 2, 3, 4, 5")
def u2(spark, d):
    e = timeline(spark, d).withColumn("ok", F.coalesce("ok", F.lit(-1)))
    return keyed.dedup_events(e.select("turn_id", "ts", "kind", "name", "dedupe_id", "ok"), ["ok"])


@query("u8_latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def u8(spark, d):
    return keyed.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("u11_merge_append_only", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'peer' END AS o_orderstatus FROM orders")
def u11(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return keyed.merge_append_only(o.filter("o_orderkey % 2 = 0"), [o.withColumn("o_orderstatus", F.lit("peer")).withColumn("extra", F.lit(1))], ["o_orderkey"])


@query("u12_merge_mutable", "SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS at, CASE WHEN o_orderkey % 3 = 0 THEN 'peer' ELSE 'own' END AS side FROM orders")
def u12(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("at"), F.lit("own").alias("side"))
    peer = own.withColumn("at", F.col("at") + (F.col("o_orderkey") % 3 == 0).cast("long")).withColumn("side", F.lit("peer"))
    return keyed.merge_mutable(own, [peer], ["o_orderkey"], "at")


@query("u15_fold_heartbeats", f"WITH {ACTIONS} SELECT user_id AS session_id, 'h' AS host, arg_max(kind, ts) FILTER (seq % 3 = 0) AS goal, arg_max(kind, ts) FILTER (seq % 7 = 0) AS task, arg_max(kind, ts) AS status, min(ts) AS started_at, max(ts) AS heartbeat_at FROM actions GROUP BY 1")
def u15(spark, d):
    a = actions(spark, d)
    return keyed.fold_heartbeats(a.select(F.col("user_id").alias("session_id"), F.lit("h").alias("host"), "ts", F.when(F.col("seq") % 3 == 0, F.col("kind")).alias("goal"), F.when(F.col("seq") % 7 == 0, F.col("kind")).alias("task"), F.col("kind").alias("status")))


@query("u10_chain_rows")
def u10(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("h"), F.col("o_custkey") % 50).alias("host"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    return keyed.chain_rows(rows, ["seq", "o_orderstatus"])


@query("j2_pending_decisions", f"WITH {SCORED} SELECT turn_id FROM flags WHERE started_at >= 852076800000 AND turn_id % 4 <> 0")
def j2(spark, d):
    s = scored(spark, d)
    decided = s.filter("turn_id % 4 = 0").select("turn_id", F.lit("model_tier").alias("domain"))
    return review.pending_decisions(s, decided, "model_tier", 852_076_800_000).select("turn_id")


SUCCESS = f"s AS (SELECT tier || '-' || source AS bucket, ['frontier', 'deep', 'balanced', 'fast'][session_id % 4 + 1] AS chosen, kpi_score, started_at FROM flags), w AS (SELECT *, pow(0.5, greatest(0, (CAST({NOW} AS BIGINT) - started_at) / 86400000) / 30) AS w FROM s WHERE bucket IS NOT NULL AND started_at >= CAST({NOW} AS BIGINT) - CAST(180 AS BIGINT) * 86400000)"


def decided(spark, d):
    arms = F.array(*map(F.lit, ("frontier", "deep", "balanced", "fast")))
    return scored(spark, d).withColumn("bucket", F.concat("tier", F.lit("-"), "source")).withColumn("chosen", F.element_at(arms, (F.col("session_id") % 4 + 1).cast("int")))


@query("a8_success_table", f"WITH {SCORED}, {SUCCESS} SELECT bucket, chosen, round(sum(w * kpi_score) / sum(w), 6) AS mean, count(*) AS n FROM w GROUP BY 1, 2")
def a8(spark, d):
    return rounded(policy.success_table(decided(spark, d), NOW), "mean")


@query("a9_graduation", f"""WITH {SCORED}, a AS (SELECT *, ['frontier', 'deep', 'balanced', 'fast'][session_id % 4 + 1] AS chosen FROM flags)
    SELECT chosen, count(*) AS n, round(avg(kpi_score) FILTER (chosen IS NOT DISTINCT FROM tier), 6) AS agree, round(avg(kpi_score) FILTER (chosen IS DISTINCT FROM tier), 6) AS disagree, count(*) >= 20 AS cleared, round(avg(kpi_score) FILTER (chosen IS NOT DISTINCT FROM tier) - avg(kpi_score) FILTER (chosen IS DISTINCT FROM tier), 6) AS delta FROM a GROUP BY 1
    UNION ALL SELECT 'never', 0, NULL, NULL, false, NULL""")
def a9(spark, d):
    return rounded(policy.graduation_report(decided(spark, d), ["frontier", "deep", "balanced", "fast", "never"]), "agree", "disagree", "delta")


@query("p3_choose")
def p3(spark, d):
    t = turns(spark, d)
    said = prompts(spark, d).select((F.col("session") * 10 + F.col("idx")).alias("turn_id"), "text")
    rows = policy.features(t, said)
    s = rows.withColumn("bucket", policy.bucket()).join(scored(spark, d).select("turn_id", "kpi_score", "tier"), "turn_id").withColumnRenamed("tier", "chosen").filter("chosen is not null")
    return policy.choose(rows, [("fast", 0.1), ("balanced", 0.4), ("deep", 0.8), ("frontier", 1.0)], {"deep": {"verb_refactor": 0.4}, "fast": {"prompt_tokens": -0.3}}, policy.success_table(s, NOW))


EDITS = f"""{EVENTS}, sessions AS (SELECT DISTINCT session FROM prompts), edits AS (SELECT turn_id % (SELECT count(*) FROM sessions) AS session, ts, path, turn_id % 3 = 0 AS nested FROM timeline WHERE kind = 'edit'),
    ep AS (SELECT session, path, count(*) FILTER (fresh) AS n FROM (SELECT session, path, path IS DISTINCT FROM lag(path) OVER (PARTITION BY session ORDER BY ts, path) AS fresh FROM edits WHERE NOT nested) GROUP BY 1, 2),
    eb AS (SELECT session, path, count(*) FILTER (fresh) AS n FROM (SELECT session, path, path IS DISTINCT FROM lag(path) OVER (PARTITION BY session ORDER BY ts, path) AS fresh FROM edits) GROUP BY 1, 2)"""
_FAMILIES = ("negate", "missed", "repeat", "redirect")
BASELINE = f"""{PROMPTS}, {EDITS}, f AS (SELECT session, {_sql_families()} AS fam FROM prompts), g AS (SELECT session, count(*) AS turns, count(*) FILTER (fam <> '') AS corrections, {", ".join(f"count(*) FILTER (contains(fam, '{k}')) AS {k}" for k in _FAMILIES)} FROM f GROUP BY 1),
    b AS (SELECT g.*, coalesce(a.files, 0) AS files_edited, coalesce(a.again, 0) AS rework_files, coalesce(c.files, 0) AS files_edited_incl_sub, coalesce(c.again, 0) AS rework_files_incl_sub, coalesce(s.ops, 0) AS sub_edit_ops FROM g LEFT JOIN (SELECT session, count(*) AS files, count(*) FILTER (n >= 2) AS again FROM ep GROUP BY 1) a USING (session)
        LEFT JOIN (SELECT session, count(*) AS files, count(*) FILTER (n >= 2) AS again FROM eb GROUP BY 1) c USING (session) LEFT JOIN (SELECT session, count(*) AS ops FROM edits WHERE nested GROUP BY 1) s USING (session))"""


def baselines(spark, d):
    p = prompts(spark, d)
    n = p.select("session").distinct().agg(F.count("*").alias("n"))
    e = timeline(spark, d).filter("kind = 'edit'").crossJoin(n).select((F.col("turn_id") % F.col("n")).alias("session"), "ts", "path", (F.col("turn_id") % 3 == 0).alias("nested"))  # one row
    return scope.session_baseline(p, e.filter("not nested"), e.filter("nested"))


@query("a12_session_baseline", f"WITH {BASELINE} SELECT * FROM b")
def a12(spark, d):
    return baselines(spark, d)


@query("a13_corpus_baseline", f"""WITH {BASELINE} SELECT count(*) AS sessions, count(*) FILTER (turns >= 2) AS conversational, CAST(sum(turns) FILTER (turns >= 2) AS BIGINT) AS human_turns, CAST(sum(corrections) FILTER (turns >= 2) AS BIGINT) AS correction_turns, round(sum(corrections) FILTER (turns >= 2) / sum(turns) FILTER (turns >= 2), 6) AS per_turn,
    round(count(*) FILTER (turns >= 2 AND corrections > 0) / count(*) FILTER (turns >= 2), 6) AS per_session, {", ".join(f"CAST(coalesce(sum({k}) FILTER (turns >= 2), 0) AS BIGINT) AS {k}" for k in _FAMILIES)}, count(*) FILTER (files_edited >= 1) AS editing,
    {", ".join(f"CAST(sum(files_edited{x}) AS BIGINT) AS files_edited{x}, CAST(sum(rework_files{x}) AS BIGINT) AS rework_files{x}, round(sum(rework_files{x}) / sum(files_edited{x}), 6) AS rework_rate{x}" for x in ("", "_incl_sub"))} FROM b""")
def a13(spark, d):
    return rounded(scope.corpus_baseline(baselines(spark, d)), "per_turn", "per_session", "rework_rate", "rework_rate_incl_sub")


_COUNTS = {"found_total": "true", "late_discovered": "l_returnflag = 'R'", "rework_files": "l_returnflag = 'A' AND l_discount > 0.05", "questions_asked": "l_linenumber >= 6", "questions_valuable": "l_linenumber >= 6 AND l_returnflag = 'A'", "assumptions": "l_returnflag = 'N'", "assumptions_overridden": "l_returnflag = 'N' AND l_discount > 0.05", "divergence_flagged": "l_linenumber = 1", "divergence_kept": "l_linenumber = 1 AND l_returnflag = 'A'", "committed": "l_returnflag = 'A'", "non_goals": "l_linenumber = 2 AND l_returnflag = 'R'"}


#: Lines that a task holds to tell a turn's different files, or turns that it joins to theirs; with as many in each, its memory doesn't grow with the tables.
LINES = 500_000


def records(spark, d):
    given = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "turn_id")
    parts = max(max(given.count(), table(spark, d, "orders").count()) // LINES + 1, spark.sparkContext.defaultParallelism)
    files = given.repartition(parts, "turn_id", "l_partkey").groupBy("turn_id", "l_partkey").agg(*(F.count_if(F.expr(c)).alias(k) for k, c in _COUNTS.items()))
    lines = files.repartition(parts, "turn_id").groupBy("turn_id").agg(F.count("l_partkey").alias("files_edited"), *(F.sum(k).alias(k) for k in _COUNTS))
    t = turns(spark, d).repartition(parts, "turn_id").join(lines, "turn_id")
    verdict = F.when(F.col("outcome") == "ok", "pass").when(F.col("outcome") == "error", "fail").otherwise("silent")
    tier = F.when(F.col("tier") == "frontier", "full").when(F.col("tier") == "deep", "mini").otherwise("none")
    return t.select("turn_id", tier.alias("tier"), verdict.alias("verdict"), *_COUNTS, "files_edited", F.col("judged").alias("corrections"), F.col("completion_tokens").alias("ceremony_tokens"), F.when(F.col("judged") == 1, F.col("wall_ms")).alias("ceremony_ms"), F.when(F.col("outcome").isNotNull(), F.col("found_total")).alias("turns_to_done"), F.floor(F.col("started_at") / 1000).alias("created_at"))


RECORDS = f"""{TURNS}, l AS (SELECT l_orderkey AS turn_id, count(DISTINCT l_partkey) AS files_edited, {", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in _COUNTS.items())} FROM lineitem GROUP BY 1),
    r AS (SELECT CASE tier WHEN 'frontier' THEN 'full' WHEN 'deep' THEN 'mini' ELSE 'none' END AS tier, CASE outcome WHEN 'ok' THEN 'pass' WHEN 'error' THEN 'fail' ELSE 'silent' END AS verdict, l.*, judged AS corrections, completion_tokens AS ceremony_tokens, CASE WHEN judged = 1 THEN wall_ms END AS ceremony_ms, CASE WHEN outcome IS NOT NULL THEN found_total END AS turns_to_done, started_at // 1000 AS created_at FROM turns JOIN l USING (turn_id))"""
_RATIO = lambda a, b: f"round({a} / nullif({b}, 0), 6)"
_RATES = ", ".join([
    "count(*) AS rows, count(*) FILTER (verdict <> 'silent') AS observed_rows, count(*) FILTER (verdict = 'silent') AS unobserved_rows, count(*) FILTER (verdict = 'pass') AS healthy_rows, count(*) FILTER (verdict = 'fail') AS failed_rows",
    *(f"{_RATIO(f'sum({a})', 'count(*)' if b is None else f'sum({b})')} AS {k}" for k, a, b in scope.RATES), *(f"round(avg({c}), 6) AS {c}_mean" for c in scope.MEANS), *(f"count(*) FILTER (tier = '{t}') AS tier_{t}" for t in scope.TIERS),
    _RATIO("count(*) FILTER (verdict = 'pass')", "count(*) FILTER (verdict <> 'silent')") + " AS healthy_rate", "CASE WHEN count(*) FILTER (verdict <> 'silent') = 0 THEN 'silent' WHEN count(*) FILTER (verdict = 'fail') > 0 THEN 'fail' ELSE 'pass' END AS verdict",
    "count(*) FILTER (verdict <> 'silent') < 20 AS sample_warning", "CASE WHEN sum(found_total) > 0 AND count(ceremony_tokens) + count(ceremony_ms) = 0 THEN 'late_discovery_rate' ELSE '' END AS unpaired",
])


def _rated(df):
    return rounded(df, *(k for k, *_ in scope.RATES), *(f"{c}_mean" for c in scope.MEANS), "healthy_rate").withColumn("unpaired", F.array_join("unpaired", ","))


@query("a10_scope_aggregate", f"WITH {RECORDS} SELECT {_RATES} FROM r")
def a10(spark, d):
    return _rated(scope.scope_aggregate(records(spark, d)))


@query("a11_scope_by_tier", f"WITH {RECORDS}, q AS (SELECT * FROM r) SELECT r.tier, {_RATES.replace('(tier =', '(r.tier =')} FROM r GROUP BY r.tier")
def a11(spark, d):
    return _rated(scope.scope_by_tier(records(spark, d)))


@query("w12_gate_replay")
def w12(spark, d):
    return scope.replayed(prompts(spark, d)).select("session", "idx", "tier", "active", "next_corrected")


@query("l1_false_none")
def l1(spark, d):
    return scope.false_none(scope.replayed(prompts(spark, d)))


@query("l3_score_phrases")
def l3(spark, d):
    e = scope.replayed(prompts(spark, d))
    return scope.score_phrases(scope.mine_phrases(e, ["refactor"]), e)


def gold(spark, d):
    g = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return g.select("doc_id", F.col("source").alias("session"), F.col("quality").alias("label"), F.when(F.col("toxic") == 0, (F.col("n_chars") > 800).cast("int")).alias("prediction"), (F.col("lang") == "en").cast("int").alias("stratum"))


GOLD = "g AS (SELECT doc_id, source AS session, quality AS label, CASE WHEN toxic = 0 THEN CAST(n_chars > 800 AS INTEGER) END AS prediction, CAST(lang = 'en' AS INTEGER) AS stratum FROM documents JOIN labels USING (doc_id)), n AS (SELECT stratum, count(*) AS n FROM g GROUP BY 1), w AS (SELECT g.*, CASE WHEN stratum = 1 THEN 9000 ELSE 4000 END / n.n AS weight FROM g JOIN n USING (stratum))"


def weighted(spark, d):
    return evaluate.stratum_weights(gold(spark, d), {1: 9000, 0: 4000})


_CELLS = ", ".join(f"count(*) FILTER (prediction = {p} AND label = {y}) AS {k}, round(coalesce(sum(weight) FILTER (prediction = {p} AND label = {y}), 0), 6) AS w_{k}" for k, (p, y) in {"tp": (1, 1), "fp": (1, 0), "fn": (0, 1), "tn": (0, 0)}.items())


@query("e3_confusion", f"WITH {GOLD} SELECT {_CELLS}, count(*) FILTER (prediction IS NULL) AS abstained FROM w")
def e3(spark, d):
    return rounded(evaluate.confusion(weighted(spark, d)), "w_tp", "w_fp", "w_fn", "w_tn")


@query("e4_scores", f"""WITH {GOLD}, c AS (SELECT {_CELLS} FROM w), s AS (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, (tp + fp + fn + tn)::DOUBLE AS n FROM c), k AS (SELECT *, (tp + tn) / n AS acc, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS ch FROM s)
    SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(acc, 6) AS accuracy, round((acc - ch) / (1 - ch), 6) AS kappa, n, 'measured' AS verdict FROM k""")
def e4(spark, d):
    return rounded(evaluate.scores(evaluate.confusion(weighted(spark, d))), "precision", "recall", "accuracy", "kappa")


@query("e5_population_rate", f"WITH {GOLD} SELECT round(sum(weight * prediction) FILTER (prediction IS NOT NULL) / sum(weight) FILTER (prediction IS NOT NULL), 6) AS estimated, round(sum(weight * label) / sum(weight), 6) AS true_rate, round(coalesce(sum(weight) FILTER (prediction IS NOT NULL), 0), 4) AS answered, round(coalesce(sum(weight) FILTER (prediction IS NULL), 0), 4) AS abstained FROM w")
def e5(spark, d):
    return rounded(rounded(evaluate.population_rate(weighted(spark, d)), "estimated", "true_rate"), "answered", "abstained", places=4)


@query("e6_session_bootstrap")
def e6(spark, d):
    return evaluate.session_bootstrap(weighted(spark, d))


@query("e7_drift", f"WITH {GOLD} SELECT stratum, count(*) AS live, CASE WHEN stratum = 1 THEN 200 ELSE 100 END AS pinned, round(abs(count(*) - CASE WHEN stratum = 1 THEN 200 ELSE 100 END) / CASE WHEN stratum = 1 THEN 200 ELSE 100 END, 6) AS gap, abs(count(*) - CASE WHEN stratum = 1 THEN 200 ELSE 100 END) / CASE WHEN stratum = 1 THEN 200 ELSE 100 END > 0.02 AS drifted FROM g GROUP BY 1")
def e7(spark, d):
    return rounded(evaluate.drift(gold(spark, d), {1: 200, 0: 100}), "gap")


@query("e9_holdout_ledger", f"WITH {TURNS} SELECT turn_id AS report, source AS classifier, host AS version, started_at AS at, row_number() OVER (PARTITION BY source, host ORDER BY started_at, turn_id) AS spend_number, row_number() OVER (PARTITION BY source, host ORDER BY started_at, turn_id) = 1 AS independent FROM turns")
def e9(spark, d):
    t = turns(spark, d).select(F.col("turn_id").alias("report"), F.col("source").alias("classifier"), F.col("host").alias("version"), F.col("started_at").alias("at"))
    return evaluate.holdout_ledger(t)


@query("w14_latest_probe", f"WITH {ACTIONS}, p AS (SELECT user_id % 10 AS host, kind, ts, CAST(value > 10 AS BIGINT) AS ok, CAST(1 AS BIGINT) AS total FROM actions) SELECT host, kind, max(ts) AS ts, arg_max(ok, ts) AS ok, arg_max(total, ts) AS total FROM p GROUP BY 1, 2")
def w14(spark, d):
    return review.latest_probe(probes(spark, d))


def probes(spark, d):
    return actions(spark, d).select((F.col("user_id") % 10).alias("host"), "kind", "ts", (F.col("value") > 10).cast("long").alias("ok"), F.lit(1).cast("long").alias("total"))


@query("j4_expected_alive", f"WITH {TURNS} SELECT e AS source, l AS last, CASE WHEN l IS NULL THEN 'silent' ELSE 'ok' END AS status FROM (SELECT unnest(['MACHINERY', 'FURNITURE', 'NOBODY']) AS e) LEFT JOIN (SELECT source, max(started_at) AS l FROM turns WHERE started_at >= 820454400000 GROUP BY 1) ON source = e")
def j4(spark, d):
    return health.expected_alive(turns(spark, d), "source", ["MACHINERY", "FURNITURE", "NOBODY"], 820_454_400_000, "started_at")


@query("f13_vocab_violations", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'signup') GROUP BY 1")
def f13(spark, d):
    return health.vocab_violations(table(spark, d, "events"), "event_type", ["click", "view", "signup"])


@query("j12_snapshot_diff", "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 10 = 1 THEN 'missing' WHEN o_orderkey % 10 = 2 THEN 'added' ELSE 'changed' END AS state FROM orders WHERE o_orderkey % 10 IN (1, 2, 3)")
def j12(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha"))
    k = F.col("path") % 10
    return health.snapshot_diff(o.filter(k != 2), o.filter(k != 1).withColumn("sha", F.when(k == 3, "x").otherwise(F.col("sha"))))


@query("w17_fit_to_budget", "WITH c AS (SELECT conv_id, turn, sum(octet_length(encode(coalesce(text, ''))) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM conversations) SELECT conv_id, turn FROM c WHERE upto <= 3000")
def w17(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return health.fit_to_budget(c, F.col("text"), 3000, "conv_id", ["turn"]).select("conv_id", "turn")


@query("r3_one_session", f"""WITH {ACTIONS}, h AS (SELECT ts, seq, kind, kind IN ('purchase', 'error') AS stop FROM actions), a AS (SELECT *, coalesce(lag(stop) OVER (ORDER BY ts, seq), true) AS b FROM h), n AS (SELECT *, sum(CASE WHEN kind = 'signup' OR b THEN 1 ELSE 0 END) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS turn_no FROM a)
    SELECT CAST(turn_no AS BIGINT) AS turn_no, min(ts) AS started_at, max(ts) FILTER (stop) AS ended_at, max(ts) FILTER (stop) - min(ts) AS wall_ms, CASE max(kind) FILTER (stop) WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'error' END AS outcome, count(*) FILTER (kind = 'click') AS tools FROM n GROUP BY 1""")
def r3_one(spark, d):
    """All events as the hooks of one session."""
    return ingest.hook_sessions(as_hooks(spark, d, F.lit("all"))).drop("session_id")


def as_hooks(spark, d, session):
    """Events as hooks: sign-ups are prompts, purchases end a turn, errors fail it, clicks are results of tools, views calls."""
    hook = F.expr("CASE kind WHEN 'signup' THEN 'UserPromptSubmit' WHEN 'purchase' THEN 'Stop' WHEN 'error' THEN 'StopFailure' WHEN 'click' THEN 'PostToolUse' ELSE 'PreToolUse' END")
    return actions(spark, d).select(session.alias("session_id"), "ts", "seq", hook.alias("hook"))


@query("r3_hook_sessions", """WITH h AS (SELECT conv_id AS session_id, turn AS ts, turn AS seq, CASE role WHEN 'user' THEN 'UserPromptSubmit' WHEN 'assistant' THEN 'Stop' ELSE 'PostToolUse' END AS hook FROM conversations),
    a AS (SELECT *, hook = 'Stop' AS stop, coalesce(lag(hook = 'Stop') OVER (PARTITION BY session_id ORDER BY ts), true) AS b FROM h), n AS (SELECT *, sum(CAST(hook = 'UserPromptSubmit' OR b AS INTEGER)) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS turn_no FROM a)
    SELECT session_id, CAST(turn_no AS BIGINT) AS turn_no, min(ts) AS started_at, max(ts) FILTER (stop) AS ended_at, max(ts) FILTER (stop) - min(ts) AS wall_ms, CASE WHEN count(*) FILTER (stop) > 0 THEN 'ok' END AS outcome, count(*) FILTER (hook = 'PostToolUse') AS tools FROM n GROUP BY 1, 2""")
def r3(spark, d):
    c = table(spark, d, "conversations")
    hook = F.when(F.col("role") == "user", "UserPromptSubmit").when(F.col("role") == "assistant", "Stop").otherwise("PostToolUse")
    out = ingest.hook_sessions(c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ts"), F.col("turn").alias("seq"), hook.alias("hook")))
    return out.withColumn("wall_ms", F.when(F.col("ended_at").isNotNull(), F.col("wall_ms")))
