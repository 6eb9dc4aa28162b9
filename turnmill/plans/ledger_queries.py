"""Queries over sessions, decisions, steps and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import health, keyed, ledger, policy, review, scope
from ..sources import logs
from ..sources.adapters import ACTIONS, EVENTS, PROMPTS, TURNS, actions, prompts, table, timeline, turns
from .queries import query
from .score_queries import SCORED, rounded, scored

NOW = 1_706_659_200_000


@query("f3_turn_dossier", f"""WITH {TURNS}, {EVENTS}, {PROMPTS}, e AS (SELECT turn_id, count(*) AS n_events, min(ts) AS first_ts FROM timeline GROUP BY 1),
    x AS (SELECT session * 10 + idx AS turn_id, sha256(string_agg('prompt#' || session || ' ' || text, chr(10) ORDER BY session, text)) AS texts_sha FROM prompts GROUP BY 1)
    SELECT turn_id, coalesce(n_events, 0) AS n_events, first_ts, CASE WHEN judged = 1 THEN coalesce(outcome, 'silent') END AS verdict, texts_sha, coalesce('mode_delegation=' || source, '') || ',model_tier=' || coalesce(tier, 'none') AS decisions FROM turns LEFT JOIN e USING (turn_id) LEFT JOIN x USING (turn_id)""")
def f3(spark, d):
    t = turns(spark, d)
    texts = prompts(spark, d).select((F.col("session") * 10 + F.col("idx")).alias("turn_id"), F.lit("prompt").alias("kind"), F.col("session").alias("seq"), F.col("text").alias("body"))
    verdicts = t.filter("judged = 1").select("turn_id", F.coalesce("outcome", F.lit("silent")).alias("verdict"))
    chosen = lambda domain, c: t.select("turn_id", F.lit(domain).alias("domain"), c.alias("chosen"))
    decisions = chosen("model_tier", F.coalesce("tier", F.lit("none"))).unionByName(chosen("mode_delegation", F.col("source")))
    out = ledger.turn_dossier(t, timeline(spark, d), texts, verdicts, decisions)
    said = F.sha2(F.array_join(F.transform("texts", lambda x: F.concat(x["kind"], F.lit("#"), x["seq"], F.lit(" "), x["body"])), "\n"), 256)
    return out.select("turn_id", F.coalesce(F.array_size("events"), F.lit(0)).alias("n_events"), F.try_element_at("events", F.lit(1))["ts"].alias("first_ts"), "verdict", said.alias("texts_sha"), F.array_join(F.transform("decisions", lambda x: F.concat(x["domain"], F.lit("="), x["chosen"])), ",").alias("decisions"))


@query("f5_needs_backfill", f"WITH {TURNS} SELECT DISTINCT session_id FROM turns WHERE source = 'BUILDING' AND started_at >= 852076800000 AND (outcome IS NULL OR tier IS NULL OR completion_tokens IS NULL)")
def f5(spark, d):
    t = turns(spark, d).withColumn("model", F.col("tier")).withColumn("model_ms", F.col("completion_tokens"))
    return ledger.needs_backfill(t, 852_076_800_000, "BUILDING")


@query("f6_active_sessions", f"WITH {ACTIONS}, s AS (SELECT user_id AS session_id, max(ts) AS heartbeat_at FROM actions GROUP BY 1) SELECT session_id, heartbeat_at, round((CAST({NOW} AS BIGINT) - heartbeat_at) / 1000, 1) AS age_s FROM s WHERE heartbeat_at >= CAST({NOW} AS BIGINT) - 86400000")
def f6(spark, d):
    s = actions(spark, d).groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("heartbeat_at"))
    return health.active_sessions(s, 86_400, NOW)


@query("j1_scored_decisions", f"WITH {SCORED} SELECT turn_id, round(kpi_score, 6) AS kpi_score FROM flags WHERE started_at >= 852076800000 AND turn_id % 4 = 0")
def j1(spark, d):
    s = scored(spark, d)
    decisions = s.select("turn_id", F.when(F.col("turn_id") % 4 == 0, "model_tier").otherwise("skills").alias("domain"))
    return rounded(ledger.scored_decisions(decisions, s, "model_tier", 852_076_800_000).select("turn_id", "kpi_score"), "kpi_score")


@query("j7_latest_metrics", f"WITH {ACTIONS} SELECT user_id % 10 AS host, max(ts) AS ts, arg_max(value, ts) AS value FROM actions GROUP BY 1")
def j7(spark, d):
    return health.latest_metrics(actions(spark, d).select((F.col("user_id") % 10).alias("host"), "ts", "value"))


STEPS = """steps AS (SELECT l_orderkey AS turn_id, epoch_ms(l_shipdate) + l_linenumber * 1000 + l_suppkey % 1000 + l_partkey * 1000000 AS ts, CASE WHEN l_linenumber <= 5 THEN 'model_req' WHEN l_linenumber <= 7 THEN 'context_snapshot' ELSE 'mode_change' END AS kind, CAST(floor(l_quantity) AS BIGINT) AS q, l_partkey, l_suppkey, l_returnflag FROM lineitem)"""


@query("a19_fold_step_usage", f"""WITH {STEPS}, s AS (SELECT *, kind = 'model_req' AS step, CASE WHEN l_returnflag <> 'N' THEN 'h' || l_suppkey % 3 END AS hash FROM steps),
    h AS (SELECT turn_id, count(*) FILTER (b IS NOT NULL AND b <> hash) AS tools_hash_changes FROM (SELECT *, lag(hash) OVER (PARTITION BY turn_id ORDER BY ts) AS b FROM s WHERE step AND hash IS NOT NULL) GROUP BY 1)
    SELECT turn_id, CASE WHEN count(*) FILTER (step) > 0 THEN CAST(coalesce(sum(q * 10) FILTER (step), 0) AS BIGINT) END AS model_ms, nullif(count(*) FILTER (step), 0) AS requests, CASE WHEN count(*) FILTER (step) > 0 THEN CAST(coalesce(sum(q % 2) FILTER (step), 0) AS BIGINT) END AS retries,
        CASE WHEN count(*) FILTER (step) > 0 THEN CAST(coalesce(sum(l_partkey) FILTER (step), 0) AS BIGINT) END AS prompt_tokens, CASE WHEN count(*) FILTER (step) > 0 THEN CAST(coalesce(sum(l_suppkey) FILTER (step), 0) AS BIGINT) END AS completion_tokens, CASE WHEN count(*) FILTER (step) > 0 THEN CAST(coalesce(sum(q) FILTER (step), 0) AS BIGINT) END AS cached_tokens,
        CAST(coalesce(bool_or(l_returnflag = 'R') FILTER (step), false) AS INTEGER) AS estimated, min(q - 5) FILTER (step AND q >= 5) AS ttft_ms, max(l_partkey) FILTER (kind = 'context_snapshot' AND l_partkey > 0) AS context_peak,
        arg_max(q * 1000, ts) FILTER (kind = 'context_snapshot' AND q > 0) AS context_window, arg_max('m' || l_suppkey % 4, ts) FILTER (kind = 'mode_change') AS mode, any_value(tools_hash_changes) AS tools_hash_changes FROM s LEFT JOIN h USING (turn_id) GROUP BY 1""")
def a19(spark, d):
    n, q = F.col("l_linenumber"), F.floor("l_quantity")
    ts = F.unix_millis(F.col("l_shipdate").cast("timestamp")) + n * 1000 + F.col("l_suppkey") % 1000 + F.col("l_partkey") * 1_000_000
    kind = F.when(n <= 5, "model_req").when(n <= 7, "context_snapshot").otherwise("mode_change")
    e = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("turn_id"), ts.alias("ts"), kind.alias("kind"), (q * 10).alias("latency_ms"), (q % 2).alias("retries"), F.col("l_partkey").alias("prompt_tokens"), F.col("l_suppkey").alias("completion_tokens"), q.alias("cached_tokens"),
        (F.col("l_returnflag") == "R").alias("estimated"), (q - 5).alias("ttft_ms"), F.when(F.col("l_returnflag") != "N", F.concat(F.lit("h"), F.col("l_suppkey") % 3)).alias("tools_hash"), F.col("l_partkey").alias("used"), (q * 1000).alias("window"), F.concat(F.lit("m"), F.col("l_suppkey") % 4).alias("mode"),
    )
    return ledger.fold_step_usage(e)


@query("a20_judge_queue", f"WITH {SCORED} SELECT count(*) FILTER (flagged = 1 AND judged = 0 AND started_at >= 852076800000) AS backlog, (SELECT count(*) FROM timeline WHERE kind = 'interrupt' AND ok = 0 AND ts >= 852076800000) AS dropped, count(*) FILTER (flagged = 1 AND judged = 0 AND started_at >= 852076800000) <= 20 AS ok FROM flags")
def a20(spark, d):
    e = timeline(spark, d).withColumn("kind", F.when(F.col("kind") == "interrupt", "queue").otherwise(F.col("kind")))
    return health.judge_queue(scored(spark, d), e, since=852_076_800_000)


@query("a26_judge_rate", f"WITH {ACTIONS}, v AS (SELECT CASE kind WHEN 'click' THEN 'correction' WHEN 'view' THEN 'new' ELSE 'silent' END AS verdict FROM actions) SELECT count(*) FILTER (verdict = 'correction') AS corrections, count(*) FILTER (verdict = 'new') AS new, count(*) FILTER (verdict = 'silent') AS silent, round(count(*) FILTER (verdict = 'correction') / count(*) FILTER (verdict <> 'silent'), 6) AS rate, round(count(*) FILTER (verdict = 'silent') / count(*), 6) AS abstention FROM v")
def a26(spark, d):
    v = actions(spark, d).select(F.when(F.col("kind") == "click", "correction").when(F.col("kind") == "view", "new").otherwise("silent").alias("verdict"))
    return rounded(ledger.judge_rate(v), "rate", "abstention")


@query("a22_gate_summary", f"WITH {ACTIONS}, l AS (SELECT CAST(floor(ts / 86400000) AS BIGINT) AS day, CASE kind WHEN 'click' THEN 'none' WHEN 'view' THEN 'mini' WHEN 'signup' THEN 'full' END AS tier FROM actions) SELECT day, count(*) AS n, count(*) FILTER (tier <> 'none') AS ceremonial, round(count(*) FILTER (tier <> 'none') / count(*), 6) AS rate FROM l WHERE tier IS NOT NULL GROUP BY 1")
def a22(spark, d):
    log = actions(spark, d).select(F.floor(F.col("ts") / 86_400_000).alias("day"), F.when(F.col("kind") == "click", "none").when(F.col("kind") == "view", "mini").when(F.col("kind") == "signup", "full").alias("tier"))
    return rounded(scope.gate_summary(log), "rate")


@query("a28_scope_pass_counts", "SELECT l_orderkey AS pass_id, count(*) AS found_total, count(*) FILTER (l_returnflag = 'A') AS committed, count(*) FILTER (l_returnflag = 'N') AS non_goals, count(*) FILTER (l_returnflag = 'R') AS assumptions, count(*) FILTER (l_linenumber >= 5) AS late_discovered FROM lineitem GROUP BY 1")
def a28(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "committed").when(F.col("l_returnflag") == "N", "non_goal").otherwise("assumption")
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pass_id"), kind.alias("disposition"), F.col("l_linenumber").alias("ts"), F.lit(5).alias("began_at"))
    return ledger.scope_pass_counts(items)


@query("u9_append_scope_records", "SELECT CASE WHEN event_type = 'error' THEN 'suppressed' WHEN user_id % 3 = 0 THEN 'already_present' ELSE 'written' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def u9(spark, d):
    log = actions(spark, d).select(F.col("user_id").cast("string").alias("session_id"), F.col("seq").cast("string").alias("ts"), F.sha1(F.col("seq").cast("string")).alias("prompt_sha1"), F.when(F.col("kind") != "error", "mini").alias("tier"))
    none = spark.createDataFrame([], "record_id string")
    known = ledger.append_scope_records(log.filter("session_id % 3 = 0"), none)
    return ledger.append_scope_records(log, known).groupBy("outcome").agg(F.count("*").alias("n"))


@query("u16_fold_todos", f"""WITH {ACTIONS}, f AS (SELECT user_id, seq AS ts, CASE WHEN kind = 'error' THEN 'done' ELSE 'file' END AS op, CASE WHEN user_id % 2 = 0 THEN 'global' ELSE 'local' END AS scope, CASE WHEN value > 20 THEN user_id END AS key FROM actions),
    o AS (SELECT *, op = 'file' AND coalesce(lag(op) OVER (PARTITION BY user_id ORDER BY ts) = 'done', true) AS opens FROM f WHERE key IS NOT NULL),
    s AS (SELECT key, any_value(scope) AS scope, min(ts) FILTER (op = 'file') AS created_at, max(ts) FILTER (opens) AS opened_at, max(ts) FILTER (op = 'done') AS d, min(ts) FILTER (op = 'file') AS todo_id FROM o GROUP BY 1 HAVING count(*) FILTER (op = 'file') > 0)
    SELECT key, created_at, opened_at, scope, CASE WHEN scope = 'local' THEN 'r' || todo_id END AS repo, todo_id, CASE WHEN coalesce(d > opened_at, false) THEN 'done' ELSE 'open' END AS status, CASE WHEN d > opened_at THEN d END AS done_at FROM s
    UNION ALL SELECT NULL, ts, ts, scope, CASE WHEN scope = 'local' THEN 'r' || ts END, ts, 'open', NULL FROM f WHERE key IS NULL AND op = 'file'""")
def u16(spark, d):
    f = actions(spark, d).select(F.lit("s").alias("source"), F.when(F.col("value") > 20, F.col("user_id")).alias("key"), F.col("seq").alias("ts"), F.when(F.col("kind") == "error", "done").otherwise("file").alias("op"), F.col("seq").cast("string").alias("text"), F.col("seq").alias("todo_id"), F.when(F.col("user_id") % 2 == 0, "global").otherwise("local").alias("scope"), F.concat(F.lit("r"), "seq").alias("repo"))
    return keyed.fold_todos(f).select("key", "created_at", "opened_at", "scope", "repo", "todo_id", "status", "done_at")


@query("u17_replay_plans", f"""WITH RECURSIVE {ACTIONS}, c AS (SELECT user_id, seq, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS n, CAST(floor(value / 8) AS BIGINT) AS expected, kind FROM actions),
    r AS (SELECT user_id, n, seq, value > 2 AS accepted, CASE WHEN value > 2 THEN 1 ELSE 0 END AS revision, CASE WHEN value > 2 THEN 'draft' END AS status, false AS evident, CASE WHEN value > 2 THEN NULL ELSE 'goal must not be empty' END AS problem FROM c WHERE n = 1
        UNION ALL SELECT user_id, n, seq, problem IS NULL, CASE WHEN problem IS NULL THEN new ELSE rev END, CASE WHEN problem IS NULL THEN st ELSE old END, CASE WHEN problem IS NULL THEN ev ELSE evid END, problem FROM (
            SELECT c.user_id, c.n, c.seq, r.revision AS rev, r.status AS old, r.evident AS evid,
                CASE WHEN r.revision = 0 AND c.kind = 'error' THEN 1 ELSE r.revision + 1 END AS new, CASE c.kind WHEN 'signup' THEN 'done' WHEN 'purchase' THEN 'superseded' WHEN 'view' THEN 'active' WHEN 'error' THEN 'draft' ELSE r.status END AS st,
                CASE c.kind WHEN 'click' THEN c.value > 10 WHEN 'error' THEN false ELSE r.evident END AS ev,
                CASE WHEN c.kind = 'error' THEN CASE WHEN r.revision > 0 THEN 'there is a plan already' WHEN c.value <= 2 THEN 'goal must not be empty' END
                    WHEN r.revision = 0 THEN 'no plan' WHEN c.expected <> r.revision THEN 'conflict' WHEN c.kind = 'signup' AND NOT r.evident THEN 'stages lack evidence' WHEN c.kind = 'purchase' AND c.value < 12 THEN 'superseded by nothing' END AS problem
            FROM r JOIN c ON c.user_id = r.user_id AND c.n = r.n + 1))
    SELECT user_id, seq, accepted, problem, CAST(revision AS BIGINT) AS revision, status AS plan_status FROM r""")
def u17(spark, d):
    a = actions(spark, d)
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "seq")) == 1
    op = F.when(first | (F.col("kind") == "error"), "add").when(F.col("kind") == "click", "amend").otherwise("status")
    stage = F.struct(F.lit("s").alias("name"), F.lit("runs").alias("expected_check"), F.when((F.col("op") == "amend") & (F.col("value") > 10), "seen").alias("evidence"), F.lit(None).cast("string").alias("status"))
    status = F.when(F.col("op") == "status", F.when(F.col("kind") == "signup", "done").when(F.col("kind") == "purchase", "superseded").otherwise("active"))
    c = a.withColumn("op", op).select(
        F.col("user_id").alias("todo_id"), F.col("ts").alias("changed_at"), "seq", "op", F.floor(F.col("value") / 8).alias("expected_revision"), F.when(F.col("op") == "add", F.when(F.col("value") > 2, "go").otherwise(" ")).alias("goal"), F.when(F.col("op") != "status", F.array(stage)).alias("stages"),
        F.when(F.col("op") == "add", F.array().cast("array<string>")).alias("non_goals"), status.alias("status"), F.when((F.col("kind") == "purchase") & (F.col("value") >= 12), "t2").alias("superseded_by"),
    )
    return keyed.replay_plan_changes(c).select(F.col("todo_id").alias("user_id"), "seq", "accepted", "problem", "revision", "plan_status")


@query("w16_text_seq", "SELECT conv_id AS turn_id, role AS kind, turn AS at, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS seq FROM conversations")
def w16(spark, d):
    return ledger.text_seq(table(spark, d, "conversations").select(F.col("conv_id").alias("turn_id"), F.col("role").alias("kind"), F.col("turn").alias("at")))


@query("p4_shadow_decisions")
def p4(spark, d):
    s = scored(spark, d).withColumn("bucket", F.concat_ws(":", "source", "host"))
    return policy.shadow_decisions(s, [("fast", 0.1), ("balanced", 0.4), ("deep", 0.8)])


@query("l5_suppression_check")
def l5(spark, d):
    return ledger.apply_learning(prompts(spark, d), ["nicht", "pour"])


@query("d6_content_fingerprint", """WITH r AS (SELECT o_orderkey AS path, sha256(o_orderstatus || o_orderkey) AS sha FROM orders), p AS (SELECT sha256(path::VARCHAR)[1:2] AS p, sha256(string_agg(path || chr(9) || sha, chr(10) ORDER BY path::VARCHAR || chr(9) || sha)) AS digest, count(*) AS n FROM r GROUP BY 1)
    SELECT sha256(string_agg(p || chr(9) || digest, chr(10) ORDER BY p)) AS corpus_sha, CAST(sum(n) AS BIGINT) AS files FROM p""")
def d6(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.sha2(F.concat("o_orderstatus", "o_orderkey"), 256).alias("sha"))
    return logs.corpus_sha(rows)


@query("x1_search_index", "SELECT p_partkey AS id, p_name AS name, 'memory' AS kind FROM part WHERE lower(p_name) LIKE '%re_%' UNION ALL SELECT s_suppkey, s_name, 'skill' FROM supplier WHERE lower(s_name) LIKE '%re_%'")
def x1(spark, d):
    m = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("description"))
    k = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("description"))
    return health.search_index(m, k, "Re_").select("id", "name", "kind")


_SIGNAL = lambda name, where, by, n: f"SELECT 'signal_{name}', session_id || ' ' || {by}, CAST(count(*) AS DOUBLE) FROM e WHERE {where} GROUP BY session_id, {by} HAVING count(*) >= {n}"


@query("t5_review_sample", f"""WITH {SCORED}, {ACTIONS}, e AS (SELECT t.*, session_id FROM timeline t JOIN turns USING (turn_id)), f AS (SELECT turn_id, count(DISTINCT name) FILTER (kind = 'tool_call') AS tools, count(DISTINCT path) FILTER (kind IN ('edit', 'revert')) AS paths FROM timeline GROUP BY 1),
    x AS (SELECT turn_id, (1 + coalesce(tools, 0)) * (1 + coalesce(paths, 0)) * greatest(1, tokens) / 1000 AS complexity FROM flags LEFT JOIN f USING (turn_id) ORDER BY complexity DESC, started_at, turn_id LIMIT 10), l AS (SELECT turn_id, kpi_score FROM flags WHERE judged = 0 ORDER BY kpi_score, started_at, turn_id LIMIT 15),
    p AS (SELECT user_id % 10 AS host, kind, arg_max(CAST(value > 10 AS BIGINT), ts) AS ok FROM actions GROUP BY 1, 2),
    u AS (SELECT 'aggregate' AS part, 'turns' AS subject, CAST(count(*) AS DOUBLE) AS value FROM flags UNION ALL SELECT 'aggregate', 'tokens', sum(tokens) FROM flags UNION ALL SELECT 'aggregate', 'flagged', sum(flagged) FROM flags UNION ALL SELECT 'aggregate', 'judged', sum(judged) FROM flags
        UNION ALL SELECT 'aggregate', 'unjudged', count(*) FROM flags WHERE flagged = 1 AND judged = 0 UNION ALL SELECT 'aggregate', 'compactions', count(*) FROM e WHERE kind = 'compaction'
        UNION ALL SELECT 'complex', CAST(turn_id AS VARCHAR), complexity FROM x UNION ALL SELECT 'complex_dropped', '', greatest(0, count(*) - 10) FROM flags UNION ALL SELECT 'low_kpi', CAST(turn_id AS VARCHAR), kpi_score FROM l UNION ALL SELECT 'low_kpi_dropped', '', greatest(0, count(*) - 15) FROM flags WHERE judged = 0
        UNION ALL {_SIGNAL("repeated_tool_failure", "kind = 'tool_call' AND ok = 0", "name", 3)} UNION ALL {_SIGNAL("permission_denials", "kind = 'permission' AND decision = 'deny'", "''", 2)} UNION ALL {_SIGNAL("edit_revert_loop", "kind = 'revert'", "coalesce(path, '')", 2)}
        UNION ALL {_SIGNAL("repeated_interrupts", "kind = 'interrupt'", "''", 2)} UNION ALL SELECT 'signal_probe_' || kind, CAST(host AS VARCHAR), ok FROM p WHERE ok <> 1)
    SELECT part, subject, round(value, 6) AS value FROM u""")
def t5(spark, d):
    s = scored(spark, d)
    p = actions(spark, d).select((F.col("user_id") % 10).alias("host"), "kind", "ts", (F.col("value") > 10).cast("long").alias("ok"), F.lit(1).cast("long").alias("total"))
    return rounded(review.review_sample(s, timeline(spark, d), turns(spark, d).filter("judged = 1"), p), "value")


#: Prompts by turn, as p3_choose numbers them; several of one turn are joined in order.
SAID = f"{PROMPTS}, said AS (SELECT session * 10 + idx AS turn_id, string_agg(text, chr(10) ORDER BY session, idx) AS text FROM prompts GROUP BY 1)"


def featured(spark, d):
    own = prompts(spark, d).groupBy((F.col("session") * 10 + F.col("idx")).alias("turn_id")).agg(F.array_sort(F.collect_list(F.struct("session", "idx", "text"))).alias("p"))
    return policy.features(turns(spark, d), own.select("turn_id", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text")))


_VERBS = ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_]){v}') THEN '{v}' END" for v in text.VERBS)


@query("p2_prompt_features", f"""WITH {TURNS}, {SAID}, v AS (SELECT turn_id, list_filter([{_VERBS}], lambda x: x IS NOT NULL) AS verbs,
    len(list_filter(list_transform(regexp_extract_all(text, '[^\\s,;:()\\[\\]{{}}''"`]+'), lambda t: trim(t, '.,;:!?')), lambda t: contains(t, '/') OR regexp_matches(t, '\\.[A-Za-z]{{1,6}}$'))) AS file_refs FROM said)
    SELECT turn_id, 'unknown:' || coalesce(verbs[1], 'none') || ':' || CASE WHEN prompt_tokens < 1000 THEN 's' WHEN prompt_tokens < 4000 THEN 'm' ELSE 'l' END || ':' || CASE WHEN is_subagent = 1 THEN 'sub' ELSE 'top' END AS bucket,
        coalesce(array_to_string(verbs, ','), '') AS verbs, coalesce(file_refs, 0) AS file_refs, round(CASE WHEN context_peak IS NOT NULL THEN least(1.0, context_peak / context_window) ELSE 0 END, 6) AS occupancy FROM turns LEFT JOIN v USING (turn_id)""")
def p2_prompts(spark, d):
    rows = featured(spark, d)
    return rows.select("turn_id", policy.bucket().alias("bucket"), F.array_join("verbs", ",").alias("verbs"), "file_refs", F.round("occupancy", 6).alias("occupancy"))


@query("p2_features", f"""WITH {TURNS}, {SAID}, v AS (SELECT turn_id, list_filter([{_VERBS}], lambda x: x IS NOT NULL) AS verbs,
    len(list_filter(list_transform(regexp_extract_all(text, '[^\\s,;:()\\[\\]{{}}''"`]+'), lambda t: trim(t, '.,;:!?')), lambda t: contains(t, '/') OR regexp_matches(t, '\\.[A-Za-z]{{1,6}}$'))) AS file_refs FROM said)
    SELECT turn_id, 'unknown:' || coalesce(verbs[1], 'none') || ':' || CASE WHEN prompt_tokens < 1000 THEN 's' WHEN prompt_tokens < 4000 THEN 'm' ELSE 'l' END || ':' || CASE WHEN is_subagent = 1 THEN 'sub' ELSE 'top' END AS bucket,
        round(least(prompt_tokens / 8000, 1), 6) AS prompt_tokens, round(least(coalesce(file_refs, 0) / 10, 1), 6) AS file_refs, CAST(is_subagent AS DOUBLE) AS is_subagent, CASE WHEN context_peak IS NOT NULL THEN round(least(1.0, context_peak / context_window), 6) ELSE 0 END AS context_occupancy,
        round(hour(make_timestamp(started_at * 1000)) // 6 / 3, 6) AS hour_bucket, {", ".join(f"CAST(coalesce(list_contains(verbs, '{v}'), false) AS DOUBLE) AS verb_{v}" for v in text.VERBS)} FROM turns LEFT JOIN v USING (turn_id)""")
def p2(spark, d):
    rows = featured(spark, d).select("turn_id", policy.bucket().alias("bucket"), policy.vector().alias("v"))
    names = ["prompt_tokens", "file_refs", "is_subagent", "context_occupancy", "hour_bucket", *(f"verb_{v}" for v in text.VERBS)]
    return rows.select("turn_id", "bucket", *(F.round(F.col("v")[n], 6).alias(n) for n in names))
