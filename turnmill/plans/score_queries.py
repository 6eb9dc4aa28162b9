"""Queries over scored turns. Each SQL starts from the same views of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi, review
from ..sources.adapters import EVENTS, TURNS, timeline, turns
from .queries import query

#: 90 days, so that trailing windows of these sparse tables hold rows.
WINDOW = 90 * 86_400_000


def rounded(df, *names: str, places: int = 6):
    return df.withColumns({n: F.round(n, places) for n in names})


def scored(spark, d):
    return kpi.score_turns(turns(spark, d), timeline(spark, d), WINDOW)


FACTS = """facts AS (
    SELECT turn_id, count(*) FILTER (kind = 'tool_call') AS calls, count(*) FILTER (kind = 'tool_call' AND ok = 0) AS failed, count(*) FILTER (kind = 'edit') AS edits,
        count(*) FILTER (kind = 'edit') - count(DISTINCT path) FILTER (kind = 'edit') AS repeat_edits, count(*) FILTER (kind = 'revert') AS reverts, count(*) FILTER (kind = 'compaction') AS compactions,
        count(*) FILTER (kind = 'interrupt') AS interrupts, count(*) FILTER (kind = 'permission' AND decision = 'deny') AS denials, count(*) FILTER (kind = 'todo') AS todos,
        coalesce(sum(opened), 0) AS opened, coalesce(sum(closed), 0) AS closed, count(*) FILTER (kind = 'critic' AND verdict = 'fail') AS critic_fails
    FROM timeline GROUP BY turn_id)"""
BASE = f"""marks AS (SELECT source, tier, max(started_at) AS before FROM turns GROUP BY source, tier),
near AS (SELECT m.source, m.tier, t.wall_ms, t.prompt_tokens + coalesce(t.completion_tokens, 0) AS tokens FROM marks m JOIN turns t ON t.source = m.source AND (m.tier IS NULL OR t.tier = m.tier)
    AND t.started_at < m.before AND t.started_at >= m.before - CAST({WINDOW} AS BIGINT)),
base AS (SELECT m.source, m.tier, t.base_tokens, w.base_wall FROM marks m
    LEFT JOIN (SELECT source, tier, list_sort(list(tokens))[CAST(round_even(0.5 * (count(*) - 1), 0) AS INTEGER) + 1] AS base_tokens FROM near WHERE tokens > 0 GROUP BY source, tier) t ON t.source = m.source AND t.tier IS NOT DISTINCT FROM m.tier
    LEFT JOIN (SELECT source, tier, list_sort(list(wall_ms))[CAST(round_even(0.95 * (count(*) - 1), 0) AS INTEGER) + 1] AS base_wall FROM near GROUP BY source, tier) w ON w.source = m.source AND w.tier IS NOT DISTINCT FROM m.tier)"""
SCORED = f"""{TURNS}, {EVENTS}, {FACTS}, {BASE},
full_ AS (SELECT t.*, t.prompt_tokens + coalesce(t.completion_tokens, 0) AS tokens, CASE WHEN t.context_peak IS NOT NULL THEN least(1.0, t.context_peak / t.context_window) END AS occ, coalesce(calls, 0) AS calls, coalesce(failed, 0) AS failed, coalesce(edits, 0) AS edits,
    coalesce(repeat_edits, 0) AS repeat_edits, coalesce(reverts, 0) AS reverts, coalesce(compactions, 0) AS compactions, coalesce(interrupts, 0) AS interrupts, coalesce(denials, 0) AS denials, coalesce(todos, 0) AS todos,
    coalesce(opened, 0) AS opened, coalesce(closed, 0) AS closed, coalesce(critic_fails, 0) AS critic_fails, base_tokens, base_wall
    FROM turns t LEFT JOIN facts f USING (turn_id) LEFT JOIN base b ON b.source = t.source AND b.tier IS NOT DISTINCT FROM t.tier),
parts AS (SELECT *, CASE WHEN coalesce(outcome IN ('error', 'cancelled'), false) THEN 0.0::DOUBLE ELSE least(CASE WHEN critic_fails > 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, CASE WHEN todos > 0 AND opened > 0 THEN greatest(0, least(1, closed / opened)) ELSE 1.0::DOUBLE END) END AS completion,
    CASE WHEN calls = 0 THEN 1.0::DOUBLE ELSE 1 - failed / calls END AS tool_reliability, CASE WHEN base_tokens IS NULL OR tokens = 0 THEN 1.0::DOUBLE ELSE greatest(0, least(1, base_tokens / tokens)) END AS efficiency,
    greatest(0, least(1, 1 - (repeat_edits + 2 * reverts) / greatest(1, edits))) AS focus, greatest(0, least(1, 1 - coalesce(occ, 0) - 0.2::DOUBLE * compactions)) AS context_health,
    1 - least(1, (interrupts + denials) / 3) AS autonomy FROM full_),
totals AS (SELECT *, 0.2::DOUBLE * completion + 0.2::DOUBLE * tool_reliability + 0.15::DOUBLE * efficiency + 0.15::DOUBLE * focus + 0.15::DOUBLE * context_health + 0.15::DOUBLE * autonomy AS kpi_score FROM parts),
scored AS (SELECT *, list_filter([CASE WHEN outcome <> 'ok' THEN 'outcome_not_ok' END, CASE WHEN critic_fails > 0 THEN 'critic_fail' END, CASE WHEN calls > 0 AND failed > 0.25 * calls THEN 'tool_error_rate' END, CASE WHEN wall_ms > base_wall THEN 'slow' END,
    CASE WHEN compactions > 0 THEN 'midturn_compaction' END, CASE WHEN reverts > 0 THEN 'edit_revert' END, CASE WHEN interrupts > 0 THEN 'user_interrupt' END, CASE WHEN kpi_score < 0.5 THEN 'low_kpi' END], lambda x: x IS NOT NULL) AS reasons FROM totals),
flags AS (SELECT *, CAST(len(reasons) > 0 AS INTEGER) AS flagged FROM scored)"""


@query("k10_score_turns", f"WITH {SCORED} SELECT turn_id, round(completion, 6) AS completion, round(tool_reliability, 6) AS tool_reliability, round(efficiency, 6) AS efficiency, round(focus, 6) AS focus, round(context_health, 6) AS context_health, round(autonomy, 6) AS autonomy, round(kpi_score, 6) AS kpi_score, array_to_string(reasons, ',') AS reasons, flagged FROM flags")
def k10(spark, d):
    out = scored(spark, d).select("turn_id", *kpi.COMPONENTS, "kpi_score", F.array_join("reasons", ",").alias("reasons"), "flagged")
    return rounded(out, *kpi.COMPONENTS, "kpi_score")


@query("a2_trailing_baseline", f"WITH {TURNS}, {BASE} SELECT * FROM base")
def a2(spark, d):
    return kpi.trailing_baseline(turns(spark, d), WINDOW)


@query("w1_trailing_percentiles", f"""WITH {TURNS}, w AS (SELECT turn_id, list_sort(list(CASE WHEN prompt_tokens + coalesce(completion_tokens, 0) > 0 THEN prompt_tokens + coalesce(completion_tokens, 0) END) OVER f) AS t, list_sort(list(wall_ms) OVER f) AS v FROM turns
    WINDOW f AS (PARTITION BY source, tier ORDER BY started_at RANGE BETWEEN CAST({WINDOW} AS BIGINT) PRECEDING AND 1 PRECEDING))
    SELECT turn_id, t[CAST(round_even(0.5 * (len(t) - 1), 0) AS INTEGER) + 1] AS base_tokens, v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER) + 1] AS base_wall FROM w""")
def w1(spark, d):
    return kpi.trailing_percentiles(turns(spark, d), WINDOW)


@query("a4_kpi_by_dims", f"""WITH {SCORED} SELECT 'tier' AS dim, coalesce(tier, 'unknown') AS value, round(avg(kpi_score), 6) AS mean_kpi, count(*) AS n FROM flags GROUP BY 2
    UNION ALL SELECT 'source', source, round(avg(kpi_score), 6), count(*) FROM flags GROUP BY 2 UNION ALL SELECT 'host', host, round(avg(kpi_score), 6), count(*) FROM flags GROUP BY 2""")
def a4(spark, d):
    return rounded(review.kpi_by_dims(scored(spark, d)), "mean_kpi")


@query("a3_rollup", f"WITH {SCORED} SELECT count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (flagged = 1) AS flagged, count(*) FILTER (judged = 1) AS judged, count(*) FILTER (flagged = 1 AND judged = 0) AS unjudged, count(*) = 0 AS empty_window, CAST((SELECT count(*) FROM timeline WHERE kind = 'compaction' AND turn_id IN (SELECT turn_id FROM turns)) AS BIGINT) AS compactions FROM flags")
def a3(spark, d):
    return review.rollup(scored(spark, d), timeline(spark, d))


@query("a5_tool_failures", f"WITH {EVENTS} SELECT name, count(*) FILTER (ok = 0) AS failures, count(*) AS calls FROM timeline WHERE kind = 'tool_call' GROUP BY name HAVING count(*) FILTER (ok = 0) > 0 ORDER BY failures DESC, name LIMIT 10")
def a5(spark, d):
    return review.tool_failures(timeline(spark, d))


@query("a6_session_signals", f"""WITH {TURNS}, {EVENTS}, e AS (SELECT e.*, session_id FROM timeline e JOIN turns USING (turn_id))
    SELECT 'repeated_tool_failure' AS signal, session_id, name AS subject, count(*) AS n FROM e WHERE kind = 'tool_call' AND ok = 0 GROUP BY 2, 3 HAVING count(*) >= 3
    UNION ALL SELECT 'permission_denials', session_id, '', count(*) FROM e WHERE kind = 'permission' AND decision = 'deny' GROUP BY 2 HAVING count(*) >= 2
    UNION ALL SELECT 'edit_revert_loop', session_id, coalesce(path, ''), count(*) FROM e WHERE kind = 'revert' GROUP BY 2, 3 HAVING count(*) >= 2
    UNION ALL SELECT 'repeated_interrupts', session_id, '', count(*) FROM e WHERE kind = 'interrupt' GROUP BY 2 HAVING count(*) >= 2""")
def a6(spark, d):
    return review.session_signals(turns(spark, d), timeline(spark, d))


CHANGES = "changes AS (SELECT turn_id AS change_id, started_at AS applied_at FROM turns)"


@query("a7_regression_check", f"""WITH {SCORED}, {CHANGES}, c AS (SELECT * FROM changes WHERE applied_at BETWEEN 852076800000 - CAST(14 AS BIGINT) * 86400000 AND 852076800000 - CAST(2 AS BIGINT) * 86400000),
    j AS (SELECT c.change_id, avg(kpi_score) FILTER (started_at < applied_at) AS mean_before, avg(kpi_score) FILTER (started_at >= applied_at) AS mean_after, count(*) FILTER (started_at < applied_at) AS n_before, count(*) FILTER (started_at >= applied_at) AS n_after
    FROM c JOIN flags t ON t.started_at >= applied_at - CAST(7 AS BIGINT) * 86400000 AND t.started_at < least(852076800000, applied_at + CAST(7 AS BIGINT) * 86400000) GROUP BY 1),
    k AS (SELECT c.change_id, mean_before, mean_after, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after, CASE WHEN mean_before = 0 THEN 0 ELSE (mean_after - mean_before) / mean_before END AS delta FROM c LEFT JOIN j USING (change_id))
    SELECT change_id, round(mean_before, 6) AS mean_before, round(mean_after, 6) AS mean_after, n_before, n_after, round(delta, 6) AS delta, CASE WHEN n_before < 3 OR n_after < 3 THEN 'insufficient_samples' WHEN delta < -0.05 THEN 'revert' ELSE 'keep' END AS verdict FROM k""")
def a7(spark, d):
    t = turns(spark, d)
    changes = t.select(F.col("turn_id").alias("change_id"), F.col("started_at").alias("applied_at"), F.lit(None).cast("long").alias("reverted_at"))
    return rounded(review.regression_check(changes, scored(spark, d), 852076800000, least=3), "mean_before", "mean_after", "delta")


@query("t1_complex_turns", f"""WITH {TURNS}, {EVENTS}, f AS (SELECT turn_id, count(DISTINCT name) FILTER (kind = 'tool_call') AS tools, count(DISTINCT path) FILTER (kind IN ('edit', 'revert')) AS paths FROM timeline GROUP BY 1)
    SELECT turn_id, (1 + coalesce(tools, 0)) * (1 + coalesce(paths, 0)) * greatest(1, prompt_tokens + coalesce(completion_tokens, 0)) / 1000 AS complexity, CAST(greatest(0, (SELECT count(*) FROM turns) - 10) AS BIGINT) AS dropped FROM turns LEFT JOIN f USING (turn_id) ORDER BY complexity DESC, started_at, turn_id LIMIT 10""")
def t1(spark, d):
    return review.complex_turns(turns(spark, d), timeline(spark, d))


@query("t2_low_kpi_turns", f"WITH {SCORED} SELECT turn_id, round(kpi_score, 6) AS kpi_score, CAST(greatest(0, (SELECT count(*) FROM flags WHERE judged = 0) - 15) AS BIGINT) AS dropped FROM flags WHERE judged = 0 ORDER BY flags.kpi_score, started_at, turn_id LIMIT 15")
def t2(spark, d):
    s = scored(spark, d)
    return rounded(review.low_kpi_turns(s, s.filter("judged = 1")), "kpi_score")


@query("t3_pending_judgments", f"WITH {SCORED} SELECT turn_id, started_at FROM flags WHERE flagged = 1 AND judged = 0 ORDER BY started_at DESC, turn_id DESC LIMIT 20")
def t3(spark, d):
    return review.pending_judgments(scored(spark, d))


@query("t4_judge_overflow", f"WITH {SCORED} SELECT turn_id, 'queue' AS kind, 0 AS ok FROM flags WHERE flagged = 1 AND judged = 0 ORDER BY started_at DESC, turn_id DESC OFFSET 20")
def t4(spark, d):
    return review.judge_overflow(scored(spark, d))


@query("w15_close_orphans", f"""WITH {TURNS}, {EVENTS}, l AS (SELECT turn_id, max(ts) AS last FROM timeline GROUP BY 1), o AS (SELECT *, lead(started_at) OVER (PARTITION BY session_id ORDER BY started_at, turn_id) IS NOT NULL AS follows FROM turns)
    SELECT turn_id, coalesce(last, started_at) AS ended_at, greatest(0, coalesce(last, started_at) - started_at) AS wall_ms FROM o LEFT JOIN l USING (turn_id) WHERE ended_at IS NULL AND follows""")
def w15(spark, d):
    return review.close_orphans(turns(spark, d), timeline(spark, d))


@query("f1_turns_in", f"WITH {TURNS} SELECT turn_id, started_at FROM turns WHERE started_at >= 820454400000 AND started_at < 852076800000 AND source = 'MACHINERY'")
def f1(spark, d):
    return review.turns_in(turns(spark, d), 820454400000, 852076800000, source="MACHINERY").select("turn_id", "started_at")


@query("f4_tokens_occupancy", f"WITH {TURNS} SELECT turn_id, prompt_tokens + coalesce(completion_tokens, 0) AS tokens, CASE WHEN context_peak IS NOT NULL THEN round(least(1.0, context_peak / context_window), 6) END AS occupancy FROM turns")
def f4(spark, d):
    return turns(spark, d).select("turn_id", kpi.total_tokens().alias("tokens"), F.round(kpi.occupancy(), 6).alias("occupancy"))
