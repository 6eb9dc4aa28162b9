"""Sessions, plans, todos, queues and jobs: lookups and summaries (F, J, A, U-9, U-13, U-22, W-11, W-16, N-4, E-8, L-7, K-11)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import kept
from . import evaluate, health, keyed, kpi, policy, review, scope, trace


def events_of(events: DataFrame, turn_ids: DataFrame, kind: str | None = None) -> DataFrame:
    """F-2: the events of some turns, by (ts, event_id)."""
    rows = events if kind is None else events.filter(F.col("kind") == kind)
    return rows.join(turn_ids.select("turn_id").distinct(), "turn_id", "left_semi").orderBy("turn_id", "ts", "event_id")


def texts_of(texts: DataFrame, turn_ids: DataFrame, kind: str | None = None) -> DataFrame:
    """F-2: the texts of some turns, by (kind, seq)."""
    rows = texts if kind is None else texts.filter(F.col("kind") == kind)
    return rows.join(turn_ids.select("turn_id").distinct(), "turn_id", "left_semi").orderBy("turn_id", "kind", "seq")


def turn_dossier(turns: DataFrame, events: DataFrame, texts: DataFrame, judgments: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """F-3: each turn with its events by (ts, event_id), texts by (kind, seq), judgment, and decisions by domain. A turn that isn't there has no row."""
    order = [c for c in ("ts", "event_id", "kind", "name", "ok") if c in events.columns]
    e = events.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("events"))
    t = texts.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("kind", "seq", "body"))).alias("texts"))
    out = turns.join(e, "turn_id", "left").join(t, "turn_id", "left").join(judgments.select("turn_id", "verdict"), "turn_id", "left")
    if decisions is None:
        return out
    d = decisions.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("domain", "chosen"))).alias("decisions"))
    return out.join(d, "turn_id", "left")


FILLED = ["prompt_tokens", "model", "model_ms", "outcome"]


def needs_backfill(turns: DataFrame, since: int | None = None, source: str = "claude-code") -> DataFrame:
    """F-5: sessions of a source with a turn that lacks something which a transcript may tell (FILLED; a column that the table lacks counts as lacking)."""
    lacks = F.lit(False)
    for c in FILLED:
        lacks = lacks | (F.col(c).isNull() if c in turns.columns else F.lit(True))
    rows = turns if since is None else turns.filter(F.col("started_at") >= since)
    return rows.filter((F.col("source") == source) & lacks).select("session_id").distinct()


def list_todos(todos: DataFrame, scope: str | None = None, repo: str | None = None, status: str | None = "open") -> DataFrame:
    """F-7: newest first."""
    for name, value in (("scope", scope), ("repo", repo), ("status", status)):
        todos = todos if value is None else todos.filter(F.col(name) == value)
    return todos.orderBy(F.desc("created_at"), F.desc("todo_id"))


def not_synthetic(rows: DataFrame, provenance: str = "provenance") -> DataFrame:
    """F-11: what can't be read as JSON isn't synthetic."""
    mark = F.when(F.try_parse_json(provenance).isNotNull(), F.get_json_object(provenance, "$.synthetic"))
    return rows.filter(F.coalesce(mark, F.lit("false")) != "true")


def scope_records_since(records: DataFrame, since_s: int) -> DataFrame:
    """F-12: created_at is in seconds."""
    return records.filter(F.col("created_at") >= since_s).orderBy("created_at", "record_id")


def log_window(log: DataFrame, since_ms: int) -> DataFrame:
    """F-15: rows whose time can be read and isn't before since."""
    return log.filter(F.unix_millis(F.try_to_timestamp("ts")) >= since_ms)


def log_verdict(window: DataFrame) -> DataFrame:
    """F-15: how many rows a window has; silent if none, which is a finding: the hook may not be wired."""
    return window.agg(F.count("*").alias("rows")).withColumn("verdict", F.when(F.col("rows") == 0, "silent").otherwise("pass"))


def blocking_jobs(jobs: DataFrame, now: int, least_s: int = 1800) -> DataFrame:
    """F-17: blocked for half an hour or an unknown time; the key changes with what is needed, so that a job blocked for another reason shows again."""
    old = F.coalesce((F.lit(now) - F.col("since")) / 1000 >= least_s, F.lit(True))
    needs = F.coalesce(F.nullif("needs", F.lit("")), F.lit("waiting on a decision"))
    return jobs.filter((F.col("state") == "blocked") & old).withColumn("key", F.concat("job_id", F.lit(":"), F.substring(F.sha1(needs), 1, 8)))


def failed_job_key(findings: DataFrame) -> DataFrame:
    """F-17: the key of a failing job: its id, or source, host and name, with a digest of its reasons."""
    who = F.coalesce("job_id", F.concat_ws("|", F.coalesce("source", F.lit("None")), F.coalesce("host", F.lit("None")), F.coalesce("name", F.lit("None"))))
    return findings.withColumn("key", F.concat(who, F.lit(":"), F.substring(F.sha1(F.array_join("reasons", "|")), 1, 8)))


def scored_decisions(decisions: DataFrame, scored: DataFrame, domain: str, since: int) -> DataFrame:
    """J-1."""
    return decisions.filter(F.col("domain") == domain).join(scored.filter((F.col("started_at") >= since) & F.col("kpi_score").isNotNull()).select("turn_id", "started_at", "kpi_score", "tier"), "turn_id")


def plans_with_todos(plans: DataFrame, todos: DataFrame, status: str | None = None, scope: str | None = None, repo: str | None = None, limit: int | None = 50) -> DataFrame:
    """J-8: each plan with its todo's scope, repo, status, source and key, the last updated first; limit None gives all."""
    own = todos.select("todo_id", "scope", "repo", F.col("status").alias("todo_status"), "source", "key", F.col("created_at").alias("todo_created_at"), F.col("updated_at").alias("todo_updated_at"), "done_at")
    rows = plans.join(own, "todo_id")
    for name, value in (("status", status), ("scope", scope), ("repo", repo)):
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows if limit is None else rows.orderBy(F.desc("updated_at"), "todo_id").limit(limit)


def active_plan(plans: DataFrame, sessions: DataFrame) -> DataFrame:
    """J-15: for each session its own active plan, else its repository's newest, else the newest of all. plans carry the repo of their todo."""
    live = plans.filter("status = 'active'").select("todo_id", F.col("session_id").alias("own"), F.col("repo").alias("home"), "updated_at")
    newest = live.agg(F.max_by("todo_id", F.struct("updated_at", "todo_id")).alias("any"))
    own = live.groupBy("own").agg(F.max_by("todo_id", F.struct("updated_at", "todo_id")).alias("p1"))
    home = live.groupBy("home").agg(F.max_by("todo_id", F.struct("updated_at", "todo_id")).alias("p2"))
    out = sessions.join(own, F.col("session_id") == F.col("own"), "left").join(home, F.col("repo") == F.col("home"), "left").crossJoin(newest)  # one row
    return out.select("session_id", F.coalesce("p1", "p2", "any").alias("todo_id"))


def subagent_paths(edits: DataFrame) -> DataFrame:
    """J-10: edits of a nested file belong to the parent session in its path."""
    parent = F.regexp_extract("file", r"([^/]+)/subagents/[^/]+$", 1)
    return edits.withColumn("session_id", F.when(parent != "", parent).otherwise(F.col("session_id")))


def fold_step_usage(events: DataFrame) -> DataFrame:
    """A-19: a turn's totals from its steps; what was never observed stays null. kinds: model_req (latency_ms, retries, prompt_tokens, completion_tokens, cached_tokens, estimated, ttft_ms, tools_hash), context_snapshot (used, window), mode_change (mode)."""
    step = F.col("kind") == "model_req"
    of = lambda c: F.when(step, F.col(c))
    any_ = F.count_if(step) > 0
    total = lambda c: F.when(any_, F.coalesce(F.sum(of(c)), F.lit(0))).alias(c)
    last = lambda c, keep: F.max_by(F.when(keep, F.col(c)), F.when(keep, F.col("ts")))
    sums = events.groupBy("turn_id").agg(
        F.when(any_, F.coalesce(F.sum(of("latency_ms")), F.lit(0))).alias("model_ms"), F.nullif(F.count_if(step), F.lit(0)).alias("requests"), *map(total, ("retries", "prompt_tokens", "completion_tokens", "cached_tokens")),
        F.coalesce(F.bool_or(of("estimated")), F.lit(False)).cast("int").alias("estimated"), F.min(F.when(step & (F.col("ttft_ms") >= 0), F.col("ttft_ms"))).alias("ttft_ms"),
        F.max(F.when((F.col("kind") == "context_snapshot") & (F.col("used") > 0), F.col("used"))).alias("context_peak"), last("window", (F.col("kind") == "context_snapshot") & (F.col("window") > 0)).alias("context_window"),
        last("mode", (F.col("kind") == "mode_change") & (F.col("mode") != "")).alias("mode"),
    )
    changes = trace.hash_changes(events.filter(step), "turn_id", "tools_hash", ["ts"]).withColumnRenamed("changes", "tools_hash_changes")
    return sums.join(changes, "turn_id", "left")  # no row where no hash was seen


def scope_liveness(gate_log: DataFrame, turns: DataFrame, records: DataFrame, since_ms: int) -> DataFrame:
    """A-21, in a window: whether the gate's log goes on (else: fail where turns show that the machine was in use, inconclusive where none do), and whether records follow it (not_applicable where it doesn't go on). ok: checks that don't fail. gate_log: ts ISO; turns: started_at ms; records: created_at seconds."""
    g = gate_log.agg(F.coalesce(F.max(F.unix_millis(F.try_to_timestamp("ts"))) >= since_ms // 1000 * 1000, F.lit(False)).alias("g"))
    t = turns.agg(F.count_if(F.col("started_at") >= since_ms).alias("t"))
    r = records.agg(F.count_if(F.col("created_at") >= since_ms // 1000).alias("records_in_window"))
    one = g.crossJoin(t).crossJoin(r)  # three single rows
    gate = F.when(F.col("g"), "ok").when(F.col("t") > 0, "fail").otherwise("inconclusive")
    kept = F.when(~F.col("g"), "not_applicable").when(F.col("records_in_window") > 0, "ok").otherwise("fail")
    return one.select(gate.alias("gate_log"), kept.alias("ingestion"), "records_in_window", ((gate != "fail").cast("int") + (kept != "fail").cast("int")).alias("ok"), F.lit(2).alias("total"))


def recent_events(events: DataFrame, now: int, k: int = 25, within_s: int = 3600) -> DataFrame:
    """T-6: the newest events of the last hour."""
    rows = events.filter(F.col("ts") >= now - within_s * 1000)
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(k).select("event_id", "turn_id", "ts", "kind", "name", "ok")


def ledger_view(sessions: DataFrame, todos: DataFrame, events: DataFrame, now: int, within_s: int = 180, shown: int = 50) -> DataFrame:
    """A-24 and R-4, as rows (part, key, at): active sessions, repositories in play (each once, by name and remote), the newest events of the last hour, the newest open todos by scope, and how many sessions there ever were, which tells silence from emptiness (key true or false: whether there is any)."""
    live = health.active_sessions(sessions, within_s, now)
    part = lambda df, name, key, at: df.select(F.lit(name).alias("part"), key.cast("string").alias("key"), at.cast("long").alias("at"))
    null = F.lit(None)
    repos = live.filter("repo is not null or github_remote is not null").select("repo", "github_remote").distinct()
    out = part(live, "session", F.col("session_id"), F.col("heartbeat_at")).unionByName(part(repos, "repo", F.concat_ws(" ", "repo", "github_remote"), null))
    out = out.unionByName(part(recent_events(events, now), "event", F.col("event_id"), F.col("ts")))
    for scope_ in ("local", "global"):
        out = out.unionByName(part(list_todos(todos, scope_).limit(shown), f"todo_{scope_}", F.col("todo_id"), F.col("created_at")))
    ever = sessions.agg(F.count("*").alias("n"))
    return out.unionByName(part(ever, "sessions_ever", F.col("n") > 0, F.col("n")))


def index_summary(repos: DataFrame) -> DataFrame:
    """A-25: repositories by state."""
    return repos.agg(F.count("*").alias("repos"), F.count_if(F.col("dirty") == 1).alias("dirty"), F.count_if(F.col("ahead") > 0).alias("ahead"), F.count_if(F.col("behind") > 0).alias("behind"), F.count_if(F.col("github_remote").isNull()).alias("no_remote"))


def schedule_summary(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """A-25: jobs by source; null, not 0, where no host of the source could be reached."""
    n = jobs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))
    s = sources.groupBy("source").agg(F.count_if("reachable").alias("reachable"), F.count_if(~F.col("reachable")).alias("unreachable"))
    out = s.join(n, "source", "left")
    return out.select("source", "reachable", "unreachable", F.when(F.col("reachable") > 0, F.coalesce("n", F.lit(0))).alias("jobs"), F.when(F.col("reachable") > 0, F.coalesce("failed", F.lit(0))).alias("failed"))


def registry_summary(entries: DataFrame) -> DataFrame:
    """A-25: learned phrases by status; silent without any."""
    n = entries.agg(F.count("*").alias("entries"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "retired").alias("retired"))
    return n.withColumn("verdict", F.when(F.col("entries") == 0, "silent").otherwise("pass"))


def judge_rate(verdicts: DataFrame) -> DataFrame:
    """A-26: the rate is over answers, abstention over all."""
    yes, no, none = (F.count_if(F.col("verdict") == v) for v in ("correction", "new", "silent"))
    return verdicts.agg(yes.alias("corrections"), no.alias("new"), none.alias("silent"), F.try_divide(yes, yes + no).alias("rate"), F.try_divide(none, F.count("*")).alias("abstention"))


DISPOSITIONS = ["committed", "non_goal", "assumption"]
HOUR = 3_600_000


def scope_pass_counts(items: DataFrame) -> DataFrame:
    """A-28: a pass's items by disposition; an item is late iff it came once the work had begun (began_at; null: it hasn't)."""
    return items.groupBy("pass_id").agg(*_pass_counts(items, F.lit(True)))


def _pass_counts(items: DataFrame, which: Column) -> list[Column]:
    of = lambda name, c: F.count_if(which & c).alias(name)
    is_ = lambda name, d: of(name, F.col("disposition") == d)
    source = [of("divergence_kept", F.col("source") == "divergence")] if "source" in items.columns else []
    return [F.count_if(which).alias("found_total"), is_("committed", "committed"), is_("non_goals", "non_goal"), is_("assumptions", "assumption"), of("late_discovered", F.col("ts") >= F.col("began_at")), *source]


def scope_pass_problems(passes: DataFrame, items: DataFrame) -> DataFrame:
    """A-28: pass_id, problems (how many of each kind, in order, as kind:n), verdict: pass iff there are none. passes: pass_id, goal; items: pass_id, disposition, detail."""
    bare = lambda d: F.count_if((F.col("disposition") == d) & (F.coalesce(F.trim("detail"), F.lit("")) == ""))
    n = items.groupBy("pass_id").agg(F.count("*").alias("n"), *(bare(d).alias(d) for d in DISPOSITIONS), F.count_if(F.col("disposition") == "committed").alias("kept"))
    rows = passes.join(n, "pass_id", "left").fillna(0, ["n", *DISPOSITIONS, "kept"])
    why = lambda name, c: F.when(c > 0, F.concat(F.lit(f"{name}:"), c))
    one = lambda c: c.cast("int")
    found = [why("empty_goal", one(F.coalesce(F.trim("goal"), F.lit("")) == "")), why("no_items", one(F.col("n") == 0)), why("committed_without_criterion", F.col("committed")), why("non_goal_without_reason", F.col("non_goal")), why("assumption_without_default", F.col("assumption")), why("nothing_committed", one(F.col("kept") == 0))]
    return rows.select("pass_id", F.array_compact(F.array(*found)).alias("problems")).withColumn("verdict", F.when(F.size("problems") == 0, "pass").otherwise("fail"))


def scope_freshness(passes: DataFrame, now: int, cwd: Column) -> DataFrame:
    """A-29: why a pass must not be used again, null if it may."""
    why = F.when(now - F.col("created_at") > 12 * HOUR, "older than 12 h").when(F.col("cwd") != cwd, "another folder")
    return passes.withColumn("stale_because", why)


def fold_scope_passes(events: DataFrame, known: DataFrame) -> DataFrame:
    """U-22: one scope record for each pass that a stop closes, verdict silent, if its id isn't known. events: pass_id, ts (ms), op (open, item, question, begin, stop) and, by op, session_id, cwd, tier, goal, gate_ts, prompt_sha1, divergence_flagged (open), disposition, source (item), changed (question), cwd (stop).

    A pass opens only for a tier other than none. Whether an item is late follows from the times, never from who adds it; an unknown disposition is refused. A stop in another folder, or more than 12 h after the opening, leaves the pass open. The id is the one that the gate's log gives the same decision (U-9), so that the two writers find each other; without it, one of the pass's own."""
    is_ = lambda op: F.col("op") == op
    given = F.struct("session_id", "cwd", "tier", "gate_ts", "prompt_sha1", "divergence_flagged")
    opened = events.filter(is_("open")).groupBy("pass_id").agg(F.min_by(given, "ts").alias("__given"), F.min("ts").alias("created_at")).select("pass_id", "__given.*", "created_at").filter(F.col("created_at").isNotNull() & (F.col("tier") != "none"))
    marks = events.filter(is_("begin") | is_("stop")).select("pass_id", "op", "ts", F.col("cwd").alias("__d")).join(opened.select("pass_id", "cwd", "created_at"), "pass_id")
    closes = is_("stop") & (F.col("__d") == F.col("cwd")) & (F.col("ts") - F.col("created_at") <= 12 * HOUR)
    closed = marks.groupBy("pass_id").agg(F.min(F.when(closes, F.col("ts"))).alias("closed_at"), F.min(F.when(is_("begin"), F.col("ts"))).alias("began_at")).filter("closed_at is not null")
    live = opened.join(closed, "pass_id")
    item = is_("item") & F.col("disposition").isin(DISPOSITIONS)
    rows = events.filter(item | is_("question")).join(closed, "pass_id").filter(F.col("ts") <= F.col("closed_at"))  # each event once
    counts = rows.groupBy("pass_id").agg(*_pass_counts(rows, item), F.count_if(is_("question")).alias("questions_asked"), F.count_if(is_("question") & F.col("changed")).alias("questions_valuable"))
    out = live.join(counts, "pass_id", "left").fillna(0, ["found_total", "committed", "non_goals", "assumptions", "late_discovered", "divergence_kept", "questions_asked", "questions_valuable", "divergence_flagged"])
    digest = lambda *c: F.substring(F.sha1(F.concat_ws("|", *c)), 1, 16)
    own = F.concat(F.lit("stop-"), digest(F.lit("stop"), "session_id", F.floor(F.col("created_at") / 1000)))
    rid = F.when(F.coalesce("gate_ts", F.lit("")) != "", F.concat(F.lit("gate-"), digest("session_id", "gate_ts", "prompt_sha1"))).otherwise(own)
    out = out.withColumn("record_id", rid).withColumn("verdict", F.lit("silent")).withColumn("ceremony_ms", F.col("began_at") - F.col("created_at")).withColumn("created_at", F.floor(F.col("created_at") / 1000))
    return out.join(known.select("record_id").distinct(), "record_id", "left_anti").drop("gate_ts", "prompt_sha1", "began_at", "closed_at")  # distinct: of a fold whose ids are known, no counts are made


def append_scope_records(log: DataFrame, known: DataFrame) -> DataFrame:
    """U-9 and X-2: each gate decision's outcome (suppressed, malformed, already_present, written) and its record id; a decision that the log holds twice is written once."""
    rid = F.concat(F.lit("gate-"), F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(c, F.lit("None")) for c in ("session_id", "ts", "prompt_sha1")))), 1, 16))
    rows = log.withColumn("record_id", rid).join(known.select("record_id", F.lit(True).alias("__known")).distinct(), "record_id", "left")
    bad = F.col("session_id").isNull() | F.col("ts").isNull()
    quiet = F.col("tier").isNull() | (F.coalesce("suppressed", F.lit(False)) if "suppressed" in log.columns else F.lit(False))
    outcome = F.when(quiet, "suppressed").when(bad, "malformed").when(F.col("__known"), "already_present").otherwise("written")
    again = F.row_number().over(Window.partitionBy("record_id", "outcome").orderBy("tier")) > 1
    return rows.withColumn("outcome", outcome).withColumn("outcome", F.when((F.col("outcome") == "written") & again, "already_present").otherwise(F.col("outcome"))).drop("__known")


def thin_records(appended: DataFrame, host: str, provenance: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """U-9: the rows to store of what append_scope_records wrote: silent, without counts, marked thin; and how many rows were refused since their provenance says that they are synthetic."""
    thin = F.coalesce(provenance, F.to_json(F.struct(F.lit("gate-log").alias("source"), F.lit(True).alias("thin")))) if provenance is not None else F.to_json(F.struct(F.lit("gate-log").alias("source"), F.lit(True).alias("thin")))
    rows = appended.filter("outcome = 'written'").select("record_id", F.coalesce("session_id", F.lit("unknown")).alias("session_id"), F.unix_seconds(F.try_to_timestamp("ts")).alias("created_at"), F.lit(host).alias("host"), "tier", F.lit("silent").alias("verdict"), thin.alias("provenance"))
    good = not_synthetic(rows)
    return good, rows.join(good.select("record_id"), "record_id", "left_anti").agg(F.count("*").alias("refused"))


def merge_hosts(local: dict[str, DataFrame], peers: list[dict[str, DataFrame]], keys: dict[str, list[str]], recency: dict[str, str]) -> dict[str, DataFrame]:
    """U-13: every table over all peers at once; a table that a peer lacks is skipped for it."""
    out = {}
    for name, df in local.items():
        others = [p[name] for p in peers if name in p]
        out[name] = keyed.merge_mutable(df, others, keys[name], recency[name]) if name in recency else keyed.merge_append_only(df, others, keys[name])
    return out


def merge_counts(local: dict[str, DataFrame], merged: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """U-13: table and how many of its rows are new or changed."""
    parts = []
    for name, df in merged.items():
        rest = [c for c in df.columns if c not in keys[name]]
        both = df.join(local[name].select(*keys[name], F.struct(*rest).alias("__old")), keys[name], "left")
        n = F.count_if(F.col("__old").isNull() | ~F.col("__old").eqNullSafe(F.struct(*rest)))
        parts.append(both.agg(n.alias("changed")).select(F.lit(name).alias("table"), "changed"))
    return reduce(DataFrame.unionByName, parts)


def health_verdict(summary: DataFrame, history: DataFrame) -> DataFrame:
    """W-11: pass and fail stay; silent becomes fail if the days before were silent too. summary: day, verdict, value; history: day, value."""
    streak = scope.zero_streak(history.unionByName(summary.select("day", "value"))).select(F.col("verdict").alias("s"))
    return summary.crossJoin(streak).select("day", F.when((F.col("verdict") == "silent") & (F.col("s") == "fail"), "fail").otherwise(F.col("verdict")).alias("verdict"))


def text_seq(texts: DataFrame) -> DataFrame:
    """W-16."""
    return texts.withColumn("seq", F.row_number().over(Window.partitionBy("turn_id", "kind").orderBy("at")) - 1)


def plan_header(goal: Column, stages: Column, problems: Column, most: int = 500) -> Column:
    """N-4: goal, which stage is next (or how many are done), how many problems; most bytes at most, without a part of a character."""
    left = F.filter(stages, lambda s: ~s["status"].eqNullSafe("done"))
    done, total, n = F.size(stages) - F.size(left), F.size(stages), F.size(problems)
    stage = F.when(F.size(left) > 0, F.concat(F.lit("stage "), done + 1, F.lit("/"), total, F.lit(' "'), F.try_element_at(left, F.lit(1))["name"], F.lit('"'))).otherwise(F.concat(done, F.lit("/"), total, F.lit(" done")))
    issues = F.when(n > 0, F.concat(F.lit(" · "), n, F.when(n == 1, " issue").otherwise(" issues"))).otherwise("")
    line = F.concat(F.lit("[plan] "), goal, F.lit(" · "), stage, issues)
    return F.when(F.octet_length(line) <= most, line).otherwise(T.utf8_prefix(line, most))


SPOKEN = ["prompt", "response", "summary"]


def judge_context(turns: DataFrame, events: DataFrame, texts: DataFrame, reasons: Column, most: int = 12_000) -> DataFrame:
    """C-13: a header (the turn, without its score; its flags; its failed tools), always whole, then the conversation, of which the beginning goes if both together are longer than most letters. turns: turn_id, source, outcome, tier, wall_ms and what reasons needs; events: turn_id, ts, kind, name, ok, error."""
    bad = events.filter((F.col("kind") == "tool_call") & (F.col("ok") == 0)).groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("ts", "name", F.rtrim(F.concat(F.lit("- "), F.coalesce("name", F.lit("tool")), F.lit(": "), F.coalesce("error", F.lit("")))).alias("line")))).alias("__bad"))
    rank = F.array_position(F.array(*map(F.lit, SPOKEN)), F.col("kind"))
    said = texts.filter(F.col("kind").isin(SPOKEN)).groupBy("turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "seq", "kind", "body"))), lambda x: F.concat(F.lit("["), x["kind"], F.lit("#"), x["seq"], F.lit("] "), x["body"])), "\n\n").alias("__said"))
    rows = turns.join(bad, "turn_id", "left").join(said, "turn_id", "left")
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    who = F.concat_ws(" ", *(F.concat(F.lit(f"{c}="), say(c)) for c in ("turn_id", "source", "outcome", "tier", "wall_ms")))
    flags = F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise("none")
    tools = F.when(F.col("__bad").isNull(), "TOOL_FAILURES: none").otherwise(F.concat(F.lit("TOOL_FAILURES:\n"), F.array_join(F.transform("__bad", lambda x: x["line"]), "\n")))
    rows = rows.withColumn("__head", F.concat(F.lit("TURN: "), who, F.lit("\nFLAG_REASONS: "), flags, F.lit("\n"), tools))
    between, cut = "\n\nCONVERSATION (tail):\n", "...[truncated]...\n"
    room = F.lit(most - len(between)) - F.length("__head")
    tail = F.when(F.length("__said") <= room, F.col("__said")).when(room > len(cut), F.concat(F.lit(cut), F.right("__said", room - len(cut)))).otherwise(F.right(F.lit(cut), room))
    return rows.select("turn_id", F.when(F.col("__said").isNull() | (room <= 0), F.col("__head")).otherwise(F.concat("__head", F.lit(between), tail)).alias("context"))


def redact_payload(payloads: DataFrame, column: str, depth: int = 12) -> DataFrame:
    """C-3: strings at any depth of a JSON payload; deeper than depth, or no JSON, gives null, and the caller drops it.

    The strings of a batch's payloads are told apart by their place, redacted by the same expressions as any text, and put back; only the walk over nested JSON, which has no bound in built-in functions, is Python."""
    import json

    def walk(x, at: int, found: list):
        if at > depth:
            raise ValueError
        if isinstance(x, str):
            found.append(x)
            return len(found) - 1, None
        if isinstance(x, dict):
            return "{", [(k, walk(v, at + 1, found)) for k, v in x.items()]
        return ("[", [walk(v, at + 1, found) for v in x]) if isinstance(x, list) else ("=", x)

    def built(shape, texts: list):
        mark, inner = shape
        if isinstance(mark, int):
            return texts[mark]
        if mark == "{":
            return {k: built(v, texts) for k, v in inner}
        return [built(v, texts) for v in inner] if mark == "[" else inner

    def strings(said: str | None) -> list | None:
        found: list = []
        try:
            walk(json.loads(said), 0, found)
        except (TypeError, ValueError, RecursionError):
            return None
        return found

    def taken(parts):
        for part in parts:
            yield part.assign(__t=[strings(x) for x in part[column]])

    def rebuilt(parts):
        for part in parts:
            whole = [None if t is None else json.dumps(built(walk(json.loads(x), 0, []), list(t))) for x, t in zip(part[column], part["__t"])]
            yield part.drop(columns="__t").assign(**{column: whole})

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in payloads.schema)
    return payloads.mapInPandas(taken, f"{shape}, __t array<string>").withColumn("__t", F.transform("__t", lambda t: T.redact(t))).mapInPandas(rebuilt, shape)


def evaluate_classifier(gold: DataFrame, predict: Column, population: dict[int, int], split: str = "held_out") -> DataFrame:
    """E-8, Z-1, over gold's own column split, else E-2's: one prediction for each row of a split, from which every figure is derived: counts, scores by weight, rates. Silent with fewer than 20 rows in all or in a class that a ratio divides by; these are named."""
    rows = gold if "split" in gold.columns else evaluate.assign_splits(gold)
    rows = evaluate.stratum_weights(rows, population).filter(F.col("split") == split).withColumn("prediction", predict)
    c = evaluate.confusion(rows)
    arms = {"predicted_positive": ("tp", "fp"), "actual_positive": ("tp", "fn"), "predicted_negative": ("tn", "fn"), "actual_negative": ("tn", "fp")}
    short = F.array_compact(F.array(*(F.when(F.col(a) + F.col(b) < evaluate.LEAST, F.lit(k)) for k, (a, b) in arms.items())))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") + F.col("abstained")
    facts = c.select("tp", "fp", "fn", "tn", "abstained", n.alias("rows"), short.alias("short_arms"))
    out = facts.crossJoin(evaluate.scores(c, "w_").drop("verdict", "n")).crossJoin(evaluate.population_rate(rows).select("estimated", "true_rate"))  # single rows
    return out.withColumn("verdict", F.when((F.col("rows") < evaluate.LEAST) | (F.size("short_arms") > 0), "silent").otherwise("pass"))


def apply_learning(turns: DataFrame, phrases: list[str], most: float = 0.10, registry: str = "vague") -> DataFrame:
    """L-5 over L-6: replay with and without learned phrases; ok if the share let through doesn't grow by more than most."""
    return scope.suppression_check(scope.replayed(turns), scope.replayed(turns, {registry: phrases}), most)


def judged(rows: DataFrame, client: Callable[[str], str], context: str = "context") -> DataFrame:
    """Z-2: a client's answers in batches; a failure is a row that says so, and the rest of that batch is skipped."""
    def run(parts):
        for part in parts:
            down, answers, states = False, [], []
            for c in part[context]:
                try:
                    if down:
                        raise ConnectionError
                    answers.append(client(c))
                    states.append("judged")
                except ConnectionError:
                    answers.append(None)
                    states.append("skipped" if down else "failed")
                    down = True
            yield pd.DataFrame({"turn_id": part.turn_id, "answer": answers, "state": states})

    return rows.select("turn_id", context).mapInPandas(run, f"turn_id {rows.schema['turn_id'].dataType.simpleString()}, answer string, state string")


def rollup_job(tables: dict[str, DataFrame], now: int, since: int, arms: list[tuple[str, float]], weights: dict[str, dict[str, float]], window_ms: int = kpi.WEEK) -> dict[str, DataFrame]:
    """K-11: what a nightly run makes of the tables (turns as records with seq, events, texts, decisions, probes): the turns are folded (U-1) and those not yet scored get their scores (K-10), scored turns without a decision get one by replay (P-1 to P-4), expired texts go (U-14), probes are looked at (W-14). Also a report: part and n of each step.

    The steps are plans over the same tables; the folded turns and their scores, which several of them read, are written once."""
    turns = kept(keyed.fold_turns(tables["turns"]), "turns")
    for c, kind in (("kpi_score", "double"), ("flagged", "int"), ("judged", "int")):
        turns = turns if c in turns.columns else turns.withColumn(c, F.lit(None).cast(kind))
    place = [c for c in ("file", "start", "seq") if c in tables["events"].columns]  # where the log has a row; else what duplicates differ in decides, so that reruns agree
    events = keyed.dedup_events(tables["events"], place or [c for c in tables["events"].columns if c not in ("turn_id", "ts", "kind")])
    scored = kept(kpi.score_unscored(turns, events, since, window_ms), "scored")
    texts = keyed.expire_texts(tables["texts"], now)
    said = tables["texts"].filter("kind = 'prompt'").groupBy("turn_id").agg(F.min_by("body", "seq").alias("text"))
    pending = review.pending_decisions(scored, tables["decisions"], "model_tier", since).select("turn_id", F.lit(True).alias("__p"))
    rows = policy.features(scored, said).withColumn("bucket", policy.bucket()).withColumn("linear", policy.linear([a for a, _ in arms], weights, policy.vector()))
    held = tables["decisions"].filter("domain = 'model_tier'").select("turn_id", F.col("chosen").alias("decided"))
    rows = rows.select("turn_id", "bucket", "started_at", "linear").join(scored.select("turn_id", "kpi_score"), "turn_id").join(held, "turn_id", "left").join(pending, "turn_id", "left").filter("decided is not null or __p")
    decisions = policy.shadow_decisions(rows, arms).withColumn("domain", F.lit("model_tier"))
    probes = review.latest_probe(tables["probes"]).withColumn("healthy", F.expr("total > 0 and ok = total"))
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    due = turns.filter((F.col("started_at") >= since) & F.col("kpi_score").isNull())
    steps = [*(count(f"ingested_{k}", tables[k]) for k in ("turns", "events", "texts")), count("scored", due), count("decisions", decisions), count("expired", tables["texts"].filter(F.col("expires_at") <= now)), count("unhealthy_probes", probes.filter("not healthy"))]
    return {"turns": scored, "events": events, "texts": texts, "decisions": decisions, "probes": probes, "report": reduce(DataFrame.unionByName, steps)}
