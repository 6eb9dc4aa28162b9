"""Checks of what should be there, where no rows are a finding (J-3, J-4, J-7, A-20, A-23, F-6 to F-10, F-13, J-12, J-13, X)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def expected_alive(rows: DataFrame, key: str, expected: list[str], since: int, ts: str) -> DataFrame:
    """J-3 and J-4: each expected name, with its last time since then, silent without one."""
    names = rows.sparkSession.createDataFrame([(e,) for e in expected], f"{key} string")
    seen = rows.filter((F.col(ts) >= since) & F.col(key).isin(expected)).groupBy(key).agg(F.max(ts).alias("last"))
    return names.join(seen, key, "left").withColumn("status", F.when(F.col("last").isNull(), "silent").otherwise("ok"))


def hook_liveness(events: DataFrame, turns: DataFrame, texts: DataFrame, expected: list[str], since: int, source: str = "claude-code") -> DataFrame:
    """J-3: each expected hook with its evidence: an event of that name, else any turn of the source since then that has a tool call since then and a text; without either it is silent."""
    recent = events.filter(F.col("ts") >= since)
    seen = recent.filter("kind = 'hook' and name is not null").select("name").distinct().withColumn("__h", F.lit("hook_event"))
    active = turns.filter((F.col("source") == source) & (F.col("started_at") >= since)).join(recent.filter("kind = 'tool_call'").select("turn_id"), "turn_id", "left_semi").join(texts.select("turn_id"), "turn_id", "left_semi")
    any_ = active.limit(1).agg(F.when(F.count("*") > 0, f"{source}_collector").alias("__any"))
    names = turns.sparkSession.createDataFrame([(e,) for e in expected], "name string")
    out = names.join(seen, "name", "left").crossJoin(any_)  # one row
    return out.select(F.col("name").alias("hook"), F.coalesce("__h", "__any").alias("evidence")).withColumn("status", F.when(F.col("evidence").isNull(), "silent").otherwise("ok"))


def latest_metrics(metrics: DataFrame, host: str = "host", ts: str = "ts") -> DataFrame:
    """J-7."""
    rest = [c for c in metrics.columns if c != host]
    return metrics.groupBy(host).agg(F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("__x")).select(host, "__x.*")


def judge_queue(scored: DataFrame, events: DataFrame, cap: int = 20, since: int = 0) -> DataFrame:
    """A-20, in a window."""
    backlog = scored.agg(F.count_if((F.col("flagged") == 1) & (F.col("judged") == 0) & (F.col("started_at") >= since)).alias("backlog"))
    dropped = events.agg(F.count_if((F.col("kind") == "queue") & (F.col("ok") == 0) & (F.col("ts") >= since)).alias("dropped"))
    return backlog.crossJoin(dropped).withColumn("ok", F.col("backlog") <= cap)


def doctor(rollup: DataFrame, probes: DataFrame, most: int = 20) -> DataFrame:
    """A-23: findings of no turns, a backlog, and unhealthy probes; a check that itself failed has 0 of 0 and is unhealthy."""
    a = rollup.filter("turns = 0").select(F.lit("no_turns").alias("finding"), F.lit("").alias("subject"))
    b = rollup.filter(F.col("unjudged") > most).select(F.lit("backlog"), F.col("unjudged").cast("string"))
    c = probes.filter("not (total > 0 and ok = total)").select(F.lit("unhealthy_probe"), F.concat_ws("/", "host", "kind"))
    return a.union(b).union(c)


def drop_accounting(probes: DataFrame, kind: str = "emitter") -> DataFrame:
    """R-7: by host what its emitter says it wrote, dropped and failed at (detail is JSON), over all its probes; any drop or error is unhealthy, and so is a probe of nothing."""
    at = lambda k: F.coalesce(F.get_json_object("detail", f"$.{k}").cast("long"), F.lit(0))
    sums = probes.filter(F.col("kind") == kind).groupBy("host").agg(F.sum(at("written")).alias("written"), F.sum(at("dropped")).alias("dropped"), F.sum(at("errors")).alias("errors"))
    return sums.withColumn("healthy", (F.col("written") > 0) & (F.col("dropped") == 0) & (F.col("errors") == 0))


def active_sessions(sessions: DataFrame, within_s: int, now: int) -> DataFrame:
    """F-6."""
    return sessions.filter(F.col("heartbeat_at") >= now - within_s * 1000).withColumn("age_s", F.round((F.lit(now) - F.col("heartbeat_at")) / 1000, 1))


def interesting_repos(repos: DataFrame) -> DataFrame:
    """F-8."""
    return repos.filter("dirty = 1 or ahead > 0 or github_remote is null")


def stale_or_failing(jobs: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """F-9: job_id, source, host, name, reasons of jobs with at least one reason, and of sources (reachable, error) that couldn't be reached or whose table describes work that it doesn't run. A job's note holds tokens parted by semicolons."""
    why = lambda c, t: F.when(F.coalesce(c, F.lit(False)), t if isinstance(t, Column) else F.lit(t))
    notes = F.split(F.coalesce("note", F.lit("")), ";")
    tokens = {"installed_not_loaded": "installed on disk but not loaded", "loaded_no_plist_on_disk": "loaded but no plist on disk", "stale": "last run far older than its stated interval"}
    found = [why(F.col("status") == "failed", "status=failed"), why(F.col("last_exit") != 0, F.concat(F.lit("last_exit="), F.col("last_exit"))), *(why(F.array_contains(notes, k), v) for k, v in tokens.items())]
    out = jobs.withColumn("reasons", F.array_compact(F.array(*found))).filter(F.size("reasons") > 0).select("job_id", "source", "host", "name", "reasons")
    if sources is None:
        return out
    error = F.coalesce("error", F.lit("None"))
    reason = F.when(~F.col("reachable"), F.concat(F.lit("source unreachable: "), error)).when(error.startswith("orphaned_comments:"), F.concat(F.lit("crontab describes work it does not run: "), error))
    null = F.lit(None).cast("string")
    return out.unionByName(sources.withColumn("__r", reason).filter("__r is not null").select(null.alias("job_id"), "source", "host", null.alias("name"), F.array("__r").alias("reasons")))


def stale_timers(jobs: DataFrame) -> DataFrame:
    """F-10: passed more than three times what is left; something must be left."""
    passed, left = scalars.duration_us(F.col("passed")), scalars.duration_us(F.col("left"))
    return jobs.filter((left > 0) & (passed > 3 * left))


def vocab_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """F-13."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).groupBy(column).agg(F.count("*").alias("n"))


def snapshot_diff(then: DataFrame, now: DataFrame, key: str = "path", sha: str = "sha") -> DataFrame:
    """J-12: what is missing, added or changed."""
    a, b = then.select(key, F.col(sha).alias("__a")), now.select(key, F.col(sha).alias("__b"))
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "added").when(F.col("__a") != F.col("__b"), "changed")
    return a.join(b, key, "full").withColumn("state", state).filter("state is not null").select(key, "state")


def unseen(items: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """J-13: items of which a session hasn't been told; X-4 is the union of seen and what was shown."""
    return items.join(seen, keys, "left_anti")


def unseen_items(items: DataFrame, seen: DataFrame) -> DataFrame:
    """J-13: of what may be told to sessions (session_id, repo, bucket, key, owner_session, owner_repo) what they haven't been told, without what is of their own session or repository. seen has a row for each (session_id, bucket, key)."""
    other = ~F.coalesce(F.col("owner_session") == F.col("session_id"), F.lit(False)) & ~F.coalesce(F.col("owner_repo") == F.col("repo"), F.lit(False))
    return unseen(items.filter(other), seen, ["session_id", "bucket", "key"])


def advance_seen(seen: DataFrame, shown: DataFrame) -> DataFrame:
    """X-4: the union of what a session had seen and what it was shown, once each."""
    return seen.unionByName(shown).distinct()


def search_index(memories: DataFrame, skills: DataFrame, needle: str) -> DataFrame:
    """X-1: where name or description holds the needle, in which % and _ stand for anything and any character; memories by project and name before skills by name (`place`)."""
    like = f"%{needle.lower()}%"
    hit = lambda df: df.filter(F.lower("name").like(like) | F.lower(F.coalesce("description", F.lit(""))).like(like))
    first = hit(memories).withColumn("kind", F.lit("memory"))
    first = first if "project" in memories.columns else first.withColumn("project", F.lit(None).cast("string"))
    both = first.unionByName(hit(skills).withColumn("kind", F.lit("skill")), allowMissingColumns=True)
    return both.orderBy("kind", "project", "name")


def dangling_links(memories: DataFrame) -> DataFrame:
    """X-3."""
    targets = memories.select(F.explode("links").alias("name")).distinct()
    return targets.join(memories.select("name"), "name", "left_anti")


def fit_to_budget(items: DataFrame, line: Column, cap: int, by: str, order: list[str]) -> DataFrame:
    """W-17: the items, in order, whose lines with their ends fit into cap bytes of UTF-8; the first that doesn't ends it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("__upto", F.sum(F.octet_length(line) + 1).over(w)).filter(F.col("__upto") <= cap).drop("__upto")


def blocking_lines(items: DataFrame, by: str, order: list[str], shown: int = 5) -> DataFrame:
    """W-17: by (a session), place, line and keys of what blocks: the first few items by their own lines, the rest as one line that says how many more there are."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = items.withColumn("__n", F.row_number().over(w))
    own = rows.filter(F.col("__n") <= shown).select(by, F.col("__n").alias("place"), "line", F.array("key").alias("keys"))
    rest = rows.filter(F.col("__n") > shown).groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("key")).alias("keys"))
    return own.unionByName(rest.select(by, F.lit(shown + 1).alias("place"), F.concat(F.lit("- +"), "n", F.lit(" more blocking")).alias("line"), "keys"))


def plan_problems(stages: Column, status: Column, superseded_by: Column, revision: Column) -> Column:
    """A-27: every problem of a plan at once; stages is an array of (name, expected_check, evidence, status)."""
    why = lambda c, t: F.when(F.coalesce(c, F.lit(False)), F.lit(t))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    name = lambda s: F.coalesce(F.nullif(s["name"], F.lit("")), F.lit("?"))
    stage = F.flatten(F.transform(stages, lambda s: F.array_compact(F.array(F.when(F.coalesce(s["expected_check"], F.lit("")) == "", F.concat(F.lit("no_check:"), name(s))), F.when((s["status"] == "done") & blank(s["evidence"]), F.concat(F.lit("done_without_evidence:"), name(s)))))))
    bare = F.transform(F.filter(stages, lambda s: blank(s["evidence"])), name)
    first = F.array_compact(F.array(why((status == "active") & (F.coalesce(F.size(stages), F.lit(0)) <= 0), "active_without_stages")))
    last = F.array_compact(F.array(F.when((status == "done") & (F.size(bare) > 0), F.concat(F.lit("plan_done_without_evidence:"), F.array_join(bare, ","))), why((status == "superseded") & (F.coalesce(superseded_by, F.lit("")) == ""), "superseded_without_pointer"), why(F.coalesce(revision, F.lit(0)) < 1, "bad_revision")))
    return F.concat(first, F.coalesce(stage, F.array().cast("array<string>")), last)
