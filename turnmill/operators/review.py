"""Reports over scored turns: rollups, signals, samples, regressions and path policy (A-3 to A-7, F-14, J-2, J-9, J-16, T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from . import kpi

HOUR = 3_600_000
DAY = 86_400_000
#: Sums of scores: 18 places, of which a sum of sums loses none.
EXACT = "decimal(36,18)"


def turns_in(turns: DataFrame, since: int, until: int, source: str | None = None, host: str | None = None) -> DataFrame:
    """F-1: started_at in [since, until)."""
    out = turns.filter((F.col("started_at") >= since) & (F.col("started_at") < until))
    for name, value in (("source", source), ("host", host)):
        out = out if value is None else out.filter(F.col(name) == value)
    return out


def rollup(turns: DataFrame, events: DataFrame) -> DataFrame:
    """A-3: one row, also for an empty window, which says so."""
    sums = turns.agg(
        F.count("*").alias("turns"), F.coalesce(F.sum(kpi.total_tokens()), F.lit(0)).alias("tokens"), F.count_if(F.col("flagged") == 1).alias("flagged"), F.count_if(F.col("judged") == 1).alias("judged"),
        F.count_if((F.col("flagged") == 1) & (F.col("judged") == 0)).alias("unjudged"), (F.count("*") == 0).alias("empty_window"),
    )
    squeezed = events.filter((F.col("kind") == "compaction") & ~F.col("name").eqNullSafe("context_snapshot")).join(turns.select("turn_id"), "turn_id", "left_semi")
    return sums.crossJoin(squeezed.agg(F.count("*").alias("compactions")))  # one row with one row


def kpi_by_dims(scored: DataFrame) -> DataFrame:
    """A-4: mean score by tier, source and host in one pass; a null tier is unknown, unscored turns are left out."""
    rows = scored.filter(F.col("kpi_score").isNotNull()).select(F.coalesce("tier", F.lit("unknown")).alias("tier"), "source", "host", "kpi_score")
    sets = rows.groupingSets([["tier"], ["source"], ["host"]], "tier", "source", "host").agg(F.avg("kpi_score").alias("mean_kpi"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    dim = F.when(F.col("g") == 3, "tier").when(F.col("g") == 5, "source").otherwise("host")
    return sets.select(dim.alias("dim"), F.coalesce("tier", "source", "host").alias("value"), "mean_kpi", "n")


def tool_failures(events: DataFrame, n: int | None = 10) -> DataFrame:
    """A-5: tools with a failure (ok = 0; null isn't one), most first."""
    out = events.filter(F.col("kind") == "tool_call").groupBy("name").agg(F.count_if(F.col("ok") == 0).alias("failures"), F.count("*").alias("calls")).filter("failures > 0")
    return out if n is None else out.orderBy(F.desc("failures"), "name").limit(n)


#: Signals of A-6: what counts, what it is counted by, from how many on.
SIGNALS = [
    ("repeated_tool_failure", "kind = 'tool_call' and ok = 0", "name", 3), ("permission_denials", "kind = 'permission' and decision = 'deny'", "''", 2), ("hook_error", "kind = 'hook' and ok = 0", "name", 1),
    ("edit_revert_loop", "kind = 'revert'", "coalesce(path, '')", 2), ("repeated_interrupts", "kind = 'interrupt'", "''", 2),
]


def session_signals(turns: DataFrame, events: DataFrame) -> DataFrame:
    """A-6, event branches: signal, session_id, subject, n. An event belongs to one signal at most, so all are counted in one aggregation."""
    kind = subject = least = None
    for name, which, by, n in SIGNALS:
        c = F.expr(which)
        kind = F.when(c, F.lit(name)) if kind is None else kind.when(c, F.lit(name))
        subject = F.when(c, F.expr(by)) if subject is None else subject.when(c, F.expr(by))
        least = F.when(F.col("signal") == name, n) if least is None else least.when(F.col("signal") == name, n)
    rows = events.withColumn("signal", kind).withColumn("subject", subject).filter("signal is not null").select("turn_id", "signal", "subject")
    n = rows.join(turns.select("turn_id", "session_id"), "turn_id").groupBy("signal", "session_id", "subject").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") >= least)


def probe_signals(probes: DataFrame) -> DataFrame:
    """A-6, probe branch: the latest of each host and kind (W-14) if unhealthy; a finding of its own if no probe ever ran."""
    latest = latest_probe(probes).filter("not (total > 0 and ok = total)").select(F.concat(F.lit("probe_"), "kind").alias("signal"), "host", "ok", "total")
    never = probes.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("probe_never_ran").alias("signal"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("long").alias("ok"), F.lit(None).cast("long").alias("total"))
    return latest.unionByName(never)


def latest_probe(probes: DataFrame) -> DataFrame:
    """W-14."""
    return probes.groupBy("host", "kind").agg(F.max(F.struct("ts", "ok", "total")).alias("x")).select("host", "kind", "x.ts", "x.ok", "x.total")


def complex_turns(turns: DataFrame, events: DataFrame, k: int = 10) -> DataFrame:
    """T-1: the k turns of the largest (1 + tools)(1 + paths) max(1, tokens) / 1000, and how many more there are."""
    facts = events.groupBy("turn_id").agg(F.count_distinct(F.when(F.col("kind") == "tool_call", F.col("name"))).alias("tools"), F.count_distinct(F.when(F.col("kind").isin("edit", "revert"), F.col("path"))).alias("paths"))
    full = turns.join(facts, "turn_id", "left").fillna(0, ["tools", "paths"])
    score = (1 + F.col("tools")) * (1 + F.col("paths")) * F.greatest(F.lit(1), kpi.total_tokens()) / 1000
    top = full.withColumn("complexity", score).orderBy(F.desc("complexity"), "started_at", "turn_id").limit(k).select("turn_id", "complexity")
    return top.crossJoin(turns.agg(F.greatest(F.lit(0), F.count("*") - k).alias("dropped")))  # k rows with one row


def low_kpi_turns(scored: DataFrame, judgments: DataFrame, k: int = 15) -> DataFrame:
    """J-16 and T-2: scored turns without a judgment, lowest first."""
    rows = scored.filter("kpi_score is not null").join(judgments.select("turn_id"), "turn_id", "left_anti")
    top = rows.orderBy("kpi_score", "started_at", "turn_id").limit(k).select("turn_id", "kpi_score")
    return top.crossJoin(rows.agg(F.greatest(F.lit(0), F.count("*") - k).alias("dropped")))


def pending_judgments(scored: DataFrame, k: int = 20) -> DataFrame:
    """T-3: flagged and unjudged, newest first."""
    return scored.filter("flagged = 1 and judged = 0").orderBy(F.desc("started_at"), F.desc("turn_id")).limit(k).select("turn_id", "started_at")


def judge_overflow(scored: DataFrame, cap: int = 20) -> DataFrame:
    """T-4: a failed queue event for each pending turn behind the newest cap. Only those newest are looked up, the rest is compared with the last of them."""
    rows = scored.filter("flagged = 1 and judged = 0")
    newest = rows.orderBy(F.desc("started_at"), F.desc("turn_id")).limit(cap)
    edge = newest.agg(F.min(F.struct("started_at", "turn_id")).alias("edge"), F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(edge)).filter((F.col("n") >= cap) & (F.struct("started_at", "turn_id") < F.col("edge"))).select("turn_id", F.lit("queue").alias("kind"), F.lit(0).alias("ok"))


def sums_before(rows: DataFrame, points: DataFrame, at: str, value: str, block: int = HOUR) -> DataFrame:
    """Prefix sums over time: for each different time of points (at), sum and n of the rows' values before it. No point meets a row: rows are summed by
    time, then by block; the blocks are cumulated, one row each, and inside a block at most as many times as it has units are. Sums are decimal, so that differences of them are exact."""
    times = rows.filter(F.col(value).isNotNull()).groupBy(F.col(at).alias("at")).agg(F.sum(F.col(value).cast("decimal(20,18)")).cast(EXACT).alias("s"), F.count("*").alias("c"))
    marks = times.withColumn("asked", F.lit(False)).unionByName(points.select("at", F.lit(0).cast(EXACT).alias("s"), F.lit(0).cast("long").alias("c"), F.lit(True).alias("asked")).filter("at is not null").distinct())
    marks = marks.withColumn("block", F.floor(F.col("at") / block))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = marks.groupBy("block").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).select("block", F.coalesce(F.sum("s").over(before).cast(EXACT), F.lit(0).cast(EXACT)).alias("base_s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base_c"))
    inside = Window.partitionBy("block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("in_s", F.coalesce(F.sum("s").over(inside).cast(EXACT), F.lit(0).cast(EXACT))).withColumn("in_c", F.coalesce(F.sum("c").over(inside), F.lit(0))).filter("asked")
    return marks.join(bases, "block").select("at", (F.col("base_s") + F.col("in_s")).alias("sum"), (F.col("base_c") + F.col("in_c")).alias("n"))


def regression_check(changes: DataFrame, scored: DataFrame, now: int, half: int = 7 * DAY, least: int = 30, drop: float = -0.05) -> DataFrame:
    """J-9 and A-7: mean score before and after each change of 2 to 14 days' age. Each change takes differences of three prefix sums over time, so that the work is changes and turns, not their pairs."""
    live = changes.filter(F.col("reverted_at").isNull() & F.col("applied_at").between(now - 14 * DAY, now - 2 * DAY))
    t = F.col("applied_at")
    edge = F.explode(F.array(*(F.struct(p.alias("at"), F.lit(x).alias("before"), F.lit(y).alias("after")) for p, x, y in ((t - half, -1, 0), (t, 1, -1), (F.least(F.lit(now), t + half), 0, 1)))))
    edges = live.select("change_id", edge.alias("e")).select("change_id", "e.*")
    near = scored.filter((F.col("started_at") >= now - 14 * DAY - half) & (F.col("started_at") < now))
    told = edges.join(sums_before(near, edges.select("at"), "started_at", "kpi_score"), "at")
    parts = [F.sum(F.when(F.col(side) == 1, F.col(c)).when(F.col(side) == -1, -F.col(c))).alias(f"{c}_{side}") for c in ("sum", "n") for side in ("before", "after")]
    sums = told.groupBy("change_id").agg(*parts)
    mean = lambda side: F.when(F.col(f"n_{side}") > 0, F.col(f"sum_{side}").cast("double") / F.col(f"n_{side}")).alias(f"mean_{side}")
    out = live.select("change_id").join(sums.select("change_id", mean("before"), mean("after"), F.col("n_before").cast("long").alias("n_before"), F.col("n_after").cast("long").alias("n_after")), "change_id", "left").fillna(0, ["n_before", "n_after"])
    delta = F.when(F.col("mean_before") == 0, F.lit(0.0)).otherwise((F.col("mean_after") - F.col("mean_before")) / F.col("mean_before"))
    verdict = F.when((F.col("n_before") < least) | (F.col("n_after") < least), "insufficient_samples").when(F.col("delta") < drop, "revert").otherwise("keep")
    return out.withColumn("delta", delta).withColumn("verdict", verdict)


def mark_reverted(changes: DataFrame, verdicts: DataFrame, now: int) -> DataFrame:
    """U-18: changes whose verdict is revert get a time and a reason, unless they have them."""
    bad = verdicts.filter("verdict = 'revert'").select("change_id", F.concat(F.lit("kpi "), F.format_string("%.1f", F.col("delta") * 100), F.lit("%")).alias("__why"))
    out = changes.join(bad, "change_id", "left")
    fresh = F.col("__why").isNotNull() & F.col("reverted_at").isNull()
    reason = F.col("revert_reason") if "revert_reason" in changes.columns else F.lit(None).cast("string")
    return out.withColumn("revert_reason", F.when(fresh, F.col("__why")).otherwise(reason)).withColumn("reverted_at", F.when(fresh, F.lit(now)).otherwise(F.col("reverted_at"))).drop("__why")


def reverted(changes: DataFrame, k: int | None = None) -> DataFrame:
    """U-18: what was reverted, newest first."""
    rows = changes.filter("reverted_at is not null")
    return rows if k is None else rows.orderBy(F.desc("applied_at"), F.desc("change_id")).limit(k)


def review_sample(scored: DataFrame, events: DataFrame, judgments: DataFrame, probes: DataFrame, complex_k: int = 10, low_k: int = 15) -> DataFrame:
    """T-5, as rows (part, subject, value): the aggregates (A-3), the most complex turns (T-1), the lowest scores (T-2), each with how many were left out (part_dropped), and all signals of sessions and probes (A-6).

    The scores are read by six parts and are written once."""
    scored = kept(scored, "scored")
    part = lambda df, name, subject, value: df.select(name.alias("part") if not isinstance(name, str) else F.lit(name).alias("part"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))
    totals = rollup(scored, events)
    names = ["turns", "tokens", "flagged", "judged", "unjudged", "compactions"]
    pairs = totals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in names))).alias("x"))
    out = part(pairs, "aggregate", F.col("x.k"), F.col("x.v"))
    for name, top, value in (("complex", complex_turns(scored, events, complex_k), "complexity"), ("low_kpi", low_kpi_turns(scored, judgments, low_k), "kpi_score")):
        out = out.unionByName(part(top, name, F.col("turn_id"), F.col(value))).unionByName(part(top.agg(F.max("dropped").alias("d")), f"{name}_dropped", F.lit(""), F.coalesce("d", F.lit(0))))
    own = session_signals(scored, events)
    out = out.unionByName(part(own, F.concat(F.lit("signal_"), "signal"), F.concat_ws(" ", "session_id", "subject"), F.col("n")))
    return out.unionByName(part(probe_signals(probes), F.concat(F.lit("signal_"), "signal"), F.coalesce(F.col("host").cast("string"), F.lit("")), F.col("ok")))


def glob_regex(glob: str) -> str:
    """A glob whose * crosses slashes; a/**/b also matches a/b."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("/**/", i):
            out, i = out + "(?:/|/.*/)", i + 4
        elif glob[i] == "*":
            out, i = out + ".*", i + (2 if glob.startswith("**", i) else 1)
        elif glob[i] == "?":
            out, i = out + ".", i + 1
        else:
            out, i = out + ("\\" if glob[i] in "\\.^$+{}()|[]" else "") + glob[i], i + 1
    return f"(?s)^{out}$"


def path_policy(paths: DataFrame, allow: list[str], deny: list[str]) -> DataFrame:
    """F-14: reason of each path; deny beats allow, the first pattern in the list's order counts. The lists are literals, not rows."""
    parts = F.filter(F.split("path", "/"), lambda x: ~x.isin("", "."))
    # a step up takes the last step away; one too many leaves the root
    step = lambda acc, x: F.when(acc.isNull(), acc).when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
    clean = F.aggregate(parts, F.array().cast("array<string>"), step)
    rows = paths.withColumn("__clean", F.when(F.col("path").startswith("/"), None).otherwise(clean)).withColumn("__path", F.array_join("__clean", "/"))
    rule = F.when(F.col("__clean").isNull(), "outside_repo")
    for word, globs in (("denied", deny), ("allowed", allow)):
        for g in globs:
            rule = rule.when(F.col("__path").rlike(glob_regex(g)), f"{word}:{g}")
    return rows.withColumn("reason", rule.otherwise("not_in_allowlist")).withColumn("allowed", F.col("reason").startswith("allowed:")).drop("__clean", "__path")


def pending_decisions(scored: DataFrame, decisions: DataFrame, domain: str, since: int) -> DataFrame:
    """J-2."""
    return scored.filter((F.col("started_at") >= since) & F.col("kpi_score").isNotNull()).join(decisions.filter(F.col("domain") == domain).select("turn_id"), "turn_id", "left_anti")


def close_orphans(turns: DataFrame, events: DataFrame) -> DataFrame:
    """W-15: a turn without an end that another follows in its session ends with its last event, at or after its start."""
    follows = F.lead("started_at").over(Window.partitionBy("session_id").orderBy("started_at", "turn_id")).isNotNull()
    last = events.groupBy("turn_id").agg(F.max("ts").alias("__last"))
    rows = turns.withColumn("__open", F.col("ended_at").isNull() & follows).join(last, "turn_id", "left")
    end = F.coalesce("__last", "started_at")
    return rows.filter("__open").select("turn_id", end.alias("ended_at"), F.greatest(F.lit(0), end - F.col("started_at")).alias("wall_ms"))
