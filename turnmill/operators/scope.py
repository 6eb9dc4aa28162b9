"""Scoping measures: records, baselines, streaks, replays and learned phrases (A-10 to A-13, A-22, W-8, W-10 to W-12, L)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import kept
from . import scan, trace
from .phrases import windows

LEAST = 20


#: The rates of A-10: name, what is counted, over what.
RATES = [
    ("late_discovery_rate", "late_discovered", "found_total"), ("rework_rate", "rework_files", "files_edited"), ("clarification_value_rate", "questions_valuable", "questions_asked"), ("questions_per_task", "questions_asked", None),
    ("corrections_per_task", "corrections", None), ("assumption_override_rate", "assumptions_overridden", "assumptions"), ("divergence_precision", "divergence_kept", "divergence_flagged"),
]
MEANS = ["ceremony_tokens", "ceremony_ms", "turns_to_done"]
TIERS = ["none", "mini", "full"]


def _measured(records: DataFrame, keys: list[str]) -> DataFrame:
    is_ = lambda c: F.count_if(F.expr(c))
    over = lambda c: F.count("*") if c is None else F.sum(c)
    sums = [
        F.count("*").alias("rows"), is_("verdict <> 'silent'").alias("observed_rows"), is_("verdict = 'silent'").alias("unobserved_rows"), is_("verdict = 'pass'").alias("healthy_rows"), is_("verdict not in ('pass', 'silent')").alias("failed_rows"),
        *(F.try_divide(F.sum(a), over(b)).alias(name) for name, a, b in RATES), *(F.avg(c).alias(f"{c}_mean") for c in MEANS), *(F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in TIERS), F.coalesce(F.sum("found_total"), F.lit(0)).alias("__found"),
    ]
    out = (records.groupBy(*keys) if keys else records.groupBy()).agg(*sums)
    verdict = F.when(F.col("observed_rows") == 0, "silent").when(F.col("failed_rows") > 0, "fail").otherwise("pass")
    unpaired = F.when((F.col("__found") > 0) & F.col("ceremony_tokens_mean").isNull() & F.col("ceremony_ms_mean").isNull(), F.array(F.lit("late_discovery_rate"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("healthy_rate", F.try_divide("healthy_rows", "observed_rows")).withColumn("verdict", verdict).withColumn("sample_warning", F.col("observed_rows") < LEAST).withColumn("unpaired", unpaired).drop("__found")


def scope_aggregate(records: DataFrame) -> DataFrame:
    """A-10: one row, silent if nothing was observed; a rate or mean over nothing is null, and a coverage figure without any cost beside it is named."""
    return _measured(records, [])


def scope_by_tier(records: DataFrame) -> DataFrame:
    """A-11: the same by tier; a tier without rows has none here."""
    return _measured(records.filter(F.col("tier").isin(TIERS)), ["tier"])


def disposition_violations(records: DataFrame) -> DataFrame:
    """F-16."""
    return records.filter("committed + non_goals + assumptions <> found_total")


def session_baseline(turns: DataFrame, edits: DataFrame | None = None, nested: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """A-12. turns: human turns (session, text); edits and nested: edits of the session itself and of its subagents (session, ts, path); rows: any rows (session, at, timestamp, cwd, branch, version) in order of `at`.

    A file is reworked if it is edited again after another one (W-5); subagents' edits count in a second pair of figures."""
    fams = T.correction_families(F.col("text"))
    each = [F.count_if(F.array_contains(fams, k)).alias(k) for k in T.CORRECTIONS]
    out = turns.groupBy("session").agg(F.count("*").alias("turns"), F.count_if(F.size(fams) > 0).alias("corrections"), *each)
    if rows is not None:
        said = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
        last = F.max_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("at"))).alias("ts_last")
        out = rows.groupBy("session").agg(said("timestamp").alias("ts_first"), last, said("cwd"), said("branch"), said("version")).join(out, "session", "left")
    counted = ["turns", "corrections", *T.CORRECTIONS]
    if edits is not None:
        both = edits.select("session", "ts", "path") if nested is None else edits.select("session", "ts", "path").unionByName(nested.select("session", "ts", "path"))
        for name, some in (("", edits), ("_incl_sub", both)):
            files = trace.edit_episodes(some.withColumnRenamed("session", "session_id")).groupBy(F.col("session_id").alias("session")).agg(F.count("*").alias(f"files_edited{name}"), F.count_if(F.col("episodes") >= 2).alias(f"rework_files{name}"))
            out = out.join(files, "session", "left")
            counted += [f"files_edited{name}", f"rework_files{name}"]
        ops = (edits.limit(0) if nested is None else nested).groupBy("session").agg(F.count("*").alias("sub_edit_ops"))
        out = out.join(ops, "session", "left")
        counted.append("sub_edit_ops")
    return out.fillna(0, counted)


def corpus_baseline(sessions: DataFrame) -> DataFrame:
    """A-13: sessions of two human turns or more are conversational, those that edited a file are editing; each rate names what it is over."""
    talk = F.col("turns") >= 2
    of = lambda c: F.sum(F.when(talk, F.col(c)))
    more = []
    for name in ("", "_incl_sub"):
        if f"files_edited{name}" in sessions.columns:
            files, again = F.sum(f"files_edited{name}"), F.sum(F.when(F.col(f"files_edited{name}") >= 1, F.col(f"rework_files{name}")))
            more += [files.alias(f"files_edited{name}"), again.alias(f"rework_files{name}"), F.try_divide(again, files).alias(f"rework_rate{name}")]
    if more:
        more.append(F.count_if(F.col("files_edited") >= 1).alias("editing"))
    return sessions.agg(
        F.count("*").alias("sessions"), F.count_if(talk).alias("conversational"), of("turns").alias("human_turns"), of("corrections").alias("correction_turns"), F.try_divide(of("corrections"), of("turns")).alias("per_turn"),
        F.try_divide(F.count_if(talk & (F.col("corrections") > 0)), F.count_if(talk)).alias("per_session"), *(F.coalesce(of(k), F.lit(0)).alias(k) for k in T.CORRECTIONS), *more,
    )


def gate(prompt: Column, extra: dict[str, list[str]] | None = None) -> tuple[Column, Column]:
    """Z-3, the gate's own rules: the tier of a prompt without and with an open scope."""
    signals = T.gate_signals(prompt, extra)
    return T.gate_tier(signals, F.lit(False))[0], T.gate_tier(signals, F.lit(True))[0]


def gate_replay(turns: DataFrame, extra: dict[str, list[str]] | None = None, classifier: Callable[[Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """W-12, Z-3 (classifier: a prompt's tiers without and with an open scope): each turn's tier where a scope counts as open once an earlier turn of the session had a tier other than none.

    The first such turn was judged without an open scope, so "some earlier turn would have a tier without a scope" is the same as "a scope is open", and a session's blocks need only tell whether one was in them."""
    return _gated(scan.cut(turns, *TURN_ORDER, also=_tiers(extra, classifier))).drop(scan.BLOCK)


TURN_ORDER = (["session"], ["idx"])


def _tiers(extra: dict[str, list[str]] | None = None, classifier: Callable[[Column], tuple[Column, Column]] | None = None) -> dict[str, Column]:
    alone, within = (classifier or (lambda c: gate(c, extra)))(F.col("text"))
    return {"__a": alone, "__w": within}


def _gated(turns: DataFrame) -> DataFrame:
    rows = scan.scan(turns, *TURN_ORDER, active=scan.ever(F.col("__a") != "none"))
    return rows.withColumn("tier", F.when(F.col("active"), F.col("__w")).otherwise(F.col("__a"))).drop("__a", "__w")


def next_corrected(turns: DataFrame) -> DataFrame:
    """W-8: whether the session's next human turn is a correction; after the last there is none."""
    return _corrected(scan.cut(turns, *TURN_ORDER, also=_corrects())).drop(scan.BLOCK)


def _corrects() -> dict[str, Column]:
    return {"__c": F.size(T.correction_families(F.col("text"))) > 0}


def _corrected(turns: DataFrame) -> DataFrame:
    return scan.scan(turns, *TURN_ORDER, next_corrected=scan.after(F.col("__c"))).fillna(False, ["next_corrected"]).drop("__c")


def replayed(turns: DataFrame, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """W-12 and W-8, written to the shared folder, so that what is learned from it doesn't try the gate's rules again."""
    return kept(_corrected(_gated(scan.cut(turns, *TURN_ORDER, also=_tiers(extra) | _corrects()))).drop(scan.BLOCK), "replayed")


MISSED = "tier = 'none' and not active and next_corrected"


def false_none(events: DataFrame) -> DataFrame:
    """L-1: turns that were let through and corrected right after, over all that were let through without an open scope."""
    base = (F.col("tier") == "none") & ~F.col("active")
    return events.agg(F.count_if(F.expr(MISSED)).alias("false_none"), F.count_if(base).alias("base")).withColumn("rate", F.col("false_none") / F.greatest(F.lit(1), F.col("base")))


def mine_phrases(events: DataFrame, known: list[str], shown: int = 4) -> DataFrame:
    """L-2: n-grams of missed turns that hold no known phrase, with how many turns each is in (evidence) and the first few of them (session#index)."""
    grams = events.filter(MISSED).select("session", "idx", F.explode(T.word_ngrams(F.col("text"))).alias("phrase"))
    if known:
        grams = grams.filter(~F.col("phrase").rlike(T._any(known)))
    n = grams.groupBy("phrase").agg(F.count("*").alias("evidence"))
    first = grams.withColumn("__n", F.row_number().over(Window.partitionBy("phrase").orderBy("session", "idx"))).filter(F.col("__n") <= shown)  # trimmed before the shuffle too
    where = first.groupBy("phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.concat_ws("#", "session", "idx").alias("at")))), lambda x: x["at"]).alias("where"))
    return n.join(where, "phrase")


def _phrases(candidates: DataFrame) -> DataFrame:
    return kept(candidates.select("phrase").filter("phrase <> ''").distinct(), "phrases")


def phrase_hits(candidates: DataFrame, turns: DataFrame) -> DataFrame:
    """J-11: each (phrase, session, idx) whose lower-cased text contains the phrase, of one word or more, wherever in a word it begins. candidates: phrase (null and empty ones hit nothing); turns: session, idx, text.

    A text gives its windows that a filter takes for phrases (phrases.windows); the join with the phrases is exact."""
    own = _phrases(candidates)
    return windows(own, turns.select("session", "idx", F.lower("text").alias("text"))).join(own, "phrase", "left_semi").select("phrase", "session", "idx")


def phrase_counts(candidates: DataFrame, turns: DataFrame) -> DataFrame:
    """J-11, counted: for each phrase that some text contains, in how many turns it is (n). Counted before anything is sent, so that hits of a frequent phrase don't meet in one task."""
    own = _phrases(candidates)
    return windows(own, turns.select(F.lower("text").alias("text"))).groupBy("phrase").agg(F.count("*").alias("n")).join(own, "phrase", "left_semi")


def score_phrases(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """L-3: of the turns let through without an open scope, those that contain a phrase: helpful if they were corrected, else harmful."""
    rows = events.filter((F.col("tier") == "none") & ~F.col("active"))
    hits = windows(_phrases(candidates), rows.select("next_corrected", F.lower("text").alias("text")))
    sums = hits.groupBy("phrase").agg(F.count_if(F.expr("next_corrected")).alias("helpful"), F.count_if(~F.col("next_corrected")).alias("harmful"))
    out = candidates.join(sums, "phrase", "left").fillna(0, ["helpful", "harmful"])  # which leaves out what only the filter took for a phrase
    return out.withColumn("ratio", F.try_divide("helpful", F.col("helpful") + F.col("harmful")))


LEAST_HELPFUL, LEAST_RATIO, LEAST_TOTAL, MOST_RATIO = 3, 0.7, 5, 0.5


def propose(scores: DataFrame, k: int = 10) -> DataFrame:
    """L-4: of the phrases with a helpful hit, by ratio, hits and name: the best k that clear the bar (clearing), and those among the best k of all that don't (below)."""
    some = scores.filter("helpful >= 1").withColumn("clears", (F.col("helpful") >= LEAST_HELPFUL) & (F.col("ratio") >= LEAST_RATIO))
    order = [F.desc("ratio"), F.desc("helpful"), "phrase"]
    best = some.orderBy(*order).limit(k).filter("not clears").withColumn("part", F.lit("below"))
    return some.filter("clears").orderBy(*order).limit(k).withColumn("part", F.lit("clearing")).unionByName(best)


def proposal_verdict(proposed: DataFrame) -> DataFrame:
    """L-4: pass with how many cleared the bar; silent if none did."""
    n = F.count_if(F.col("part") == "clearing")
    return proposed.agg(n.alias("clearing")).withColumn("verdict", F.when(F.col("clearing") > 0, "pass").otherwise("silent"))


def apply_overlay(base: list[str], entries: DataFrame, registry: str) -> DataFrame:
    """L-6: phrase and its place: the base list as it is, then the active learned phrases that it doesn't hold, sorted. Nothing is taken away."""
    own = entries.sparkSession.createDataFrame([(i, p) for i, p in enumerate(base)], "place int, phrase string")
    more = entries.filter((F.col("registry") == registry) & (F.col("status") == "active")).select("phrase").distinct().join(own, "phrase", "left_anti")
    return own.unionByName(more.withColumn("place", F.lit(len(base)) + F.row_number().over(Window.orderBy("phrase")) - 1))


def learn(scores: DataFrame, entries: DataFrame, registry: str = "vague", k: int = 10, falsy_zero: bool = False) -> DataFrame:
    """L-7, the registry after learning: phrases that clear the bar become active with their counts and evidence; an entry of five hits or more whose ratio is below a half is retired. falsy_zero leaves entries of ratio 0 active, as the original arithmetic does."""
    clear = propose(scores, k).filter("part = 'clearing'").select("phrase", F.col("helpful").alias("__h"), F.col("harmful").alias("__b"), F.lit(True).alias("promoted"))
    held = entries.filter(F.col("registry") == registry).select("phrase", "helpful", "harmful", "status")
    both = held.join(clear, "phrase", "full").withColumns({"helpful": F.coalesce("__h", "helpful"), "harmful": F.coalesce("__b", "harmful"), "promoted": F.coalesce("promoted", F.lit(False))})
    total = F.col("helpful") + F.col("harmful")
    low = F.try_divide("helpful", total) < MOST_RATIO
    gone = F.coalesce((total >= LEAST_TOTAL) & (low & (F.col("helpful") > 0) if falsy_zero else low), F.lit(False))
    was = F.when(F.col("promoted"), "active").otherwise(F.col("status"))
    return both.select("phrase", F.lit(registry).alias("registry"), "helpful", "harmful", F.when(gone, "retired").otherwise(was).alias("status"), "promoted", (gone & (was == "active")).alias("demoted"))


def tuning_row(learned: DataFrame, check: DataFrame, now_ms: int, dry_run: bool = True) -> DataFrame:
    """L-7: what is to be told of a run: rejected where the share let through would grow too much, else the row of a tuning change (times in ms); a dry run applies nothing."""
    n = learned.agg(F.count_if("promoted").alias("promoted"), F.count_if("demoted").alias("demoted"))
    one = n.crossJoin(check.select("before", "after", F.col("ok").alias("passed")))  # one row with one row
    fine = F.col("passed") & (F.col("promoted") > 0)
    verdict = F.when(F.col("promoted") == 0, "silent").when(~F.col("passed"), "fail").otherwise("pass")
    said = F.concat(F.lit("promoted "), F.col("promoted"), F.lit(", retired "), F.col("demoted"))
    return one.select("promoted", "demoted", F.col("before").alias("kpi_before"), F.col("after").alias("kpi_after"), verdict.alias("verdict"), (fine & F.lit(not dry_run)).alias("applied"), F.when(fine, F.lit(now_ms)).alias("applied_at"), F.when(fine, said).alias("summary"))


def suppression_check(before: DataFrame, after: DataFrame, most: float = 0.10) -> DataFrame:
    """L-5: whether the share of turns let through grows by no more than most."""
    share = lambda df, name: df.agg(F.avg((F.col("tier") == "none").cast("double")).alias(name))
    return share(before, "before").crossJoin(share(after, "after")).withColumn("ok", F.col("after") - F.col("before") <= most)


def zero_streak(history: DataFrame, limit: int = 3) -> DataFrame:
    """W-10: fail if the last limit counts are all zero, silent without any."""
    last = history.agg(F.max(F.when(F.col("value") != 0, F.col("day"))).alias("last"), F.count("*").alias("n"))
    run = history.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("last").isNull() | (F.col("day") > F.col("last"))).alias("streak"), F.count("*").alias("n"))
    return run.select("streak", F.when(F.col("n") == 0, "silent").when(F.col("streak") >= limit, "fail").otherwise("pass").alias("verdict"))


def gate_summary(log: DataFrame) -> DataFrame:
    """A-22: by UTC day: decisions, those with a tier other than none, and their share; suppressed rows have no tier."""
    rows = log.filter("tier is not null")
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.expr("tier <> 'none'")).alias("ceremonial")).withColumn("rate", F.col("ceremonial") / F.col("n"))


def gate_tiers(log: DataFrame) -> DataFrame:
    """A-22: decisions by tier (? where a row has none), all of them (tier null), and the share of those other than none."""
    rows = log.withColumn("tier", F.coalesce("tier", F.lit("?")))
    return rows.rollup("tier").agg(F.count("*").alias("n"), F.count_if(F.expr("tier <> 'none'")).alias("ceremonial")).withColumn("rate", F.try_divide("ceremonial", "n"))
