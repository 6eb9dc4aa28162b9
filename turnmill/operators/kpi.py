"""Scores of turns: components (K-1 to K-6), composite (K-7), flags (K-8, K-9), baselines (A-2, W-1) and the whole job (K-10).

What was not observed is null and scores neutral; a turn without events gets the same row as one whose events show nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .percentiles import nearest

COMPONENTS = ["completion", "tool_reliability", "efficiency", "focus", "context_health", "autonomy"]
WEIGHTS = dict(zip(COMPONENTS, (0.20, 0.20, 0.15, 0.15, 0.15, 0.15)))
WEEK = 7 * 86_400_000
ERROR_RATE, LOW_KPI = 0.25, 0.5


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def total_tokens() -> Column:
    """F-4."""
    return F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))


def occupancy() -> Column:
    """F-4: null if nothing was observed, 1 at most. (least() alone would take the null for no value.)"""
    share = F.try_divide("context_peak", F.nullif("context_window", F.lit(0)))
    return F.when(share.isNotNull(), F.least(F.lit(1.0), share))


def event_facts(events: DataFrame) -> DataFrame:
    """One row for each turn with events: all counts that the components need, in one aggregation (N-1, W-13)."""
    is_ = lambda k: F.col("kind") == k
    n = lambda c: F.count_if(c)
    edits = F.when(is_("edit"), F.coalesce("path", F.lit("\0")))
    return events.groupBy("turn_id").agg(
        n(is_("tool_call")).alias("calls"), n(is_("tool_call") & (F.col("ok") == 0)).alias("failed"), n(is_("edit")).alias("edits"), (n(is_("edit")) - F.count_distinct(edits)).alias("repeat_edits"),
        n(is_("revert")).alias("reverts"), n(is_("compaction") & ~F.col("name").eqNullSafe("context_snapshot")).alias("compactions"), n(is_("interrupt")).alias("interrupts"),
        n(is_("permission") & (F.col("decision") == "deny")).alias("denials"), n(is_("todo")).alias("todos"), F.sum(F.when(is_("todo"), F.col("opened"))).alias("opened"),
        F.sum(F.when(is_("todo"), F.col("closed"))).alias("closed"), n(is_("critic") & (F.col("verdict") == "fail")).alias("critic_fails"),
    )


FACTS = ["calls", "failed", "edits", "repeat_edits", "reverts", "compactions", "interrupts", "denials", "todos", "opened", "closed", "critic_fails"]


def with_facts(turns: DataFrame, events: DataFrame) -> DataFrame:
    return turns.join(event_facts(events), "turn_id", "left").fillna(0, FACTS)


def completion() -> Column:
    bad = F.coalesce(F.col("outcome").isin("error", "cancelled"), F.lit(False))
    done = F.when((F.col("todos") > 0) & (F.col("opened") > 0), clamp(F.col("closed") / F.col("opened"))).otherwise(F.lit(1.0))
    capped = F.when(F.col("critic_fails") > 0, F.least(done, F.lit(0.5))).otherwise(done)
    return F.when(bad, F.lit(0.0)).otherwise(capped)


def tool_reliability() -> Column:
    return F.when(F.col("calls") == 0, F.lit(1.0)).otherwise(1 - F.col("failed") / F.col("calls"))


def efficiency(baseline: str = "base_tokens") -> Column:
    return F.when(F.col(baseline).isNull() | (total_tokens() == 0), F.lit(1.0)).otherwise(clamp(F.col(baseline) / total_tokens()))


def focus() -> Column:
    return clamp(1 - (F.col("repeat_edits") + 2 * F.col("reverts")) / F.greatest(F.lit(1), F.col("edits")))


def context_health() -> Column:
    return clamp(1 - F.coalesce(occupancy(), F.lit(0.0)) - 0.2 * F.col("compactions"))


def autonomy() -> Column:
    return 1 - F.least(F.lit(1.0), (F.col("interrupts") + F.col("denials")) / 3)


def composite(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum; a component without a weight counts nothing."""
    return sum((F.col(c) * F.lit(float(w)) for c, w in weights.items() if c in COMPONENTS), F.lit(0.0))


def trailing_baseline(turns: DataFrame, window_ms: int = WEEK, due: DataFrame | None = None) -> DataFrame:
    """A-2: median tokens and p95 wall time of each (source, tier) in the time up to its last turn (of due, the turns to be scored, if given). A null tier takes all tiers of the source."""
    last = (turns if due is None else due).groupBy("source", "tier").agg(F.max("started_at").alias("before"))
    facts = turns.select("source", F.col("tier").alias("t"), "started_at", F.when(total_tokens() > 0, total_tokens()).alias("tokens"), "wall_ms")
    near = facts.join(last, "source").filter((F.col("tier").isNull() | (F.col("tier") == F.col("t"))) & (F.col("started_at") < F.col("before")) & (F.col("started_at") >= F.col("before") - window_ms))
    near = near.withColumn("tier", F.coalesce("tier", F.lit("\0")))
    tokens = nearest(near, ["source", "tier"], "tokens", {"base_tokens": 0.5})
    wall = nearest(near, ["source", "tier"], "wall_ms", {"base_wall": 0.95})
    keys = last.select("source", F.coalesce("tier", F.lit("\0")).alias("tier"))
    out = keys.join(tokens, ["source", "tier"], "left").join(wall, ["source", "tier"], "left")
    return out.withColumn("tier", F.nullif("tier", F.lit("\0")))


def trailing_percentiles(turns: DataFrame, window_ms: int = WEEK) -> DataFrame:
    """W-1: each turn's own baseline, over [started_at - window, started_at) of its source and tier, a null tier being one of its own.

    A group's time is cut into blocks as long as the window; the turns of a block and, as company, those of the one before go by in order, and only those of the window are held, sorted by value: a row is put in and taken out once, and no list is made for it."""
    import bisect
    from collections import deque

    import pyarrow as pa

    columns = ["turn_id", "source", "tier", "started_at", "t", "wall_ms", "block", "own"]

    def place(values: list, p: float):
        return values[round(p * (len(values) - 1))] if values else None  # half to even, as rint

    def run(parts):
        now, tokens, walls, waiting, held = None, [], [], [], deque()
        for part in parts:
            out = []
            for turn, source, tier, at, t, wall, block, own in zip(*(part[c].to_pylist() for c in columns)):  # longs stay whole beside nulls
                if (source, tier, block) != now:
                    now, tokens, walls, waiting, held = (source, tier, block), [], [], [], deque()
                if waiting and waiting[0][0] < at:  # rows of an earlier time are in the window from now on
                    for x in waiting:
                        held.append(x)
                        for values, v in ((tokens, x[1]), (walls, x[2])):
                            if v is not None:
                                bisect.insort(values, v)
                    waiting = []
                while held and held[0][0] < at - window_ms:
                    _, a, b = held.popleft()
                    for values, v in ((tokens, a), (walls, b)):
                        if v is not None:
                            del values[bisect.bisect_left(values, v)]
                if own:
                    out.append((turn, place(tokens, 0.5), place(walls, 0.95)))
                waiting.append((at, t, wall))
            turn, tokens_, walls_ = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(turn, part.schema.field("turn_id").type), pa.array(tokens_, pa.int64()), pa.array(walls_, pa.int64())], ["turn_id", "base_tokens", "base_wall"])

    slim = turns.select("turn_id", "source", "tier", "started_at", F.when(total_tokens() > 0, total_tokens()).alias("t"), "wall_ms")
    mine = F.floor(F.col("started_at") / window_ms)
    rows = slim.withColumn("block", F.explode(F.array(mine, mine + 1))).withColumn("own", F.col("block") == mine)
    rows = rows.repartition("source", "tier", "block").sortWithinPartitions("source", "tier", "block", "started_at")
    return rows.mapInArrow(run, f"turn_id {turns.schema['turn_id'].dataType.simpleString()}, base_tokens long, base_wall long")


def flag_reasons(baseline: bool = True) -> Column:
    """K-8, or K-9 without a baseline: slugs in a fixed order."""
    slug = lambda name, c: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    found = [
        slug("outcome_not_ok", F.col("outcome") != "ok"), slug("critic_fail", F.col("critic_fails") > 0), slug("tool_error_rate", (F.col("calls") > 0) & (F.col("failed") > ERROR_RATE * F.col("calls"))),
        *([slug("slow", F.col("wall_ms") > F.col("base_wall"))] if baseline else []), slug("midturn_compaction", F.col("compactions") > 0), slug("edit_revert", F.col("reverts") > 0),
        slug("user_interrupt", F.col("interrupts") > 0), slug("low_kpi", F.col("kpi_score") < LOW_KPI),
    ]
    return F.array_compact(F.array(*found))


def score_unscored(turns: DataFrame, events: DataFrame, since: int, window_ms: int = WEEK, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """K-10 on a table that holds scores: turns since then without one get it, with their components as JSON and their flag; the others stay as they are. Baselines come from all turns."""
    due = (F.col("started_at") >= since) & F.col("kpi_score").isNull()
    new = score_turns(turns, events, window_ms, weights, turns.filter(due)).select("turn_id", F.struct(F.col("kpi_score").alias("s"), F.to_json(F.struct(*COMPONENTS)).alias("c"), F.col("flagged").alias("f")).alias("__n"))
    rows = turns.join(new, "turn_id", "left")
    pick = lambda c, x: F.when(due, F.col(f"__n.{x}")).otherwise(F.col(c) if c in turns.columns else F.lit(None)).alias(c)
    rest = [c for c in turns.columns if c not in ("kpi_score", "kpi_components", "flagged")]
    return rows.select(*rest, pick("kpi_score", "s"), pick("kpi_components", "c"), pick("flagged", "f"))


def score_turns(turns: DataFrame, events: DataFrame, window_ms: int = WEEK, weights: dict[str, float] = WEIGHTS, due: DataFrame | None = None) -> DataFrame:
    """K-10: one shuffle of events by turn, baselines joined by source and tier (Spark sends the smaller side round if it is small); adds components, kpi_score, reasons and flagged."""
    base = trailing_baseline(turns, window_ms, due)
    full = with_facts(turns, events)
    full = full.join(base.withColumnRenamed("source", "__s").withColumnRenamed("tier", "__t"), (F.col("source") == F.col("__s")) & F.col("tier").eqNullSafe(F.col("__t")), "left").drop("__s", "__t")
    parts = dict(zip(COMPONENTS, (completion(), tool_reliability(), efficiency(), focus(), context_health(), autonomy())))
    out = full.withColumns(parts).withColumn("kpi_score", composite(weights)).withColumn("reasons", flag_reasons())
    return out.withColumn("flagged", (F.size("reasons") > 0).cast("int"))
