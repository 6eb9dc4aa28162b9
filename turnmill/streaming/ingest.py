"""Structured Streaming twins of the ingest operators (R)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import keyed, scan
from ..sources import growing
from ..sources.logs import KINDS, split_kinds


def stream_log(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """R-1 and S-3: reads what came since the last run, also in files that grow, and hands each batch of (at, value, kind) to sink; at orders lines within a file and over runs."""
    rows = _lines(growing.stream(spark, path, pattern)).withColumn("kind", F.when(F.try_parse_json("value").isNotNull(), F.get_json_object("value", "$._kind"))).filter("kind is not null")
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _lines(found: DataFrame) -> DataFrame:
    return found.filter(F.trim("value") != "").select(F.concat_ws(":", "file", F.lpad(F.col("start").cast("string"), 20, "0")).alias("at"), "value")


def read_new(spark: SparkSession, path: str, cursor: DataFrame | None = None, pattern: str = "*.jsonl", chunk: int = growing.CHUNK) -> tuple[DataFrame, DataFrame]:
    """S-3 for files that grow: the lines (at, value; at orders them within a file and over runs) that became complete since the cursor (file, offset in bytes) was taken, and the new cursor. A last line without its end waits for the rest. A file that hasn't grown isn't opened, one that became shorter is read anew.

    The cursor has a row for each file, and so has the driver, which lists them; a file's new bytes are read in ranges of chunk bytes, each by a task."""
    before = {} if cursor is None else {r.file: r.offset for r in cursor.select("file", "offset").collect()}
    found, now = growing.read(spark, path, before, pattern, chunk)
    return _lines(found), spark.createDataFrame(sorted(now.items()), "file string, offset long")


def ingest(lines: DataFrame, held: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """R-1: the tables (turn as a state, event, text, probe, host_metrics, tuning_change, judgment, decision) after new lines, each by its own rule of U-1 to U-8. What came before and is in the lines again changes nothing."""
    kinds = split_kinds(lines.withColumnRenamed("at", "file").withColumn("kind", F.when(F.try_parse_json("value").isNotNull(), F.get_json_object("value", "$._kind"))))
    out = {}
    order = {"event": (keyed.first, ["turn_id", "ts", "kind", "name", "dedupe_id"]), "text": (keyed.latest, ["turn_id", "kind", "seq"]), "probe": (keyed.first, ["host", "kind", "ts"]), "host_metrics": (keyed.first, ["host", "ts"]), "tuning_change": (keyed.latest, ["change_id"]), "judgment": (keyed.latest, ["turn_id"]), "decision": (keyed.latest, ["turn_id", "domain"])}
    for kind, (fold, keys) in order.items():
        rows = kinds[kind].withColumnRenamed("file", "at")
        if kind == "event":
            rows = rows.withColumn("name", F.coalesce("name", F.lit(""))).withColumn("dedupe_id", F.coalesce(F.get_json_object("payload", "$.tool_use_id"), F.lit("")))
        if kind in held:
            rows = held[kind].unionByName(rows)
        out[kind] = fold(rows, keys, ["at", *(c for c in rows.columns if c not in (*keys, "at"))])
    state = keyed.fold_state(kinds["turn"].withColumnRenamed("file", "seq"))
    out["turn"] = keyed.merge_states(held["turn"], state) if "turn" in held else state
    return out


def events_of(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'event'").select(F.from_json("value", KINDS["event"]).alias("x")).select("x.*")


def dedup_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """R-2: the first of each key within the watermark; keyed.dedup_events is the truth beyond it."""
    rows = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    rows = rows.withColumn("__name", F.coalesce("name", F.lit(""))).withColumn("__id", F.coalesce(F.get_json_object("payload", "$.tool_use_id"), F.lit("")))
    return rows.dropDuplicatesWithinWatermark(["turn_id", "ts", "kind", "__name", "__id"]).drop("__name", "__id", "at")


def day_counts(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """R-6: decisions by UTC day, in tumbling windows."""
    rows = log.withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.count_if(F.col("tier").isNotNull() & (F.col("tier") != "none")).alias("ceremonial"))


TURN = "session_id string, turn_no long, started_at long, ended_at long, wall_ms long, outcome string, tools long"


def hook_sessions(hooks: DataFrame) -> DataFrame:
    """R-3 in batch: turns of each session's hook events (session_id, ts, hook). A prompt opens a turn and closes what is open, Stop closes with ok, StopFailure with error; other events without an open turn open one; unknown hooks are left out. A session may have any number of events: they are numbered over blocks."""
    known = ["UserPromptSubmit", "PreToolUse", "PostToolUse", "PostToolUseFailure", "Stop", "StopFailure"]
    key, order = ["session_id"], ["ts", "seq"]
    rows = hooks.filter(F.col("hook").isin(known)).select("session_id", "ts", "seq", "hook").withColumn("__stop", F.col("hook").isin("Stop", "StopFailure"))
    rows = scan.scan(scan.cut(rows, key, order), key, order, __before=scan.before(F.col("__stop")))
    opens = (F.col("hook") == "UserPromptSubmit") | F.coalesce("__before", F.lit(True))
    rows = scan.scan(rows.withColumn("__opens", opens.cast("long")), key, order, turn_no=scan.total(F.col("__opens")))
    end = F.max(F.when(F.col("__stop"), F.col("ts")))
    return rows.groupBy("session_id", "turn_no").agg(
        F.min("ts").alias("started_at"), end.alias("ended_at"), F.when(end.isNotNull(), F.greatest(F.lit(0), end - F.min("ts"))).alias("wall_ms"), F.max(F.when(F.col("__stop"), F.when(F.col("hook") == "Stop", "ok").otherwise("error"))).alias("outcome"),
        F.count_if(F.col("hook").isin("PostToolUse", "PostToolUseFailure")).alias("tools"),
    )


def hook_tool_calls(hooks: DataFrame) -> DataFrame:
    """R-3, the tool calls: session_id, ts, name, ok, error, tool_use_id, duration_ms of each PostToolUse and PostToolUseFailure. The duration that the hook itself tells wins; else it runs from the call's last PreToolUse, if there was one since the result before. hooks: session_id, ts, seq, hook, tool_name, tool_use_id, duration_ms, error."""
    post = F.col("hook").isin("PostToolUse", "PostToolUseFailure")
    w = Window.partitionBy("session_id", "tool_use_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = hooks.filter(post | (F.col("hook") == "PreToolUse"))
    began = F.max(F.when(F.col("hook") == "PreToolUse", F.struct("ts", "seq"))).over(w)
    ended = F.max(F.when(post, F.struct("ts", "seq"))).over(w)
    rows = rows.withColumn("__b", began).withColumn("__e", ended).filter(post)
    paired = F.when(F.col("tool_use_id").isNotNull() & F.col("__b").isNotNull() & (F.col("__e").isNull() | (F.col("__b") > F.col("__e"))), F.col("ts") - F.col("__b")["ts"])
    failed = F.col("hook") == "PostToolUseFailure"
    return rows.select("session_id", "ts", F.coalesce("tool_name", F.lit("unknown")).alias("name"), (~failed).cast("int").alias("ok"), F.when(failed, F.col("error")).alias("error"), "tool_use_id", F.coalesce("duration_ms", paired).alias("duration_ms"))


def stream_hook_sessions(hooks: DataFrame, idle: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """R-3 as a stateful stream: the open turn of each session is the state; a turn is told when it closes, or when another opens. A session without events for the idle time, by the stream's own clock (events at most delay late), is forgotten, its open turn told without an end."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    known = ["UserPromptSubmit", "PreToolUse", "PostToolUse", "PostToolUseFailure", "Stop", "StopFailure"]
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    names = [c.split()[0] for c in TURN.split(", ")]

    def step(key: tuple, parts, state: GroupState):
        no, started, last, tools, open_ = state.get if state.exists else (0, 0, 0, 0, False)
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], no, started, None, None, None, tools)] if open_ else [], columns=names)
            return
        now = pd.concat(list(parts)).sort_values(["ts", "seq"], kind="stable")  # a session's part of one trigger, whose size the source bounds
        for hook, ts in zip(now["hook"].tolist(), now["ts"].tolist()):
            last = max(last, ts)
            if hook not in known:
                continue
            if hook == "UserPromptSubmit" or not open_:
                if open_:
                    out.append((key[0], no, started, None, None, None, tools))
                no, started, tools, open_ = no + 1, ts, 0, True
            tools += hook in ("PostToolUse", "PostToolUseFailure")
            if hook in ("Stop", "StopFailure"):
                out.append((key[0], no, started, ts, max(0, ts - started), "ok" if hook == "Stop" else "error", tools))
                open_ = False
        state.update((no, started, last, tools, open_))
        state.setTimeoutTimestamp(last + wait)
        yield pd.DataFrame(out, columns=names)

    timed = hooks.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    return timed.groupBy("session_id").applyInPandasWithState(step, TURN, "no long, started long, last long, tools long, open boolean", "append", GroupStateTimeout.EventTimeTimeout)
