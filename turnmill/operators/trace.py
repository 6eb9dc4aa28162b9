"""Attribution of transcript rows to turns, tool calls and batches (J-5, J-6, W-2 to W-8, W-13, A-14 to A-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import done, folder, lean
from . import scan

GAP = 15 * 60_000


def turn_windows(turns: DataFrame) -> DataFrame:
    """W-2: hi is the end, else the next start in the session, else null."""
    w = Window.partitionBy("session_id").orderBy("started_at", "turn_id")
    return turns.select("session_id", "turn_id", F.col("started_at").alias("lo"), F.coalesce("ended_at", F.lead("started_at").over(w)).alias("hi"))


def attribute_asof(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """J-5: each row's latest window that begins at or before it, unless that one has ended by then. rows: session_id, ts and more. A union and a running last over blocks, so that a session may have any number of rows; not a range join."""
    rest = [c for c in rows.columns if c not in ("session_id", "ts")]
    a = windows.select("session_id", F.col("lo").alias("ts"), F.lit(0).alias("__o"), F.struct("turn_id", "hi").alias("__w"), F.lit(None).cast(rows.select(F.struct(*rest)).schema[0].dataType).alias("__r"))
    b = rows.select("session_id", "ts", F.lit(1).alias("__o"), F.lit(None).cast(a.schema["__w"].dataType).alias("__w"), F.struct(*rest).alias("__r"))
    key, order = ["session_id"], ["ts", "__o", "__w"]
    found = scan.scan(scan.cut(a.unionByName(b), key, order), key, order, __at=scan.latest(F.col("__w"))).filter("__o = 1")
    inside = F.col("__at").isNotNull() & (F.col("__at")["hi"].isNull() | (F.col("ts") < F.col("__at")["hi"]))
    return found.select("session_id", "ts", *(F.col("__r")[c].alias(c) for c in rest), F.when(inside, F.col("__at")["turn_id"]).alias("turn_id"))


def freeze_open_windows(rows: DataFrame, windows: DataFrame, cap: int = GAP) -> DataFrame:
    """W-3: a window without an end closes a millisecond after the last row before its first gap."""
    hit = attribute_asof(rows.select("session_id", "ts", F.lit(0).alias("x")), windows).filter("turn_id is not null")
    before = F.lag("ts").over(Window.partitionBy("session_id", "turn_id").orderBy("ts"))
    ends = hit.withColumn("__b", before).filter(F.col("ts") - F.col("__b") > cap).groupBy("turn_id").agg((F.min("__b") + 1).alias("__end"))
    return windows.join(ends, "turn_id", "left").select("session_id", "turn_id", "lo", F.coalesce("hi", "__end").alias("hi"))


def usage_groups(rows: DataFrame, cap: int = GAP) -> DataFrame:
    """W-4: runs of rows with one message id. rows: session_id, line, ts, message_id (null for rows that end a run). An id that comes back later is left out.

    A row closes what is open if it has no id or is the first of its id; so the rows of an id's first run are those with the fewest closers before them. Sessions and ids may have any number of rows: closers are counted over blocks, runs are partial sums."""
    key, order = ["session_id"], ["line"]
    rows = scan.cut(rows, key, order)
    firsts = rows.filter("message_id is not null").groupBy("session_id", "message_id").agg(F.min("line").alias("line"))
    firsts = firsts.select(F.col("session_id").alias("__s"), F.col("line").alias("__l"), F.lit(True).alias("__first"))
    rows = rows.join(firsts, F.col("session_id").eqNullSafe(F.col("__s")) & (F.col("line") == F.col("__l")), "left")  # by line, which one row of a session has
    closer = F.col("message_id").isNull() | F.col("__first").isNotNull()
    rows = scan.scan(rows, key, order, __prev=scan.before(F.col("ts")), __cc=scan.total(closer.cast("long"))).filter("message_id is not null")
    runs = rows.groupBy("session_id", "message_id", "__cc").agg(F.min("line").alias("line"), F.min_by(F.struct(F.col("__prev").alias("v")), "line").alias("start"), F.max_by("ts", "line").alias("ended_at"), F.count("*").alias("n_rows"))
    spans = runs.groupBy("session_id", "message_id").agg(F.min_by(F.struct("line", "start", "ended_at", "n_rows"), "__cc").alias("r")).select("session_id", "message_id", "r.line", F.col("r.start.v").alias("__start"), "r.ended_at", "r.n_rows")
    ms = F.col("ended_at") - F.col("__start")
    return spans.withColumn("model_ms", F.when(ms.between(0, cap), ms)).drop("__start")


def edit_episodes(edits: DataFrame) -> DataFrame:
    """W-5: (session_id, path, episodes); a path edited again after another is reworked from two episodes on."""
    before = F.lag("path").over(Window.partitionBy("session_id").orderBy("ts", "path"))
    return edits.withColumn("__new", (~F.col("path").eqNullSafe(before)).cast("long")).groupBy("session_id", "path").agg(F.sum("__new").alias("episodes"))


def hash_changes(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """W-7: changes between consecutive values that aren't empty."""
    rows = events.filter(F.col(value).isNotNull() & (F.col(value) != "")).select(key, value, *order)
    rows = scan.scan(scan.cut(rows, [key], order), [key], order, __b=scan.before(F.col(value)))
    return rows.groupBy(key).agg(F.count_if(F.col("__b").isNotNull() & (F.col("__b") != F.col(value))).alias("changes"))


def match_results(uses: DataFrame, results: DataFrame) -> DataFrame:
    """J-6: each use with the last result of its id, or none."""
    last = results.filter("tool_use_id is not null").groupBy("session_id", "tool_use_id").agg(F.max_by(F.struct("is_error", "result"), "line").alias("__r"))
    out = uses.join(last, ["session_id", "tool_use_id"], "left")
    return out.withColumn("matched", F.col("__r").isNotNull()).withColumn("is_error", F.col("__r.is_error")).withColumn("result", F.col("__r.result")).drop("__r")


def batch_sizes(calls: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A-14: how many messages have how many calls."""
    keys = keys or []
    return calls.groupBy(*keys, "message_id").agg(F.count("*").alias("size")).groupBy(*keys, "size").agg(F.count("*").alias("messages"))


def batch_stats(calls: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A-14: messages with one and with several calls, calls that travel with others, and their share; in one row, or by keys."""
    many = F.col("size") > 1
    return batch_sizes(calls, keys).groupBy(*(keys or [])).agg(
        F.coalesce(F.sum(F.when(~many, F.col("messages"))), F.lit(0)).alias("single"), F.coalesce(F.sum(F.when(many, F.col("messages"))), F.lit(0)).alias("multi"), F.coalesce(F.sum(F.when(many, F.col("messages") * F.col("size"))), F.lit(0)).alias("batched_calls"),
        F.try_divide(F.sum(F.when(many, F.col("messages") * F.col("size")).otherwise(0)), F.sum(F.col("messages") * F.col("size"))).alias("batch_rate"),
    )


def failure_stats(calls: DataFrame) -> DataFrame:
    """A-16: per tool, and in all (name null), calls, errors and calls without a result, which are no errors."""
    sums = [F.count("*").alias("total"), F.count_if(F.col("matched") & (F.col("is_error") == 1)).alias("errored"), F.count_if(~F.col("matched")).alias("unmatched"), F.grouping("name").alias("overall")]
    return calls.rollup("name").agg(*sums).withColumn("error_rate", F.try_divide("errored", "total")).withColumn("unmatched_rate", F.try_divide("unmatched", "total"))


def repeated_targets(calls: DataFrame, k: int = 20) -> DataFrame:
    """A-15: the most repeated (tool, target), counted over all sessions."""
    return calls.filter("target is not null").groupBy("name", "target").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "name", "target").limit(k)


def prefetch_share(calls: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A-15: calls, those that only read (prefetchable, C-20), and their share."""
    n = F.count_if(F.col("prefetchable"))
    return calls.groupBy(*(keys or [])).agg(F.count("*").alias("calls"), n.alias("prefetchable_calls"), F.try_divide(n, F.count("*")).alias("prefetchable_share"))


#: Letters of a token; from so many on it counts in the strict and in the loose reading.
TOKEN, STRICT, LOOSE = "[A-Za-z0-9_./-]{4,}", 4, 8


def _paired(calls: DataFrame, use: Column, **sums: Column) -> DataFrame:
    """A row a message: how many of its calls are of use (size), the sums, and, if it comes from a row with one call, whether it has such a message before it in its session (pair) and uses no token of that one's result (strict, loose). The messages are written as they are, and then in blocks, so that what is shuffled for either isn't there at once."""
    one = F.struct("line", "input", "result")
    alone = F.when(use & (F.col("row_batch_size") == 1), one) if "row_batch_size" in calls.columns else F.when(use, one)
    rows = calls.groupBy("session_id", "message_id").agg(F.count_if(use).alias("size"), F.min(alone).alias("__c"), *(c.alias(n) for n, c in sums.items()))
    if "row_batch_size" not in calls.columns:
        rows = rows.withColumn("__c", F.when(F.col("size") == 1, F.col("__c")))
    key, order, path = ["session_id"], ["__line", "message_id"], folder(calls.sparkSession, "messages")
    said = F.when(F.col("__c").isNotNull(), F.struct("__c.input", "__c.result"))
    messages = lean(rows.withColumn("__line", F.col("__c.line")).withColumn("__c", said), path)  # what was shuffled for them goes before blocks are cut
    rows = scan.cut(messages, key, order)
    done(calls.sparkSession, path)
    result = F.when(F.col("__c").isNotNull(), F.struct(F.coalesce("__c.result", F.lit("")).alias("r")))
    rows = scan.scan(rows, key, order, __b=scan.latest_before(result)).withColumn("pair", F.col("__c").isNotNull() & F.col("__b").isNotNull())
    tokens = lambda c, least: F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({TOKEN})")), lambda t: F.length(t) >= least)
    free = lambda least: F.col("pair") & ~F.arrays_overlap(tokens(F.col("__b")["r"], least), tokens(F.col("__c.input"), least))
    return rows.withColumn("strict", free(STRICT)).withColumn("loose", free(LOOSE))


def missed_batches(calls: DataFrame) -> DataFrame:
    """W-6: messages that come from a row with one call, in their order in the session, each with the next: how many of these calls use no token of the result before, by tokens of 4 characters or more (strict) or 8 or more (loose). An input without such a token uses none.

    calls: session_id, line, message_id, input (its JSON with sorted keys), result, and row_batch_size where a row's calls aren't all of its message's. A session may have any number of messages: the result before is scanned over blocks."""
    rows = _paired(calls, F.lit(True)).filter("pair")
    return rows.groupBy("session_id").agg(F.count("*").alias("pairs"), F.count_if("strict").alias("strict_independent"), F.count_if("loose").alias("loose_independent"))


def corpus_tool_trace(calls: DataFrame, include_sidechains: bool = False) -> DataFrame:
    """A-17: A-14 to A-16 and W-6 for each session and, with a null session, for the corpus. calls: session_id, line, message_id, row_batch_size, name, input, result, matched, is_error, prefetchable, sidechain; bad rows (`issue` not null) and calls of side chains are counted, not traced.

    Calls are read once, into a row a message; what sessions and the corpus have are sums of these."""
    kept = F.col("issue").isNull() if "issue" in calls.columns else F.lit(True)
    use = kept if include_sidechains else kept & ~F.col("sidechain")
    counted = {
        "prefetchable": use & F.col("prefetchable"), "unmatched": use & ~F.col("matched"), "errored": use & F.col("matched") & (F.col("is_error") == 1), "parse_issues": ~kept, "sidechain_excluded": kept & ~use,
    }
    rows = _paired(calls, use, **{n: F.count_if(c) for n, c in counted.items()})
    size, zero = F.col("size"), F.lit(0).cast("long")
    out = rows.rollup("session_id").agg(
        F.sum("size").alias("calls"), *(F.sum(n).alias(n) for n in counted), F.count_if(size == 1).alias("single"), F.count_if(size > 1).alias("multi"), F.sum(F.when(size > 1, size).otherwise(zero)).alias("batched_calls"),
        F.count_if("pair").alias("pairs"), F.count_if("strict").alias("strict_missed"), F.count_if("loose").alias("loose_missed"),
    )
    return out.withColumn("batch_rate", F.try_divide("batched_calls", "calls")).withColumn("prefetchable_share", F.try_divide("prefetchable", "calls")).withColumn("error_rate", F.try_divide("errored", "calls"))


def attribute_usage(groups: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """A-18: by turn: requests, sums of tokens, the last model, the sum of plausible model times (null if there was none), and the outcome that the first row of evidence shows.

    groups: turn_id, line, model, model_ms, prompt_tokens, completion_tokens, cached_tokens of each request; evidence: turn_id, line, api_error, error, interrupted of rows that show one. Nothing shows ok."""
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens") if c in groups.columns]
    out = groups.filter("turn_id is not null").groupBy("turn_id").agg(F.count("*").alias("requests"), *sums, F.max_by("model", "line").alias("model"), F.sum("model_ms").alias("model_ms"))
    if evidence is None:
        return out.withColumn("outcome", F.lit(None).cast("string")).withColumn("error_class", F.lit(None).cast("string"))
    shown = evidence.filter("turn_id is not null and (api_error or interrupted)").groupBy("turn_id").agg(F.min_by(F.struct("api_error", "error"), "line").alias("__e"))
    outcome = F.when(F.col("__e.api_error"), "error").when(F.col("__e").isNotNull(), "interrupted")
    return out.join(shown, "turn_id", "full").withColumn("outcome", outcome).withColumn("error_class", F.when(F.col("__e.api_error"), F.col("__e.error"))).drop("__e").fillna(0, ["requests"])


TOKENS = ["prompt_tokens", "completion_tokens", "cached_tokens", "requests"]


def backfill(turns: DataFrame, attribution: DataFrame) -> DataFrame:
    """U-21: only what is null is filled, so that a rerun changes nothing: the tokens together, where prompt_tokens is null and there were requests; the model; model_ms, which marks the turn as estimated; the outcome, with its error class. Marks of what was filled follow (filled_tokens, filled_model, filled_model_ms, filled_outcome)."""
    found = attribution.select("turn_id", F.struct(*(c for c in attribution.columns if c != "turn_id")).alias("__a"))
    rows = turns.join(found, "turn_id", "left")
    a = lambda c: F.col(f"__a.{c}")
    marks = {
        "filled_tokens": F.col("prompt_tokens").isNull() & (F.coalesce(a("requests"), F.lit(0)) > 0), "filled_model": F.col("model").isNull() & a("model").isNotNull(),
        "filled_model_ms": F.col("model_ms").isNull() & a("model_ms").isNotNull(), "filled_outcome": F.col("outcome").isNull() & a("outcome").isNotNull(),
    }
    rows = rows.withColumns(marks)
    new = {c: F.when(F.col("filled_tokens"), a(c)).otherwise(F.col(c)) for c in TOKENS if c in turns.columns}
    new |= {"model": F.when(F.col("filled_model"), a("model")).otherwise(F.col("model")), "model_ms": F.when(F.col("filled_model_ms"), a("model_ms")).otherwise(F.col("model_ms")), "outcome": F.when(F.col("filled_outcome"), a("outcome")).otherwise(F.col("outcome"))}
    if "estimated" in turns.columns:
        new["estimated"] = F.when(F.col("filled_model_ms"), 1).otherwise(F.col("estimated"))
    if "error_class" in turns.columns:
        new["error_class"] = F.when(F.col("filled_outcome"), F.coalesce("error_class", a("error_class"))).otherwise(F.col("error_class"))
    return rows.withColumns(new).drop("__a")


def backfill_report(filled: DataFrame, attribution: DataFrame) -> DataFrame:
    """U-21: how many turns have evidence, and how many had something filled, by what."""
    seen = filled.join(attribution.select("turn_id"), "turn_id", "left_semi").agg(F.count("*").alias("turns_scanned"))
    return seen.crossJoin(filled.agg(*(F.count_if(f"filled_{c}").alias(f"updated_{c}") for c in ("tokens", "model", "model_ms", "outcome"))))  # one row with one row
