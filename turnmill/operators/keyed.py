"""Keyed writes as folds over rows with a sequence number: dedup, upsert, merge, retention (U).

Each is "rows in, state out", so that a rerun over the same rows changes nothing. Parquet has no MERGE; a job unions what it holds
with what came, folds, and overwrites the partitions concerned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import scalars


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """U-3, U-4, U-5, U-8: the whole last row of each key, nulls included; a partial aggregation, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return top.select(*keys, *(F.col("__x")[c].alias(c) for c in rest)).select(df.columns)


def first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """U-2, U-6, U-7: the whole first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return top.select(*keys, *(F.col("__x")[c].alias(c) for c in rest)).select(df.columns)


def dedup_events(events: DataFrame, order: list[str]) -> DataFrame:
    """U-2: a null name is an empty one, a missing id too."""
    keyed = events.withColumn("__name", F.coalesce("name", F.lit(""))).withColumn("__id", F.coalesce("dedupe_id", F.lit("")))
    return first(keyed, ["turn_id", "ts", "kind", "__name", "__id"], order).drop("__name", "__id")


DEFAULTS = {"is_subagent": 0, "estimated": 0, "flagged": 0, "judged": 0}


def fold_turns(records: DataFrame, key: str = "turn_id", seq: str = "seq", always: tuple[str, ...] = ("tier",)) -> DataFrame:
    """U-1: of each column the last value that a record carries; columns in always take the last record's, null or not."""
    cols = [c for c in records.columns if c not in (key, seq)]
    aggs = []
    for c in cols:
        if c in always:
            value = F.max_by(F.struct(c), seq)[c]
        else:
            value = F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq)))
        aggs.append((F.coalesce(value, F.lit(DEFAULTS[c])) if c in DEFAULTS else value).alias(c))
    return records.groupBy(key).agg(*aggs)


def fold_state(records: DataFrame, key: str = "turn_id", seq: str = "seq") -> DataFrame:
    """U-1 and R-5 as a state: of each column the last value carried with its place. States of any parts of the records, in any order and more than once, merge into that of all of them."""
    cols = [c for c in records.columns if c not in (key, seq)]
    return records.groupBy(key).agg(F.max(seq).alias("__seq"), *(F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(seq).alias("at"), F.col(c).alias("value")))).alias(c) for c in cols))


def merge_states(*states: DataFrame, key: str = "turn_id") -> DataFrame:
    """R-5."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), states)
    return every.groupBy(key).agg(*(F.max(c).alias(c) for c in every.columns if c != key))


def settled(state: DataFrame, key: str = "turn_id") -> DataFrame:
    """The values of a state; flags that no record carried are 0."""
    cols = [c for c in state.columns if c not in (key, "__seq")]
    return state.select(key, *((F.coalesce(F.col(c)["value"], F.lit(DEFAULTS[c])) if c in DEFAULTS else F.col(c)["value"]).alias(c) for c in cols))


def replace_texts(texts: DataFrame, now: int) -> DataFrame:
    """U-3: the last of each (turn, kind, seq) that hasn't expired."""
    return latest(texts.filter(F.col("expires_at") > now), ["turn_id", "kind", "seq"], ["at"])


def expire_texts(texts: DataFrame, now: int) -> DataFrame:
    """U-14."""
    return texts.filter(F.col("expires_at") > now)


def expired(texts: DataFrame, now: int) -> DataFrame:
    """U-14: how many go and how many stay."""
    gone = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return texts.agg(F.count_if(gone).alias("expired"), F.count_if(~gone).alias("left"))


def replace_judgments(judgments: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U-4: the last judgment of each turn, and the turns with those marked as judged."""
    last = latest(judgments, ["turn_id"], ["created_at", "seq"])
    return last, mark_judged(turns, last)


def mark_judged(turns: DataFrame, judgments: DataFrame) -> DataFrame:
    """U-4."""
    known = judgments.select("turn_id", F.lit(1).alias("__j")).dropDuplicates(["turn_id"])
    return turns.join(known, "turn_id", "left").withColumn("judged", F.coalesce("__j", "judged")).drop("__j")


def merge_append_only(local: DataFrame, peers: list[DataFrame], keys: list[str]) -> DataFrame:
    """U-11: rows of peers whose key isn't held yet; columns only a peer has are left out, those only we have are null."""
    shaped = [p.select(*(F.col(c) if c in p.columns else F.lit(None).cast(local.schema[c].dataType).alias(c) for c in local.columns)).withColumn("__side", F.lit(i + 1)) for i, p in enumerate(peers) if set(keys) <= set(p.columns)]
    every = reduce(DataFrame.unionByName, shaped, local.withColumn("__side", F.lit(0)))
    return first(every, keys, ["__side"]).drop("__side")


def merge_mutable(local: DataFrame, peers: list[DataFrame], keys: list[str], recency: str) -> DataFrame:
    """U-12: a peer's row replaces ours only if strictly newer; without the recency column as U-11."""
    if recency not in local.columns or any(recency not in p.columns or not set(keys) <= set(p.columns) for p in peers):
        return merge_append_only(local, peers, keys)
    every = local.withColumn("__side", F.lit(0))
    for i, p in enumerate(peers):
        every = every.unionByName(p.withColumn("__side", F.lit(-1 - i)), allowMissingColumns=True)
    return latest(every, keys, [recency, "__side"]).drop("__side").select(local.columns)


def upsert_index(current: DataFrame, scanned: DataFrame, key: str, sha: str = "content_sha") -> DataFrame:
    """U-19: a row of unchanged content stays as it is, another is replaced; rows that weren't scanned stay."""
    old = current.select(F.col(key), F.struct(*current.columns).alias("__old"))
    new = scanned.select(F.col(key), F.struct(*current.columns).alias("__new"))
    both = old.join(new, key, "full")
    keep = F.col("__new").isNull() | F.coalesce(F.col("__old")[sha] == F.col("__new")[sha], F.lit(False))
    return both.select(F.when(keep, F.col("__old")).otherwise(F.col("__new")).alias("__x")).select("__x.*")


def fold_heartbeats(beats: DataFrame) -> DataFrame:
    """U-15: goal and task stick when left out, started_at is the first beat, the rest the last."""
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    return beats.groupBy("session_id", "host").agg(last("goal"), last("task"), F.max_by("status", "ts").alias("status"), F.min("ts").alias("started_at"), F.max("ts").alias("heartbeat_at"))


def backfill_tier(turns: DataFrame, tier: Column) -> DataFrame:
    """U-20: only where it is null."""
    return turns.withColumn("tier", F.coalesce("tier", tier))


def backfill_tier_report(turns: DataFrame, tier: Column) -> DataFrame:
    """U-20, the dry run: turns without a tier, those that get one, those that nothing maps."""
    none = F.col("tier").isNull()
    return turns.agg(F.count_if(none).alias("scanned"), F.count_if(none & tier.isNotNull()).alias("updated"), F.count_if(none & tier.isNull()).alias("unmapped"))


def fold_todos(filings: DataFrame) -> DataFrame:
    """U-16: the current row of each (source, key) after filings and dones in order of ts; a filing after a done reopens with new text, one of an open todo changes nothing. A filing without a key is a todo of its own. Id, scope and repo are the first filing's; a global todo has no repo.

    filings: source, key, ts, op (file or done), text, and, where they have them, todo_id, scope, repo. The state follows from the last done before the last filing: nothing is carried from row to row."""
    given = filings.columns
    extra = [c for c in ("todo_id", "scope", "repo") if c in given]
    if "scope" in given:
        filings = filings.filter(F.col("scope").isin("local", "global") | (F.col("op") == "done"))
    lone = filings.filter("key is null and op = 'file'")
    by = Window.partitionBy("source", "key").orderBy("ts")
    rows = filings.filter("key is not null").withColumn("__before", F.last(F.col("op"), True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    opens = (F.col("op") == "file") & (F.col("__before").isNull() | (F.col("__before") == "done"))
    rows = rows.withColumn("__open", opens)
    first = [F.min_by(F.when(F.col("op") == "file", F.col(c)), F.when(F.col("op") == "file", F.col("ts"))).alias(c) for c in extra]
    filed, done = F.when(F.col("__open"), F.col("ts")), F.when(F.col("op") == "done", F.col("ts"))
    last = rows.groupBy("source", "key").agg(F.min(F.when(F.col("op") == "file", F.col("ts"))).alias("created_at"), F.max_by(F.when(F.col("__open"), F.col("text")), filed).alias("text"), F.max(filed).alias("opened_at"), F.max(done).alias("__done"), *first).filter("created_at is not null")
    closed = F.coalesce(F.col("__done") > F.col("opened_at"), F.lit(False))
    out = last.withColumn("status", F.when(closed, "done").otherwise("open")).withColumn("done_at", F.when(closed, F.col("__done"))).withColumn("updated_at", F.when(closed, F.col("__done")).otherwise(F.col("opened_at"))).drop("__done")
    alone = lone.select("source", "key", F.col("ts").alias("created_at"), "text", F.col("ts").alias("opened_at"), *extra, F.lit("open").alias("status"), F.lit(None).cast("long").alias("done_at"), F.col("ts").alias("updated_at"))
    out = out.unionByName(alone)
    return out.withColumn("repo", F.when(F.col("scope") != "global", F.col("repo"))) if {"scope", "repo"} <= set(extra) else out


def in_order(rows: DataFrame, keys: list[str], order: list[str], step, schema: str) -> DataFrame:
    """rows, each key's in order, through step(key, state, row) -> (state, more columns); a key's rows are one run of a sorted partition, of which no more than a batch is in memory."""
    import pandas as pd

    def run(parts):
        now, state = None, None
        for part in parts:
            more = []
            for row in part.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != now:
                    now, state = key, None
                state, said = step(state, row)
                more.append(said)
            names = [c.split()[0] for c in schema.split(", ")]
            yield pd.concat([part, pd.DataFrame(more, columns=names, index=part.index)], axis=1)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{shape}, {schema}")


def chain_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """U-10: a hash chain by host in the order of created_at and seq: prev_hash, null for the first, and row_hash over columns and prev_hash. A row's bytes are made by scalars.members, as verify_chain makes them; what depends on the row before is only
    where prev_hash stands among them. The chain is sequential within a host by its nature; hosts run in parallel, null being one, and of a host only the last hash is held. All columns pass through as they are."""
    import hashlib

    import pyarrow as pa

    rows = rows.drop("prev_hash", "row_hash")
    said = scalars.members(rows, [c for c in columns if c != "prev_hash"])
    before, after = [m for c, m in said if c < "prev_hash"], [m for c, m in said if c > "prev_hash"]
    head, tail = (next(n for n in (f"{'_' * k}{name}" for k in range(1, 99)) if n not in rows.columns) for name in ("head", "tail"))
    ready = rows.withColumn(head, F.concat(F.lit("{"), *(F.concat(m, F.lit(",")) for m in before), F.lit('"prev_hash":'))).withColumn(tail, F.concat(*(F.concat(F.lit(","), m) for m in after), F.lit("}")))
    schema = StructType([*rows.schema.fields, StructField("prev_hash", StringType()), StructField("row_hash", StringType())])

    def run(batches):
        now, last = (), None
        for batch in batches:
            prev, own = [], []
            for host, a, b in zip(*(batch[c].to_pylist() for c in ("host", head, tail))):
                now, last = host, last if host == now else None
                prev.append(last)
                last = hashlib.sha256(f"{a}null{b}".encode() if last is None else f'{a}"{last}"{b}'.encode()).hexdigest()
                own.append(last)
            kept = batch.select([f.name for f in schema.fields[:-2]])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(prev, pa.string()), pa.array(own, pa.string())], [f.name for f in schema.fields])

    return ready.repartition("host").sortWithinPartitions("host", "created_at", "seq").mapInArrow(run, schema)


def verify_chain(rows: DataFrame, columns: list[str]) -> DataFrame:
    """W-9: host, seq, problem of each break, in the order in which rows were put in (seq): a prev_hash that isn't the row_hash stored before, or a row_hash that its own row doesn't give."""
    before = F.lag("row_hash").over(Window.partitionBy("host").orderBy("seq"))
    told = scalars.hashed_rows(rows.withColumn("__before", before), [*columns, "prev_hash"], "__told")
    why = F.array_compact(F.array(F.when(~F.col("prev_hash").eqNullSafe(F.col("__before")), F.lit("prev_hash mismatch")), F.when(~F.col("row_hash").eqNullSafe(F.col("__told")), F.lit("row_hash mismatch"))))
    return told.select("host", "seq", F.explode(why).alias("problem"))


def chain_verdict(rows: DataFrame, breaks: DataFrame) -> DataFrame:
    """W-9: how many rows were checked, how many breaks there are; silent without rows."""
    one = rows.agg(F.count("*").alias("checked"), F.count_distinct("host").alias("hosts")).crossJoin(breaks.agg(F.count("*").alias("breaks")))
    return one.withColumn("verdict", F.when(F.col("checked") == 0, "silent").when(F.col("breaks") > 0, "fail").otherwise("pass"))


#: The states of a plan.
PLAN_STATUSES = ["draft", "active", "done", "abandoned", "superseded"]
STAGE = "array<struct<name: string, expected_check: string, evidence: string, status: string>>"


def replay_plan_changes(changes: DataFrame) -> DataFrame:
    """U-17: compare-and-swap replay of each plan's changes in order of changed_at and seq. Each row gets accepted, problem, revision (the current one after it), and the plan as it then is (plan_status, goal_now, stages_now, superseded_by_now): an accepted row's is the snapshot of its revision, a conflict's revision is the actual one.

    changes: todo_id, changed_at, seq, op (add, amend, status), expected_revision, goal, stages, non_goals, status, superseded_by; null: not touched. An add makes revision 1, if there is no plan yet: it needs a goal, stages that each have a name and a check, non-goals (which may be empty), and is a draft or active. An amend must touch something and leave nothing of that blank; a status must be known.
    Both are accepted iff they expect the current revision. done needs evidence of every stage, superseded a pointer. closes_todo marks the change that makes a plan done."""

    def stages_fault(stages) -> str | None:
        if stages is None or not len(stages):
            return "stages must not be empty"
        return None if all(s["name"] and s["expected_check"] for s in stages) else "a stage lacks its name or check"

    def blank(x) -> bool:
        return not (x or "").strip()

    def judge(plan, row) -> tuple[str | None, dict | None]:
        touched = {k: row[k] for k in ("goal", "stages", "non_goals") if row[k] is not None}
        if "stages" in touched and touched["stages"] is not None:
            touched["stages"] = [{"name": s["name"], "expected_check": s["expected_check"], "evidence": s["evidence"], "status": s["status"] or "pending"} for s in touched["stages"]]
        if row["op"] == "add":
            if plan is not None:
                return "there is a plan already", None
            fault = "goal must not be empty" if blank(touched.get("goal")) else "a new plan is a draft or active" if (row["status"] or "draft") not in ("draft", "active") else stages_fault(touched.get("stages")) or (None if "non_goals" in touched else "non_goals must be a list")
            return fault, {"revision": 1, "status": row["status"] or "draft", "superseded_by": None, "goal": touched.get("goal"), "stages": touched.get("stages")}
        if row["op"] == "amend":
            if not touched:
                return "nothing to change", None
            if plan is None:
                return "no plan", None
            fault = (stages_fault(touched["stages"]) if "stages" in touched else None) or ("goal must not be empty" if "goal" in touched and blank(touched["goal"]) else None)
            if fault:
                return fault, None
            if row["expected_revision"] != plan["revision"]:
                return "conflict", None
            return None, plan | {k: touched[k] for k in ("goal", "stages") if k in touched} | {"revision": plan["revision"] + 1}
        if row["status"] not in PLAN_STATUSES:
            return "unknown status", None
        if plan is None:
            return "no plan", None
        if row["expected_revision"] != plan["revision"]:
            return "conflict", None
        if row["status"] == "done" and any(blank(s["evidence"]) for s in plan["stages"]):
            return "stages lack evidence", None
        if row["status"] == "superseded" and not row["superseded_by"]:
            return "superseded by nothing", None
        return None, plan | {"status": row["status"], "superseded_by": row["superseded_by"], "revision": plan["revision"] + 1}

    def step(plan, row):
        fault, new = judge(plan, row)
        plan = plan if fault else new
        now = plan or {"revision": 0, "status": None, "goal": None, "stages": None, "superseded_by": None}
        return plan, (fault is None, fault, now["revision"], now["status"], now["goal"], now["stages"], now["superseded_by"], fault is None and row["op"] == "status" and row["status"] == "done")

    return in_order(changes, ["todo_id"], ["changed_at", "seq"], step, f"accepted boolean, problem string, revision long, plan_status string, goal_now string, stages_now {STAGE.replace(', ', ',')}, superseded_by_now string, closes_todo boolean")
