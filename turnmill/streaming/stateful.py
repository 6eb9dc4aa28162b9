"""Streams whose state is kept by bucket of keys: turns from partial records that come late (U-1, R-5), turns of hook sessions (R-3).

Their state is kept by RocksDB on the executors and in the checkpoint: start them inside state_store."""

from __future__ import annotations

import pickle
import sys
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DecimalType, FractionalType, IntegralType, LongType, StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"
KNOWN = ["UserPromptSubmit", "PreToolUse", "PostToolUse", "PostToolUseFailure", "Stop", "StopFailure"]
#: Of the keys that a stream holds; a checkpoint keeps to the number that it began with.
BUCKETS = 1 << 12


@contextmanager
def state_store(spark: SparkSession, empty: bool = True):
    """Streams started inside keep their state in RocksDB; the session's own settings come back at the end. empty: whether batches without data run, which tell what timers close; state that is
    forgotten by the clock (stream_turns) asks for them without end, so that availableNow doesn't end with them. A stream that tells nothing in them (ingest.dedup_events) only reads its state once more.

    Each write is one: rows aren't looked up before to be counted, and a trigger's changes are saved, not the state whole."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    ours = {PROVIDER: ROCKSDB, COUNTED: "false", CHANGES: "true", EMPTY: str(empty).lower()}
    own = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in own.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def _bucket(key: str) -> Column:
    """Keys are held by bucket, as one value each, so that what a call of Python and of the state store costs is paid for a bucket, however many keys it has."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("__bucket")


def _exact(f: StructField) -> tuple[Column, type | None]:
    """A number goes to Python as text, since pandas makes doubles of integers with nulls, and nulls of NaN."""
    of = int if isinstance(f.dataType, IntegralType) else float if isinstance(f.dataType, FractionalType) and not isinstance(f.dataType, DecimalType) else None
    return F.col(f.name).cast("string").alias(f.name) if of else F.col(f.name), of


def stream_turns(records: DataFrame, key: str = "turn_id", seq: str = "seq", keep: str = "30 days") -> DataFrame:
    """U-1 and R-5 as a stream in update mode: each trigger tells the states, as keyed.fold_state makes them, of the turns that had records in it. seq isn't null.

    Of each column the last value that a record carried counts, with its place; of one place the larger, so that the order in which records come doesn't matter. A turn without a record for the keep time is forgotten; one that comes later tells what it carries itself, and keyed.merge_states puts it to what was told before."""
    of = records.schema
    cols = [f for f in of.fields if f.name not in (key, seq)] + [StructField("__seq", of[seq].dataType)]
    schema = StructType([of[key], *(x for f in cols for x in (StructField(f.name, f.dataType), StructField(f"__at_{f.name}", of[seq].dataType)))])
    names, wait = [key, seq, *(f.name for f in cols[:-1])], int(pd.Timedelta(keep).total_seconds() * 1000)
    sent, kinds = zip(*(_exact(of[c]) for c in names))
    width, shape = len(cols), schema.names
    texts = {f.name: StringType() for f in schema if _exact(f)[1] is float}  # on their way back too

    def values(column: pd.Series, kind: type | None) -> list:
        return [None if v is None else kind(v) for v in column.tolist()] if kind else [None if v is pd.NaT else v for v in column.tolist()]

    def step(_, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        held = {k: x for k, x in pickle.loads(state.get[0]).items() if x[0] + wait > now} if state.exists else {}  # key: when a record came last, values and places
        met = {}
        for part in parts:
            for k, at, *row in zip(*(values(part[c], kind) for c, kind in zip(names, kinds))):
                mine = met.get(k)
                if mine is None:
                    mine = met[k] = held[k][1] if k in held else [None] * 2 * width
                for i, v in enumerate((*row, at)):
                    if v is not None:
                        before = mine[2 * i + 1]
                        if before is None or at > before or at == before and v > mine[2 * i]:
                            mine[2 * i], mine[2 * i + 1] = v, at
        held.update((k, (now, mine)) for k, mine in met.items())
        state.update((pickle.dumps(held),))
        state.setTimeoutDuration(wait)
        columns = [list(met), *(list(c) for c in zip(*met.values()))]
        yield pd.DataFrame({c: pd.Series([None if x is None else repr(x) for x in v] if c in texts else v, dtype=object) for c, v in zip(shape, columns)})

    rows = records.select(_bucket(key), *sent)
    told = rows.groupBy("__bucket").applyInPandasWithState(step, StructType([StructField(f.name, texts.get(f.name, f.dataType)) for f in schema]), "turns binary", "update", GroupStateTimeout.ProcessingTimeTimeout)
    told = told.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
    state = lambda c: F.when(F.col(f"__at_{c}").isNotNull(), F.struct(F.col(f"__at_{c}").alias("at"), F.col(c).alias("value"))).alias(c)
    return told.select(key, "__seq", *(state(f.name) for f in cols[:-1]))


def stream_hook_turns(hooks: DataFrame, idle: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """R-3 as a stream in append mode (hooks: session_id, ts, seq, hook; ts and seq not null): a turn is told when it ends, or when another opens, as ingest.hook_sessions has it. Events of one trigger are put in order, triggers follow each other. A session
    without events for the idle time, by the stream's own clock (events at most delay late), is forgotten, its open turn told without an end."""
    long = LongType()
    schema = StructType([hooks.schema["session_id"], *(StructField(c, long) for c in ("turn_no", "started_at", "ended_at", "wall_ms")), StructField("outcome", StringType()), StructField("tools", long)])
    wait, names, known = int(pd.Timedelta(idle).total_seconds() * 1000), schema.names, frozenset(KNOWN)
    session, kind = _exact(hooks.schema["session_id"])

    def step(_, parts, state: GroupState):
        now = state.getCurrentWatermarkMs()
        turns = pickle.loads(state.get[0]) if state.exists else {}  # session: turn number, started, last, tools, open, due
        came, out = {}, []
        for part in parts if not state.hasTimedOut else ():
            for s, *event in zip(*(part[c].tolist() for c in ("session_id", "ts", "seq", "hook"))):
                came.setdefault(None if s is None else kind(s) if kind else s, []).append(event)
        for s, events in came.items():
            no, started, last, tools, open_, _ = turns.get(s, (0, 0, 0, 0, False, 0))
            for ts, _, hook in sorted(events, key=lambda e: e[:2]):  # a session's part of one trigger, whose size the source bounds
                last = max(last, ts)
                if hook not in known:
                    continue
                if hook == "UserPromptSubmit" or not open_:
                    if open_:
                        out.append((s, no, started, None, None, None, tools))
                    no, started, tools, open_ = no + 1, ts, 0, True
                tools += hook in ("PostToolUse", "PostToolUseFailure")
                if hook in ("Stop", "StopFailure"):
                    out.append((s, no, started, ts, max(0, ts - started), "ok" if hook == "Stop" else "error", tools))
                    open_ = False
            turns[s] = (no, started, last, tools, open_, max(last + wait, now + 1))
        for s in [s for s, x in turns.items() if x[5] < now]:
            no, started, _, tools, open_, _ = turns.pop(s)
            if open_:
                out.append((s, no, started, None, None, None, tools))
        if turns:
            state.update((pickle.dumps(turns),))
            state.setTimeoutTimestamp(max(min(x[5] for x in turns.values()), now + 1))
        else:
            state.remove()
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(names, zip(*out) if out else [()] * len(names))})

    timed = hooks.select("session_id", "ts", "seq", "hook", F.timestamp_millis("ts").alias("at")).withWatermark("at", delay).select(_bucket("session_id"), session, "ts", "seq", "hook", "at")
    return timed.groupBy("__bucket").applyInPandasWithState(step, schema, "turns binary", "append", GroupStateTimeout.EventTimeTimeout)


def into(path: str):
    """A sink for foreachBatch: a batch is a partition of the table, which a batch that is run again overwrites, and no other."""

    def put(df: DataFrame, i: int) -> None:
        df.withColumn("batch", F.lit(i)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return put
