"""Streams that are started anew for each part tell what the whole tells in batch."""

import random

from turnmill.operators import keyed
from turnmill.streaming import ingest, stateful


def drain(spark, tmp_path, parts, schema, stream, mode):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        with stateful.state_store(spark, mode == "append"):
            rows = stream(spark.readStream.schema(schema).parquet(src))
            rows.writeStream.outputMode(mode).foreachBatch(stateful.into(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_late_parts(spark, tmp_path):
    """Records in any order and more than once, ties in place, nulls; a trigger's state is that of all records so far."""
    r = random.Random(4)
    schema = "turn_id string, seq long, outcome string, wall_ms long, flagged int"
    rows = [(r.choice("abcdef"), r.randint(1, 30), r.choice([None, "ok", "error"]), r.choice([None, None, r.randint(0, 9)]), r.choice([None, None, 1])) for _ in range(60)]
    parts = [rows[:25], rows[25:], rows[10:40], [("new", 1, None, None, None)]]
    before = spark.conf.get(stateful.PROVIDER, None)
    told = drain(spark, tmp_path, parts, schema, stateful.stream_turns, "update")
    assert spark.conf.get(stateful.PROVIDER, None) == before
    want = keyed.fold_state(spark.createDataFrame([x for p in parts for x in p], schema))
    plain = lambda df: {x.turn_id: (x["__seq"], x.outcome, x.wall_ms, x.flagged) for x in df.collect()}
    assert plain(keyed.merge_states(told.drop("batch"))) == plain(want)
    first = told.filter("batch = 0").drop("batch")
    assert plain(first) == plain(keyed.fold_state(spark.createDataFrame(rows[:25], schema)))
    late = told.filter("batch = 2").drop("batch")  # tells nothing new
    assert {k: v for k, v in plain(want).items() if k in plain(late)} == plain(late)


def test_idle_sessions(spark, tmp_path):
    """A turn goes on over triggers; a session that is idle is forgotten, its open turn told without an end, and begins anew."""
    hour, t0 = 3_600_000, 1_700_000_000_000
    a = [("a", t0, 1, "UserPromptSubmit"), ("a", t0 + 1, 2, "PostToolUse"), ("b", t0 + 2, 3, "PreToolUse")]
    b = [("a", t0 + 5, 4, "PostToolUse"), ("a", t0 + 6, 5, "Stop"), ("a", t0 + 7, 6, "UserPromptSubmit"), ("a", t0 + 8, 7, "Odd")]
    c = [("c", t0 + 40 * hour, 8, "StopFailure")]
    d = [("a", t0 + 41 * hour, 9, "Stop")]
    told = drain(spark, tmp_path, [a, b, c, d], "session_id string, ts long, seq long, hook string", stateful.stream_hook_turns, "append")
    got = sorted((x.session_id, x.started_at - t0, x.turn_no, x.ended_at and x.ended_at - t0, x.outcome, x.tools) for x in told.collect())
    assert got == [("a", 0, 1, 6, "ok", 2), ("a", 7, 2, None, None, 0), ("a", 41 * hour, 1, 41 * hour, "ok", 0), ("b", 2, 1, None, None, 0), ("c", 40 * hour, 1, 40 * hour, "error", 0)]


def test_dedup_in_a_stream(spark, tmp_path):
    """A null name is an empty one; what came in a trigger before isn't told again."""
    schema = "turn_id string, ts long, kind string, name string, payload string"
    rows = [("t", 1_700_000_000_000, "edit", None, None), ("t", 1_700_000_000_000, "edit", "", "{}"), ("t", 1_700_000_000_001, "edit", "x", '{"tool_use_id": "u"}')]
    told = drain(spark, tmp_path, [rows[:2], rows, rows[2:] * 2], schema, ingest.dedup_events, "append")
    assert sorted((x.turn_id, x.ts, x.kind, x.name or "") for x in told.collect()) == [("t", 1_700_000_000_000, "edit", ""), ("t", 1_700_000_000_001, "edit", "x")]


def test_keys_share_a_bucket(spark, tmp_path, monkeypatch):
    """However many turns there are, a trigger writes a row of state for each bucket; numbers beyond 2^53 beside nulls stay as they are."""
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    schema, big = "turn_id long, seq long, wall_ms long, share double", (1 << 53) + 1
    rows = [(big + i, 1, big if i % 3 else None, float("nan") if i % 5 == 0 else None) for i in range(50)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    with stateful.state_store(spark, empty=False):
        told = stateful.stream_turns(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = told.writeStream.outputMode("update").foreachBatch(stateful.into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert 0 < sum(s.numRowsUpdated for s in q.lastProgress.stateOperators) <= 2
    got = {x.turn_id: (x.wall_ms and x.wall_ms.value, x.share and str(x.share.value)) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {k: (wall, share and str(share)) for k, _, wall, share in rows}


def test_a_duplicate_meets_one_state(spark, tmp_path, monkeypatch):
    """The query that streams its events twice runs a batch each time, not an empty one after it, which reads all state once more."""
    from turnmill.plans import queries, source_queries

    monkeypatch.setattr(source_queries, "folder", lambda _, name: str(tmp_path / name))
    queries.QUERIES["r2_stream_dedup"](spark, "/root/testdata/sf0.001")
    assert len([p for p in tmp_path.glob("events-state/commits/*") if p.name.isdigit()]) == 2
    assert list(tmp_path.glob("events-state/state/0/*/*.changelog"))  # a trigger's changes are saved, not the whole
