"""Operators on small frames: order, ties, nulls, empty input, reruns."""

import json

from pyspark.sql import functions as F

from turnmill.operators import evaluate, health, keyed, kpi, ledger, review, scope, trace
from turnmill.sources import logs
from turnmill.streaming import ingest


def test_empty_window_is_a_finding(spark):
    turns = spark.createDataFrame([], "turn_id long, prompt_tokens long, completion_tokens long, flagged int, judged int")
    events = spark.createDataFrame([], "turn_id long, kind string, name string")
    got = review.rollup(turns, events).first()
    assert got.turns == 0 and got.tokens == 0 and got.empty_window


def test_components_stay_in_range(spark):
    rows = [(i, "error" if i % 3 else None, i * 7 % 5, i % 4, i % 6, i % 3, i % 9, i % 4, i % 5, i % 2, i % 3, i % 4, i % 3, i % 2, i * 100, None, 200, i * 90 if i % 2 else None, i) for i in range(60)]
    names = ["turn_id", "outcome", "calls", "failed", "edits", "repeat_edits", "reverts", "compactions", "interrupts", "denials", "todos", "opened", "closed", "critic_fails", "prompt_tokens", "completion_tokens", "context_window", "context_peak", "base_tokens"]
    df = spark.createDataFrame(rows, " long, ".join(names).replace("outcome long", "outcome string") + " long").withColumn("failed", F.least("failed", "calls"))
    parts = (kpi.completion(), kpi.tool_reliability(), kpi.efficiency(), kpi.focus(), kpi.context_health(), kpi.autonomy())
    for r in df.select(*parts).collect():
        assert all(0 <= x <= 1 for x in r)


def test_fold_turns_keeps_facts_and_reruns(spark):
    df = spark.createDataFrame([("t", 1, "ok", None, "fast"), ("t", 2, None, 5, None)], "turn_id string, seq int, outcome string, flagged int, tier string")
    once = keyed.fold_turns(df).first()
    assert (once.outcome, once.flagged, once.tier) == ("ok", 5, None)
    again = keyed.fold_turns(df.unionByName(df)).first()
    assert again == once


def test_todos_reopen(spark):
    df = spark.createDataFrame([("s", "k", 1, "file", "a"), ("s", "k", 2, "file", "b"), ("s", "k", 3, "done", None), ("s", "k", 4, "file", "c"), ("s", "j", 1, "file", "x"), ("s", "j", 2, "done", None)], "source string, key string, ts long, op string, text string")
    got = {r.key: r for r in keyed.fold_todos(df).collect()}
    assert got["k"].status == "open" and got["k"].text == "c" and got["k"].done_at is None and got["j"].status == "done" and got["j"].done_at == 2 and got["j"].text == "x"


def test_plans_compare_and_swap(spark):
    stage = lambda **x: [{"name": "a", "expected_check": "runs", "evidence": None, "status": None} | x]
    # op, expected, goal, stages, non_goals, status, superseded_by; what is to come of it, and the revision after it
    rows = [
        ("amend", 1, "g", None, None, None, None, "no plan", 0), ("add", None, "  ", stage(), [], None, None, "goal must not be empty", 0), ("add", None, "g", [], [], None, None, "stages must not be empty", 0), ("add", None, "g", stage(expected_check=""), [], None, None, "a stage lacks its name or check", 0),
        ("add", None, "g", stage(), None, None, None, "non_goals must be a list", 0), ("add", None, "g", stage(), [], "done", None, "a new plan is a draft or active", 0), ("add", None, "g", stage(), ["x"], None, None, None, 1), ("add", None, "g", stage(), [], None, None, "there is a plan already", 1),
        ("amend", 1, None, None, None, None, None, "nothing to change", 1), ("amend", 0, "h", None, None, None, None, "conflict", 1), ("amend", 1, "h", None, None, None, None, None, 2), ("amend", 2, " ", None, None, None, None, "goal must not be empty", 2), ("status", 2, None, None, None, "odd", None, "unknown status", 2),
        ("status", 1, None, None, None, "active", None, "conflict", 2), ("status", 2, None, None, None, "done", None, "stages lack evidence", 2), ("status", 2, None, None, None, "superseded", None, "superseded by nothing", 2), ("status", 2, None, None, None, "active", None, None, 3),
        ("amend", 3, None, stage(evidence="seen", status="done"), None, None, None, None, 4), ("status", 4, None, None, None, "done", None, None, 5),
    ]
    df = spark.createDataFrame([("p", i, i, *r[:7]) for i, r in enumerate(rows)], "todo_id string, changed_at long, seq long, op string, expected_revision long, goal string, stages array<struct<name:string,expected_check:string,evidence:string,status:string>>, non_goals array<string>, status string, superseded_by string")
    got = keyed.replay_plan_changes(df).orderBy("seq").collect()
    assert [(r.problem, r.revision) for r in got] == [r[7:] for r in rows]
    assert got[-1].plan_status == "done" and got[-1].closes_todo and got[-1].goal_now == "h" and got[-1].stages_now[0].evidence == "seen" and got[6].stages_now[0].status == "pending" and not got[6].closes_todo


def test_chain_tells_a_break(spark):
    df = spark.createDataFrame([("h", i, i, f"v{i}") for i in range(5)], "host string, created_at long, seq long, value string")
    good = keyed.chain_rows(df, ["value"])
    breaks = lambda df: [(r.seq, r.problem) for r in keyed.verify_chain(df, ["value"]).collect()]
    assert breaks(good) == [] and breaks(good.filter("seq <> 2")) == [(3, "prev_hash mismatch")] and good.filter("seq = 0").first().prev_hash is None
    edited = good.withColumn("value", F.when(F.col("seq") == 1, "é😀").otherwise(F.col("value")))
    assert breaks(edited) == [(1, "row_hash mismatch")] and keyed.chain_verdict(edited, keyed.verify_chain(edited, ["value"])).first().verdict == "fail" and keyed.chain_verdict(good.limit(0), keyed.verify_chain(good.limit(0), ["value"])).first().verdict == "silent"
    odd = spark.createDataFrame([("h", 1, 1, "é \"q\" 😀 中", 0.1, None)], "host string, created_at long, seq long, value string, x double, y long")
    assert keyed.verify_chain(keyed.chain_rows(odd, ["value", "y"]), ["value", "y"]).count() == 0 and keyed.verify_chain(keyed.chain_rows(odd, ["value", "x", "y"]), ["value", "x", "y"]).count() == 0


def test_asof_never_falls_back(spark):
    windows = spark.createDataFrame([("s", "a", 10, 20), ("s", "b", 30, None)], "session_id string, turn_id string, lo long, hi long")
    rows = spark.createDataFrame([("s", t, t) for t in (5, 10, 19, 20, 29, 30, 99)] + [("z", 15, 0)], "session_id string, ts long, x long")
    got = {(r.session_id, r.ts): r.turn_id for r in trace.attribute_asof(rows, windows).collect()}
    assert got == {("s", 5): None, ("s", 10): "a", ("s", 19): "a", ("s", 20): None, ("s", 29): None, ("s", 30): "b", ("s", 99): "b", ("z", 15): None}


def test_usage_groups_drop_ids_that_come_back(spark):
    rows = spark.createDataFrame([("s", i, 1000 * i, m) for i, m in enumerate([None, "a", "a", None, "b", "a", "b"])], "session_id string, line long, ts long, message_id string")
    got = {r.message_id: (r.n_rows, r.model_ms) for r in trace.usage_groups(rows).collect()}
    assert got == {"a": (2, 2000), "b": (2, 3000)}


def test_freeze(spark):
    windows = spark.createDataFrame([("s", "a", 0, None)], "session_id string, turn_id string, lo long, hi long")
    rows = spark.createDataFrame([("s", 1), ("s", 2), ("s", 10_000_000)], "session_id string, ts long")
    assert trace.freeze_open_windows(rows, windows).first().hi == 3


def test_missed_batches(spark):
    calls = spark.createDataFrame([("s", 1, "m1", '{"path":"src"}', "found alpha/beta.py"), ("s", 2, "m2", '{"path":"alpha/beta.py"}', "text"), ("s", 3, "m3", '{"path":"other.txt"}', "")], "session_id string, line long, message_id string, input string, result string")
    got = trace.missed_batches(calls).first()
    assert (got.pairs, got.strict_independent) == (2, 1)


def test_globs(spark):
    df = spark.createDataFrame([("a/b",), ("a/x/y/b",), ("../x",), ("a/./c/../b",), ("/etc",), ("z",)], "path string")
    got = {r.path: r.reason for r in review.path_policy(df, ["a/**/b"], ["a/x*"]).collect()}
    assert got == {"a/b": "allowed:a/**/b", "a/x/y/b": "denied:a/x*", "../x": "outside_repo", "a/./c/../b": "allowed:a/**/b", "/etc": "outside_repo", "z": "not_in_allowlist"}


def test_streaks_and_silence(spark):
    f = lambda v: scope.zero_streak(spark.createDataFrame(v, "day int, value int")).first().verdict
    assert f([]) == "silent" and f([(1, 1), (2, 0), (3, 0), (4, 0)]) == "fail" and f([(1, 0), (2, 0), (3, 1)]) == "pass"
    counts = sorted({c for _, a, b in scope.RATES for c in (a, b) if c} | set(scope.MEANS))
    shape = "verdict string, tier string, " + ", ".join(f"{c} long" for c in counts)
    empty = scope.scope_aggregate(spark.createDataFrame([], shape)).first()
    assert empty.verdict == "silent" and empty.rework_rate is None and empty.rows == 0
    one = scope.scope_aggregate(spark.createDataFrame([("silent", "full", *[None if c in scope.MEANS else 2 for c in counts])], shape)).first()
    assert one.verdict == "silent" and one.unobserved_rows == 1 and one.unpaired == ["late_discovery_rate"] and one.tier_full == 1


def test_splits_keep_sessions_whole(spark):
    gold = spark.createDataFrame([(i, f"s{i % 10}") for i in range(100)], "id int, session string")
    got = evaluate.assign_splits(gold)
    assert got.select("session", "split").distinct().count() == 10 and got.filter("split = 'held_out'").select("session").distinct().count() == 4


def test_constant_classifier_has_kappa_0(spark):
    rows = spark.createDataFrame([(1, i % 2, 1.0) for i in range(40)], "prediction int, label int, weight double")
    assert abs(evaluate.scores(evaluate.confusion(rows)).first().kappa) < 1e-9


def test_links_and_plans(spark):
    m = spark.createDataFrame([("a", ["b", "c"]), ("b", [])], "name string, links array<string>")
    assert [r.name for r in health.dangling_links(m).collect()] == ["c"]
    p = spark.createDataFrame([([("s", "", "", "done")], "active", "", 0)], "stages array<struct<name:string,expected_check:string,evidence:string,status:string>>, status string, superseded_by string, revision int")
    assert p.select(health.plan_problems(*(F.col(c) for c in p.columns))).first()[0] == ["no_check:s", "done_without_evidence:s", "bad_revision"]


def test_log_and_stream(spark, tmp_path):
    src, seen = tmp_path / "log", []
    src.mkdir()
    event = {"_kind": "event", "turn_id": "t", "ts": 1, "kind": "edit", "ok": 1}
    (src / "a.jsonl").write_text(json.dumps(event) + "\n\n{torn\n" + json.dumps({"_kind": "odd"}) + "\n" + json.dumps({"x": 1}) + "\n")
    log = logs.read_log(spark, str(src))
    assert {r.kind: r.n for r in logs.kind_counts(log).collect()} == {"event": 1, "odd": 1, None: 2}
    assert logs.split_kinds(log)["event"].first().turn_id == "t"
    run = lambda: ingest.stream_log(spark, str(src), lambda df, i: seen.extend(ingest.events_of(df).collect()), str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "b.jsonl").write_text(json.dumps(event | {"ts": 2}) + "\n")
    run()
    assert sorted(r.ts for r in seen) == [1, 2]


def test_hooks_stream_as_in_batch(spark, tmp_path):
    rows = [("s", 1_700_000_000_000 + i, i, h) for i, h in enumerate(["PostToolUse", "Stop", "UserPromptSubmit", "PreToolUse", "PostToolUse", "UserPromptSubmit", "Odd", "StopFailure"])]
    df = spark.createDataFrame(rows, "session_id string, ts long, seq long, hook string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ingest.stream_hook_sessions(stream).writeStream.format("memory").queryName("hooked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["session_id", "turn_no", "started_at", "ended_at", "wall_ms", "outcome", "tools"]
    batch = ingest.hook_sessions(df).select(cols).orderBy("turn_no").collect()
    live = spark.table("hooked").select(cols).orderBy("turn_no").collect()
    assert [r.turn_no for r in live] == [1, 2, 3] and [(r.outcome, r.tools) for r in live] == [(r.outcome, r.tools) for r in batch]


def test_transcripts(spark, tmp_path):
    block = lambda **x: {"type": "assistant", "timestamp": "2026-01-01T00:00:00Z", "message": {"id": "m", "role": "assistant", "content": [x]}}
    user = {"type": "user", "promptSource": "typed", "message": {"role": "user", "content": "fix it"}}
    d = tmp_path / "p"
    (d / "s1" / "subagents").mkdir(parents=True)
    (d / "s1.jsonl").write_text("\n".join(map(json.dumps, [user, block(type="tool_use", id="u", name="Read", input={"file_path": "x"}), {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u", "content": "r", "is_error": False}]}}])) + "\n{bad")
    (d / "s1" / "subagents" / "x.jsonl").write_text(json.dumps(user))
    raw = logs.read_transcripts(spark, str(d))
    assert raw.filter("bad").count() == 1 and {r.session for r in raw.collect()} == {"s1"}
    rows = logs.transcript_rows(raw)
    assert [r.text for r in logs.human_prompts(rows.filter("not nested")).collect()] == ["fix it"]
    got = trace.match_results(logs.tool_uses(rows), logs.tool_results(rows)).first()
    assert got.matched and got.is_error == 0 and got.name == "Read"


def test_payloads_at_any_depth(spark):
    deep = "x"
    for _ in range(14):
        deep = [deep]
    df = spark.createDataFrame([(json.dumps({"a": [{"b": "AKIA" + "D" * 16}], "n": 1}),), (json.dumps(deep),), ("{torn",), (None,)], "payload string")
    got = [r.payload for r in ledger.redact_payload(df, "payload").collect()]
    assert json.loads(got[0]) == {"a": [{"b": "[REDACTED:aws_key]"}], "n": 1} and got[1:] == [None, None, None]


def test_judges_stop_after_a_failure(spark):
    def client(said):
        if said == "b":
            raise ConnectionError
        return said.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "turn_id long, context string").coalesce(1)
    assert [(r.answer, r.state) for r in ledger.judged(rows, client).collect()] == [("A", "judged"), (None, "failed"), (None, "skipped")]


def test_silence_is_not_health(spark):
    shape = "ts string, started_at long, created_at long"
    some, old = spark.createDataFrame([("2026-01-02T00:00:00Z", 1767312000000, 1767312000)], shape), spark.createDataFrame([("2026-01-01T00:00:00Z", 1767225600000, 1767225600)], shape)
    f = lambda *a: tuple(ledger.scope_liveness(*a, 1767300000000).select("gate_log", "ingestion", "ok").first())
    assert f(old, old, old) == ("inconclusive", "not_applicable", 2) and f(old, some, some) == ("fail", "not_applicable", 1) and f(some, some, old) == ("ok", "fail", 1) and f(some, old, some) == ("ok", "ok", 2)
    s = spark.createDataFrame([(4, "silent", 0)], "day int, verdict string, value int")
    h = spark.createDataFrame([(2, 0), (3, 0)], "day int, value int")
    assert ledger.health_verdict(s, h).first().verdict == "fail" and ledger.health_verdict(s, h.limit(1)).first().verdict == "silent"


def test_plans_by_session_then_repo(spark):
    plans = spark.createDataFrame([("p1", "s1", "r1", 1, "active"), ("p2", "s9", "r2", 2, "active"), ("p3", "s8", "r3", 3, "active"), ("p4", "s1", "r1", 9, "done")], "todo_id string, session_id string, repo string, updated_at long, status string")
    sessions = spark.createDataFrame([("s1", "r2"), ("s2", "r2"), ("s3", "r0")], "session_id string, repo string")
    assert {r.session_id: r.todo_id for r in ledger.active_plan(plans, sessions).collect()} == {"s1": "p1", "s2": "p2", "s3": "p3"}
    stages = spark.createDataFrame([([("a", "done"), ("b", "open")],)], "stages array<struct<name:string,status:string>>")
    assert stages.select(ledger.plan_header(F.lit("goal"), F.col("stages"), F.array(F.lit("x")))).first()[0] == '[plan] goal · stage 2/2 "b" · 1 issue'


def test_context_holds_no_score(spark):
    turns = spark.createDataFrame([("t", 0.25, "s", None, "fast", 7)], "turn_id string, kpi_score double, source string, outcome string, tier string, wall_ms long")
    texts = spark.createDataFrame([("t", "response", 0, "y"), ("t", "prompt", 0, "x" * 300), ("t", "tool_arg", 0, "no")], "turn_id string, kind string, seq int, body string")
    events = spark.createDataFrame([("t", 2, "tool_call", "Read", 0, "gone"), ("t", 1, "tool_call", None, 0, None), ("t", 3, "tool_call", "Bash", 1, None)], "turn_id string, ts long, kind string, name string, ok int, error string")
    head = "TURN: turn_id=t source=s outcome=None tier=fast wall_ms=7\nFLAG_REASONS: slow\nTOOL_FAILURES:\n- tool:\n- Read: gone"
    context = lambda most, e=events: ledger.judge_context(turns, e, texts, F.array(F.lit("slow")), most).first().context
    said = "[prompt#0] " + "x" * 300 + "\n\n[response#0] y"
    assert context(12_000) == head + "\n\nCONVERSATION (tail):\n" + said and context(100) == head and "0.25" not in context(12_000)
    cut = context(220)
    assert len(cut) == 220 and cut.startswith(head) and "...[truncated]...\nx" in cut and cut.endswith(said[-40:])
    assert "TOOL_FAILURES: none" in context(500, events.limit(0))


def test_crontabs_and_config(spark):
    df = spark.createDataFrame([("a", True, "# c\n0 1 * * * run x\n"), ("b", True, "# only\n"), ("c", False, None)], "host string, reachable boolean, body string")
    got = {r.host: (r.jobs_found, r.orphaned) for r in logs.parse_crontabs(df).collect()}
    assert got["a"] == (1, 0) and got["b"] == (0, 1) and got["c"][0] is None
    cfg = logs.read_config(spark, "[governor]\nepsilon = 3.0\nbeta = 1\n", {"governor.epsilon": (0.0, 1.0)})
    assert {r.path: (r.clamped, r.violated) for r in cfg.collect()} == {"governor.epsilon": (1.0, True), "governor.beta": (1.0, False)}
    assert logs.read_config(spark, "[torn", {}).count() == 0
