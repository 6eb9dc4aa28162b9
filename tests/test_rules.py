"""Rules that no SQL of the queries states, against plain loops and small cases."""

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnmill.functions import scalars, text
from turnmill.operators import evaluate, health, keyed, kpi, ledger, percentiles, policy, review, scope, trace
from turnmill.sources import logs
from turnmill.streaming import ingest


def test_ngrams_keep_hyphenated_words(spark):
    df = spark.createDataFrame([("Alpha v-2 beta re-run! x 7 y.",)], "t string")
    got = df.select(text.word_ngrams(F.col("t")).alias("g")).first().g
    words = ["alpha", "v-2", "beta", "re-run!", "x"]
    assert sorted(got) == sorted([" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)])


def test_phrases_are_found_as_substrings(spark):
    r = random.Random(3)
    letters = ["a", "b", "ab", "long-ishword", "x", "é", ""]
    texts = [(i // 5, i % 5, " ".join(r.choice(letters) for _ in range(r.randint(0, 12)))) for i in range(200)] + [(99, 0, "a\nb ab"), (99, 1, "A  B"), (99, 2, None)]
    phrases = sorted({" ".join(r.choice([x for x in letters if x]) for _ in range(r.choice([2, 3]))) for _ in range(60)} | {"verylongfirstword b", "ishword x"})
    turns = spark.createDataFrame(texts, "session long, idx long, text string")
    got = {tuple(x) for x in scope.phrase_hits(spark.createDataFrame([(p,) for p in phrases], "phrase string"), turns).collect()}
    assert got == {(p, s, i) for p in phrases for s, i, t in texts if t is not None and p in t.lower()}


def test_redaction_is_the_plain_chain(spark):
    """The guards never hide what a pattern would find, whatever letters fold to each other."""
    r = random.Random(4)
    parts = ["ſecret", "toKen", "APİ_KEY", "apıkey", "PASSWORD", "pass", "author", "auth", ": ", "=", "'v w'", "x1", "://", "u:p@h", "sk-", "sk-ant-", "a" * 25, "ghp_", "b" * 36, "AKIA", "C" * 16, "xoxb-", "eyJ", "e.f.g", "Bearer ", "AUTHORIZATION: basic ", "authorization:", " ", "\n", "é", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"]
    rows = [("".join(r.choice(parts) for _ in range(r.randint(1, 9))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string")
    plain = F.col("t")
    for kind, (pattern, put) in text.SECRETS.items():
        plain = F.regexp_replace(plain, pattern, put.format(f"[REDACTED:{kind}]"))
    assert df.filter(text.redact(F.col("t")) != plain).count() == 0 and df.filter(plain != F.col("t")).count() > 500


def test_wrappers_are_no_words(spark, tmp_path):
    say = lambda content, **more: json.dumps({"type": "user", "promptSource": "typed", "message": {"role": "user", "content": content}} | more)
    rows = [say("<system-reminder>x</system-reminder>"), say("<system-reminder>x</system-reminder> fix it\x1b[0m"), say([{"type": "text", "text": "two"}, {"type": "text", "text": "lines"}, {"type": "image"}]), say("continue"), say("hello", isMeta=True), say("hi", promptSource="system"), say([{"type": "tool_result", "content": "r"}, {"type": "text", "text": "no"}]), say("[Request interrupted by user] now")]
    (tmp_path / "s.jsonl").write_text("\n".join(rows))
    got = logs.human_prompts(logs.transcript_rows(logs.read_transcripts(spark, str(tmp_path)))).orderBy("line").collect()
    assert [x.text for x in got] == ["fix it", "two\nlines"]


def test_rows_are_parsed_once(spark, tmp_path):
    """A filter on what a row holds doesn't parse it anew for each of its terms; a row that is JSON, but no object, has no fields."""
    rows = ["[1]", '{"type": "user"}', '"x"', json.dumps({"type": "assistant", "message": {"id": "m", "content": [{"type": "tool_use", "id": "u"}]}}), "{torn"]
    (tmp_path / "s.jsonl").write_text("\n".join(rows))
    typed = logs.transcript_rows(logs.read_transcripts(spark, str(tmp_path)))
    for df in (logs.human_prompts(typed), logs.tool_uses(typed), logs.usage_evidence(typed)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") <= 2
    got = {r.line: (r.type, r.blocks, r.plain) for r in typed.collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[0] == got[2] == (None, None, None) and got[1][0] == "user" and [b.id for b in got[3][1]] == ["u"]


def test_trailing_percentiles_and_nearest(spark):
    r = random.Random(5)
    week = 1000
    rows = [(i, r.choice("ab"), r.choice(["x", None]), r.randint(0, 9000), r.choice([None, 0, 7, 50, 900]), r.choice([None, 3, 4]), r.choice([None, -5000, -3, 2, 2000, 90_000])) for i in range(400)]
    df = spark.createDataFrame(rows, "turn_id long, source string, tier string, started_at long, prompt_tokens long, completion_tokens long, wall_ms long")
    rank = lambda v, p: sorted(v)[round(p * (len(v) - 1))] if v else None
    want = {}
    for i, s, t, at, *_ in rows:
        near = [x for x in rows if x[1] == s and x[2] == t and at - week <= x[3] < at]
        tokens = [(x[4] or 0) + (x[5] or 0) for x in near]
        want[i] = rank([n for n in tokens if n > 0], 0.5), rank([x[6] for x in near if x[6] is not None], 0.95)
    assert {x.turn_id: (x.base_tokens, x.base_wall) for x in kpi.trailing_percentiles(df, week).collect()} == want
    got = {x.source: (x.low, x.mid, x.high) for x in percentiles.nearest(df, ["source"], "wall_ms", {"low": 0.0, "mid": 0.5, "high": 0.95}).collect()}
    for s in "ab":
        own = [x[6] for x in rows if x[1] == s and x[6] is not None]
        assert got[s] == (min(own), rank(own, 0.5), rank(own, 0.95))
    assert percentiles.nearest(df.limit(0), ["source"], "wall_ms", {"mid": 0.5}).count() == 0


def test_shadow_decisions_feed_each_other(spark):
    r = random.Random(6)
    arms = [("a", 0.1), ("b", 0.4), ("c", 0.2)]
    rows = [(i, f"k{r.randint(0, 3)}", r.randint(0, 90) * policy.DAY, r.choice([None, r.random()]), [r.random() / 10 for _ in arms], r.choice([None, None, None, "b"])) for i in range(600)]
    df = spark.createDataFrame(rows, "turn_id long, bucket string, started_at long, kpi_score double, linear array<double>, decided string")
    got = {x.turn_id: (x.chosen, round(x.score, 9)) for x in policy.shadow_decisions(df, arms, least=5).collect()}
    want, held = {}, defaultdict(list)
    for i, k, at, y, lin, done in sorted((x for x in rows if x[3] is not None), key=lambda x: (x[2], x[0])):
        scores = []
        for (a, cost), x in zip(arms, lin):
            past = [(0.5 ** ((at - t) / policy.DAY / 30), v) for b, t, v in held[k] if b == a]
            mean = sum(w * v for w, v in past) / sum(w for w, _ in past) if len(past) >= 5 else 0.8
            scores.append(x + mean - 0.2 * cost)
        best = scores.index(max(scores))
        if done is None:
            want[i] = arms[best][0], round(scores[best], 9)
        held[k].append((done or arms[best][0], at, y))
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-6 for i in want)
    again = df.filter("decided is not null").unionByName(df.filter("decided is null").join(spark.createDataFrame([(i, c) for i, (c, _) in got.items()], "turn_id long, c string"), "turn_id").withColumn("decided", F.col("c")).drop("c"))
    assert policy.shadow_decisions(again, arms, least=5).count() == 0


def test_choice_explores_and_falls_back(spark):
    rows = spark.createDataFrame([(i, 0, 100, [], 0, 0.0, 0, 0) for i in range(2000)], "turn_id long, started_at long, prompt_tokens long, verbs array<string>, file_refs int, occupancy double, is_subagent int, hour int")
    none = spark.createDataFrame([], "bucket string, chosen string, mean double, n long")
    got = policy.choose(rows, [("a", 0.1), ("b", 0.2), ("c", 0.0)], {}, none, epsilon=0.3, live=True).collect()
    other = [x for x in got if x.explored]
    assert 0.15 < len(other) / len(got) < 0.25 and {x.chosen for x in other} == {"a", "b"} and all(x.reason == "explore" for x in other) and all(x.chosen == "c" for x in got if not x.explored)
    assert not got[0].shadow and got[0].epsilon == 0.3 and abs(got[0].scores["b"] - 0.76) < 1e-9
    lost = policy.choose(rows.limit(1), [], {}, none).first()
    assert (lost.chosen, lost.reason, lost.shadow) == ("default", "config_error", True)


def test_replay_carries_the_open_scope(spark):
    said = ["refactor everything across the repo then update docs", "why is it slow", "you forgot the tests", "also rewrite all the docs", "go ahead", "please build a page", "no, that's wrong", "fix the typo in src/a.py"]
    r = random.Random(7)
    rows = [(s, i, r.choice(said)) for s in range(30) for i in range(r.randint(1, 6))]
    df = spark.createDataFrame(rows, "session long, idx long, text string")
    alone, within = scope.gate(F.col("text"))
    told = {x.text: x for x in spark.createDataFrame([(t,) for t in said], "text string").select("text", alone.alias("alone"), within.alias("within"), (F.size(text.correction_families(F.col("text"))) > 0).alias("fixes")).collect()}
    want, by = {}, defaultdict(list)
    for s, i, t in sorted(rows):
        by[s].append((i, t))
    for s, turns in by.items():
        active = False
        for n, (i, t) in enumerate(turns):
            tier = told[t].within if active else told[t].alone
            want[s, i] = tier, active, n + 1 < len(turns) and told[turns[n + 1][1]].fixes
            active = active or tier != "none"
    events = scope.replayed(df)
    assert {(x.session, x.idx): (x.tier, x.active, x.next_corrected) for x in events.collect()} == want
    base = [v for v in want.values() if v[0] == "none" and not v[1]]
    got = scope.false_none(events).first()
    assert (got.false_none, got.base) == (sum(v[2] for v in base), len(base)) and got.base
    own = lambda c: (F.when(c.contains("e"), "mini").otherwise("none"), F.lit("none"))
    assert scope.gate_replay(df, classifier=own).filter("tier = 'mini' and active").count() == 0
    share = scope.suppression_check(events, scope.replayed(df, {"vague": ["slow"]})).first()
    assert abs(share.before - sum(v[0] == "none" for v in want.values()) / len(want)) < 1e-9 and share.ok


def test_mined_phrases_name_their_turns(spark):
    rows = [(s, 0, "none", False, True, "the big thing") for s in range(6)] + [(9, 1, "none", False, True, "refactor the big"), (9, 2, "mini", False, True, "the big"), (9, 3, "none", True, True, "the big")]
    events = spark.createDataFrame(rows, "session long, idx long, tier string, active boolean, next_corrected boolean, text string")
    got = {x.phrase: (x.evidence, x["where"]) for x in scope.mine_phrases(events, ["refactor"]).collect()}
    assert got["the big"] == (7, ["0#0", "1#0", "2#0", "3#0"]) and got["big thing"][0] == 6 and not any("refactor" in p for p in got)


def test_bootstrap_as_a_loop(spark):
    r = random.Random(8)
    rows = [(f"s{r.randint(0, 30)}", r.choice([0, 1, 1]), float(r.randint(1, 3))) for _ in range(500)] + [("s1", None, 1.0)]
    df = spark.createDataFrame(rows, "session string, prediction int, weight double")
    got = evaluate.session_bootstrap(df, draws=400).first()
    keys = {x.session: x.k for x in df.select("session", F.xxhash64("session", F.lit(9)).alias("k")).distinct().collect()}
    names = sorted(keys)
    pos = np.array([sum(w * p for s, p, w in rows if s == n and p is not None) for n in names])
    every = np.array([sum(w for s, p, w in rows if s == n and p is not None) for n in names])
    times = evaluate.poisson(np.array([keys[n] for n in names], np.int64).view(np.uint64), 400)
    rates = sorted((pos @ times) / (every @ times))
    assert got.sessions == len(names) and abs(got.low - rates[10]) < 1e-9 and abs(got.high - rates[390]) < 1e-9
    draw = np.random.default_rng(1)
    plain = sorted(pos[k].sum() / every[k].sum() for k in (draw.integers(0, len(names), len(names)) for _ in range(4000)))
    assert abs(got.low - plain[100]) < 0.03 and abs(got.high - plain[3900]) < 0.03
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.05
    assert evaluate.session_bootstrap(df.filter("session = 's1'"), draws=50).first().verdict == "silent"


def test_logs_that_grow(spark, tmp_path):
    """Lines appended later are read once, a torn last line when it is whole, and late parts of a record never undo it."""
    log = tmp_path / "log"
    log.mkdir()
    turn = lambda **x: json.dumps({"_kind": "turn", "turn_id": "t"} | x)
    (log / "a.jsonl").write_text(turn(outcome="ok", wall_ms=1) + "\n" + turn(wall_ms=5)[:20])
    lines, cursor = ingest.read_new(spark, str(log))
    assert lines.count() == 1
    cursor.write.parquet(str(tmp_path / "c1"))
    state = ingest.ingest(lines, {})["turn"]
    state.write.parquet(str(tmp_path / "s1"))
    with open(log / "a.jsonl", "a") as f:
        f.write(turn(wall_ms=5)[20:] + "\n" + turn(outcome=None, flagged=None) + "\n")
    (log / "b.jsonl").write_text(turn(tier="fast") + "\n\n{torn\n")
    lines, cursor = ingest.read_new(spark, str(log), spark.read.parquet(str(tmp_path / "c1")))
    assert lines.count() == 4
    held = {"turn": spark.read.parquet(str(tmp_path / "s1"))}
    got = ingest.ingest(lines, held)["turn"]
    row = keyed.settled(got).first()
    assert (row.outcome, row.wall_ms, row.tier) == ("ok", 5, "fast")
    assert sorted(map(str, ingest.ingest(lines, {"turn": got})["turn"].collect())) == sorted(map(str, got.collect()))
    cursor.write.parquet(str(tmp_path / "c2"))
    lines, _ = ingest.read_new(spark, str(log), spark.read.parquet(str(tmp_path / "c2")))
    assert lines.count() == 0


def test_scoring_leaves_what_is_scored(spark):
    turns = spark.createDataFrame([(1, "s", "fast", 100, 10, None, 5, 0.4, 0, "ok"), (2, "s", "fast", 200, 10, None, 5, None, None, "error"), (3, "s", "fast", 50, 10, None, 5, None, None, "ok")], "turn_id long, source string, tier string, started_at long, prompt_tokens long, completion_tokens long, wall_ms long, kpi_score double, flagged int, outcome string").withColumn("context_peak", F.lit(None).cast("long")).withColumn("context_window", F.lit(0).cast("long"))
    events = spark.createDataFrame([], "turn_id long, ts long, kind string, name string, ok int, path string, decision string, verdict string, opened long, closed long")
    got = {r.turn_id: r for r in kpi.score_unscored(turns, events, since=60).collect()}
    assert got[1].kpi_score == 0.4 and got[1].flagged == 0 and got[3].kpi_score is None
    assert abs(got[2].kpi_score - 0.8) < 1e-9 and got[2].flagged == 1 and json.loads(got[2].kpi_components)["completion"] == 0.0


def test_front_matter():
    f = logs._front
    assert f('---\nname: "a b"\ndescription: >\n  one\n\n  two\nmetadata:\n  type: note\n  # x\nempty:\n---\nbody') == {"name": "a b", "description": "one two", "metadata": {"type": "note"}, "empty": None}
    assert f("---\nraw: |\n  x\n    y\n---") == {"raw": "x\n  y"} and f("no") == "no_frontmatter" and f("---\nname: a") == "no_frontmatter" and f("---\nodd\n---") == "malformed" and f("") == "no_frontmatter"


def test_batches_pair_singles_over_a_batch(spark):
    """Two single calls are neighbours though a message of two calls stands between them."""
    rows = [("s", 1, "m1", "{}", "alpha.py"), ("s", 2, "m2", '{"p":"x"}', ""), ("s", 2, "m2", '{"p":"y"}', ""), ("s", 3, "m3", '{"p":"alpha.py"}', "z"), ("s", 4, "m4", "{}", "")]
    got = trace.missed_batches(spark.createDataFrame(rows, "session_id string, line long, message_id string, input string, result string")).first()
    assert (got.pairs, got.strict_independent, got.loose_independent) == (2, 1, 1)
    assert trace.missed_batches(spark.createDataFrame(rows[:1], "session_id string, line long, message_id string, input string, result string")).count() == 0


def test_bounds_and_signals(spark):
    e = spark.createDataFrame([(1, "hook", "h", 0, None, None), (1, "revert", None, None, None, None), (1, "revert", None, None, None, None), (1, "permission", None, None, None, "deny")], "turn_id long, kind string, name string, ok int, path string, decision string")
    t = spark.createDataFrame([(1, "s")], "turn_id long, session_id string")
    assert {(x.signal, x.subject, x.n) for x in review.session_signals(t, e).collect()} == {("hook_error", "h", 1), ("edit_revert_loop", "", 2)}
    never = review.probe_signals(spark.createDataFrame([], "host string, kind string, ts long, ok long, total long")).collect()
    assert [x.signal for x in never] == ["probe_never_ran"]
    assert [x.finding for x in health.doctor(spark.createDataFrame([(0, 21)], "turns long, unjudged long"), spark.createDataFrame([("h", "k", 0, 0)], "host string, kind string, ok long, total long")).collect()] == ["no_turns", "backlog", "unhealthy_probe"]


@pytest.mark.parametrize("said,want", [("1h 2min 3s left", 3723.0), ("500ms", 0.5), ("n/a", None), ("-", None), ("", None), ("2y 1d", 63201600.0)])
def test_durations(spark, said, want):
    got = spark.createDataFrame([(said,)], "t string").select((scalars.duration_us(F.col("t")) / 1_000_000).alias("x")).first().x
    assert got == want


def test_thin_records_refuse_synthetic_rows(spark):
    log = spark.createDataFrame([("s", "2026-01-01T00:00:00Z", "p", "mini", '{"synthetic": true}'), ("s", "2026-01-01T00:00:01Z", "q", "full", None), ("s", "2026-01-01T00:00:01Z", "q", "full", None), ("s", None, "q", "full", None), ("s", "x", "q", None, None)], "session_id string, ts string, prompt_sha1 string, tier string, made string")
    done = ledger.append_scope_records(log, spark.createDataFrame([], "record_id string"))
    assert sorted(r.outcome for r in done.collect()) == ["already_present", "malformed", "suppressed", "written", "written"]
    rows, refused = ledger.thin_records(done.drop("made"), "h")
    assert rows.count() == 2 and refused.first().refused == 0 and {r.verdict for r in rows.collect()} == {"silent"}
