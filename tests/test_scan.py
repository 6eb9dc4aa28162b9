"""Values carried over blocks are those of a plain loop, and a session of all rows is worked on in several tasks."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from turnmill.operators import scan, trace
from turnmill.streaming import ingest


def loop(rows):
    """(key, at, value, flag) to the five running values, by key and at."""
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for key, some in by.items():
        some.sort(key=lambda r: (r[1] is not None, r[1]))
        held, sum_, seen = None, 0, False
        for i, (_, at, value, flag) in enumerate(some):
            held, sum_ = held if value is None else value, sum_ + (value or 0)
            out[key, at] = (some[i - 1][2] if i else None, some[i + 1][2] if i + 1 < len(some) else None, held, sum_, seen)
            seen = seen or bool(flag)
    return out


def test_running_values(spark):
    """One key with most rows, small keys, a null key, nulls in values, flags and order."""
    r = random.Random(11)
    rows = [("hot", i, r.choice([None, None, None, r.randint(-9, 9)]), None if i % 7 else i > 1400) for i in r.sample(range(5000), 3000)]
    rows += [(r.choice(["a", "b", None]), 10_000 + i, r.choice([None, 1]), i % 5 == 0) for i in range(60)] + [("c", 1, 5, True), ("hot", None, 4, False)]
    df = spark.createDataFrame(rows, "k string, at long, v long, flag boolean")
    steps = {"before": scan.before(F.col("v")), "after": scan.after(F.col("v")), "held": scan.latest(F.col("v")), "sum": scan.total(F.col("v")), "seen": scan.ever(F.col("flag"))}
    cut = scan.cut(df, ["k"], ["at"], 9)
    sizes = [x["count"] for x in cut.filter("k = 'hot'").groupBy(scan.BLOCK).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 600
    got = {(x.k, x["at"]): (x.before, x.after, x.held, x["sum"], x.seen) for x in scan.scan(cut, ["k"], ["at"], **steps).collect()}
    assert got == loop(rows)
    assert scan.scan(scan.cut(df.limit(0), ["k"], ["at"]), ["k"], ["at"], **steps).count() == 0


def test_no_task_holds_a_session(spark):
    """Rows of one session are in several tasks once their running values are known."""
    df = spark.range(4000).selectExpr("'s' AS session_id", "id AS ts", "id AS seq", "CASE id % 7 WHEN 0 THEN 'UserPromptSubmit' WHEN 6 THEN 'Stop' ELSE 'PostToolUse' END AS hook")
    cut = scan.cut(df, ["session_id"], ["ts", "seq"], 8)
    out = scan.scan(cut, ["session_id"], ["ts", "seq"], n=scan.total(F.lit(1)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few, and would be put together again
    try:
        parts = {x.p for x in out.select(F.spark_partition_id().alias("p"), "n").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and out.agg(F.max("n")).first()[0] == 4000
    turns = ingest.hook_sessions(df).orderBy("turn_no").collect()
    assert [(t.turn_no, t.started_at, t.tools) for t in turns] == [(i + 1, 7 * i, min(5, max(0, 4000 - 7 * i - 1))) for i in range(572)]
    assert turns[0].outcome == "ok" and turns[-1].outcome is None


def test_usage_groups_of_one_session(spark):
    """Ids that come back, rows without one, against a loop that keeps what is open."""
    r = random.Random(3)
    rows = [("s", i, i * 1000, r.choice([None, f"m{i // 4}", f"m{i // 4}", f"m{max(0, i // 4 - 2)}"])) for i in range(1200)]
    runs, seen, open_, last = {}, set(), None, None
    for _, line, ts, m in rows:
        if m is None:
            open_ = None
        elif m not in seen:
            seen.add(m)
            open_, runs[m] = m, [line, last, ts, 1]
        elif m == open_:
            runs[m][2:] = [ts, runs[m][3] + 1]
        last = ts
    got = trace.usage_groups(spark.createDataFrame(rows, "session_id string, line long, ts long, message_id string"))
    want = {m: (line, n, None if start is None or not 0 <= end - start <= trace.GAP else end - start) for m, (line, start, end, n) in runs.items()}
    assert {x.message_id: (x.line, x.n_rows, x.model_ms) for x in got.collect()} == want


def test_one_session_asof(spark):
    """Windows of one session, closed and open, ties in time."""
    r = random.Random(5)
    windows = [("s", i, lo, r.choice([None, lo + r.randint(0, 30)])) for i, lo in enumerate(sorted(r.sample(range(3000), 300)))]
    rows = [("s", r.randint(-5, 3100), i) for i in range(2000)]
    got = trace.attribute_asof(spark.createDataFrame(rows, "session_id string, ts long, row long"), spark.createDataFrame(windows, "session_id string, turn_id long, lo long, hi long"))

    def want(ts):
        held = [w for w in windows if w[2] <= ts]
        return held[-1][1] if held and (held[-1][3] is None or ts < held[-1][3]) else None

    assert {(x.ts, x.row): x.turn_id for x in got.collect()} == {(ts, i): want(ts) for _, ts, i in rows}


def test_trace_of_a_large_session(spark):
    """One session with most calls gives what a loop gives: messages of one or more calls, side chains, rows that lack something, results used in the strict or loose reading."""
    r = random.Random(3)
    rows, line = [], 0
    for s, n in (("hot", 900), ("b", 12), ("c", 1)):
        for m in range(n):
            many, side = r.choice([1, 1, 1, 2, 3]), r.random() < 0.1
            for _ in range(many):
                line += 1
                said = r.choice([None, "", "x.py", "abcd", "longer_token", "abcd longer_token"])
                rows.append((s, line, f"{s}{m}", r.choice(["{}", '{"a":"abcd"}', '{"a":"longer_token"}']), said, said is not None, r.choice([0, 1]), r.random() < 0.5, side, "odd" if r.random() < 0.05 else None))
    df = spark.createDataFrame(rows, "session_id string, line long, message_id string, input string, result string, matched boolean, is_error int, prefetchable boolean, sidechain boolean, issue string")

    def plain(some):
        use = [x for x in some if x[9] is None and not x[8]]
        sizes = Counter((x[0], x[2]) for x in use)
        found = dict.fromkeys(("pairs", "strict", "loose"), 0)
        for s in {x[0] for x in use}:
            alone = sorted((x for x in use if x[0] == s and sizes[x[0], x[2]] == 1), key=lambda x: x[1])
            for a, b in zip(alone, alone[1:]):
                had, uses = (set(re.findall(r"[A-Za-z0-9_./-]{4,}", t or "")) for t in (a[4], b[3]))
                found["pairs"] += 1
                found["strict"] += not had & uses
                found["loose"] += not {t for t in had & uses if len(t) >= 8}
        return (len(use), sum(x[7] for x in use), sum(not x[5] for x in use), sum(x[5] and x[6] for x in use), sum(x[9] is not None for x in some), sum(x[9] is None and x[8] for x in some),
                sum(n == 1 for n in sizes.values()), sum(n > 1 for n in sizes.values()), sum(n for n in sizes.values() if n > 1), *found.values())

    own = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(own, "false")  # a small table stays in several blocks
    try:
        got = {x.session_id: tuple(x)[1:13] for x in trace.corpus_tool_trace(df).collect()}
    finally:
        spark.conf.unset(own)
    assert got == {s: plain([x for x in rows if s in (None, x[0])]) for s in ("hot", "b", "c", None)}
    assert trace.corpus_tool_trace(df.limit(0)).count() == 0
