"""What showed only in larger tables: keys beyond what a product holds, sums beyond a long, rows that tie."""

import io
import json
import os
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from turnmill.operators import ledger, phrases, scan, scope, trace
from turnmill.plans import queries, source_queries, trace_queries
from turnmill.sources import growing, logs, shared

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder with the smallest tables, those named replaced by what a SELECT gives."""

    def make(**selects):
        for f in os.listdir(SF):
            if f.removesuffix(".parquet") not in selects:
                os.symlink(f"{SF}/{f}", tmp_path / f)
        for t, select in selects.items():
            duckdb.sql(f"COPY ({select.format(f"'{SF}/{t}.parquet'")}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return make


def test_transcripts_are_sorted_not_gathered(spark, monkeypatch):
    """No session's file is held as one value, and its lines stand in order."""

    def gathered(*_):
        raise AssertionError("a file is gathered")

    lines = source_queries.transcripts(spark, SF)
    want = {}
    for r in sorted(lines.collect(), key=lambda r: (r.s, r.o, r.line)):
        want.setdefault(str(r.s), []).append(r.line)
    monkeypatch.setattr(source_queries.F, "collect_list", gathered)
    paths = []
    folder = source_queries.folder
    monkeypatch.setattr(source_queries, "folder", lambda *a: paths.append(folder(*a)) or paths[-1])
    source_queries.transcript_rows(spark, SF)
    got = {}
    files = spark.read.text(paths[0], wholetext=True).collect()
    for r in files:
        assert r.file not in got  # a file for each session
        got[r.file] = r.value.splitlines()
    assert {k.removeprefix("p/s").removesuffix(".jsonl"): v for k, v in got.items()} == want


def test_transcripts_are_packed_and_their_lines_not_shuffled(spark, monkeypatch):
    """What is dealt out by session has no line in it, and the files are a fraction of their lines."""
    dealt, paths = [], []
    frame, folder = type(spark.range(0)), source_queries.folder
    deal = frame.repartitionById
    monkeypatch.setattr(frame, "repartitionById", lambda df, *a: dealt.append(df.columns) or deal(df, *a))
    monkeypatch.setattr(source_queries, "folder", lambda *a: paths.append(folder(*a)) or paths[-1])
    source_queries.transcript_rows(spark, SF)
    assert dealt and not any("line" in columns for columns in dealt)
    files = [os.path.join(at, f) for at, _, names in os.walk(paths[0].removeprefix("file://")) for f in names if f.startswith("part-")]
    text = sum(len(r.value) for r in spark.read.text(paths[0], wholetext=True).collect())
    assert len(files) == 40 and 5 * sum(map(os.path.getsize, files)) < text


def test_calls_told_twice_are_one(spark, tables):
    """Of lines that tell of one call, one with a result stays; a line of another kind or part is another call."""
    same = "SELECT * REPLACE ('N' AS l_returnflag) FROM {0} UNION ALL SELECT * REPLACE ('R' AS l_returnflag) FROM {0} UNION ALL SELECT * REPLACE (l_partkey + 1000000 AS l_partkey) FROM {0} WHERE l_linenumber = 5"
    d = tables(lineitem=same)
    rows = [json.loads(r.line) for r in source_queries.transcripts(spark, d).filter("not o like 'zz%'").collect()]
    uses, results = ([b for r in rows for b in r["message"]["content"] if b["type"] == kind] for kind in ("tool_use", "tool_result"))
    con = duckdb.connect()
    for t in ("lineitem", "conversations"):
        con.execute(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    want = con.execute(queries.ORACLE["s5_read_transcripts"]).fetchall()
    assert len(uses) == len({u["id"] for u in uses}) == sum(n for _, n in want)
    told = con.execute("SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey % 12 FROM lineitem WHERE l_linenumber <= 5 AND l_returnflag <> 'N')").fetchall()[0][0]
    assert len(results) == told
    assert sorted((r.session, r.calls) for r in queries.QUERIES["s5_read_transcripts"](spark, d).collect()) == sorted(want)


def test_blocks_leave_nothing_shuffled(spark):
    """what was shuffled for a written step goes when it is written, and the session's setting is as before."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(shared.SWEEP)
    rows = scan.cut(spark.range(1000).selectExpr("id % 7 AS k", "id AS t"), ["k"], ["t"])
    until = time.time() + 20  # files go in the background
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(shared.SWEEP) == setting and rows.count() == 1000


def test_tool_trace_holds_what_it_still_reads(spark, monkeypatch):
    """a step's input isn't there beside what the step after next writes; parsed rows don't hold their JSON too."""
    there, held = {}, {}
    of = lambda name: [p for p in there if f"/{name}-" in p and os.path.exists(p)]
    for module in (source_queries, trace, scan):
        monkeypatch.setattr(module, "folder", lambda *a: there.setdefault((p := shared.folder(*a)).removeprefix("file://"), p))

    def lean(df, path):
        name = path.rsplit("/", 1)[1].rsplit("-", 1)[0]
        held[name] = {n for n in ("transcripts", "tool-rows", "tool-calls", "messages", "blocks") if of(n)}
        assert name != "tool-rows" or df.schema["message"].dataType.names == ["id"]
        return shared.lean(df, path)

    for module in (source_queries, trace, scan):
        monkeypatch.setattr(module, "lean", lean)
    queries.QUERIES["a17_tool_trace"](spark, SF).collect()
    assert held == {"tool-rows": {"transcripts"}, "tool-calls": {"tool-rows"}, "messages": {"tool-calls"}, "blocks": {"tool-calls", "messages"}}
    assert not of("transcripts") and not of("tool-rows") and not of("messages")


@pytest.mark.parametrize("name", ["w6_missed_batches", "a17_all_figures"])
def test_large_turn_ids(spark, tables, name):
    """turn_id * 10^13 is no long; turns moved by a multiple of what the query counts by give the same."""
    plain = lambda df: sorted(map(str, df.collect()))
    d = tables(lineitem="SELECT * REPLACE (l_orderkey + 900000000 AS l_orderkey) FROM {}")
    assert plain(queries.QUERIES[name](spark, d)) == plain(queries.QUERIES[name](spark, SF))


def test_sum_of_times_beyond_a_long(spark, tables):
    """F8: the sum is exact where it is no long, and a long elsewhere."""
    d = tables(lineitem="SELECT * REPLACE (TIMESTAMP '290000-01-01' AS l_shipdate) FROM {}")
    got = {r.kind: int(r.ts) for r in queries.QUERIES["s2_split_kinds"](spark, d).collect()}
    sql = queries.ORACLE["s2_split_kinds"].replace("CAST(sum(ts) AS BIGINT)", "sum(ts)")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW lineitem AS FROM '{d}/lineitem.parquet'")
    assert got == {r[0]: r[3] for r in con.execute(sql).fetchall()} and max(got.values()) > 2**63
    assert dict(queries.QUERIES["s2_split_kinds"](spark, SF).dtypes)["ts"] == "bigint"


def test_failed_tools_of_one_time(spark):
    """by time, then by name: tool1 before tool10."""
    e = spark.createDataFrame([("t", 5, "tool_call", n, 0, None) for n in ("tool10", "tool1", "tool11")], "turn_id string, ts long, kind string, name string, ok int, error string")
    t = spark.createDataFrame([("t", "s", "ok", None, 1)], "turn_id string, source string, outcome string, tier string, wall_ms long")
    said = spark.createDataFrame([], "turn_id string, kind string, seq long, body string")
    got = ledger.judge_context(t, e, said, F.array().cast("array<string>")).first().context
    assert got.endswith("TOOL_FAILURES:\n- tool1:\n- tool10:\n- tool11:")


def test_last_judgment_of_large_parts(spark, tables):
    """a part's key may outweigh a line's number."""
    d = tables(lineitem="SELECT * REPLACE (l_partkey * 7919 % 1000003 AS l_partkey) FROM {}")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    want = con.execute(queries.ORACLE["u4_replace_judgments"]).fetchall()
    got = queries.QUERIES["u4_replace_judgments"](spark, d).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, raw: bytes):
        self.handle, self.n = io.BytesIO(raw), 0

    def seek(self, at):
        self.handle.seek(at)

    def read(self, n):
        found = self.handle.read(n)
        self.n += len(found)
        return found


def test_small_ranges_read_little_and_share_tasks():
    """ranges of 4096 bytes read about what they hold, not a block before each, and many are one task; each line once."""
    raw = b"".join(b'{"turn_id":%d}\n' % i for i in range(200_000))
    handle, found = Counted(raw), []
    ranges = [("f", a, min(len(raw), a + 4096)) for a in range(0, len(raw), 4096)]
    for _, first, end in ranges:
        found += [x for _, part in growing.lines(handle, first, end) for x in part]
    assert found == raw.splitlines() and handle.n < 2 * len(raw)
    tasks = growing.bundled(ranges, 4096)
    assert len(tasks) <= growing.TASKS and [r for t in tasks for r in t] == ranges
    large = [("f", a, a + growing.CHUNK) for a in range(0, 1000 * growing.CHUNK, growing.CHUNK)]
    assert growing.bundled(large, growing.CHUNK) == [[r] for r in large] and growing.bundled([], 4096) == []


def test_small_files_as_binary_files(spark, tmp_path):
    """The same files as Spark's reader finds, by as many tasks as a shuffle has, not one for 32 files; in folders at any depth, hidden ones left out."""
    for i in range(300):
        at = tmp_path / "in" / f"p{i % 3}" / ("deep/er" if i % 2 else ".")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"é {i}%20.{'md' if i % 5 else 'txt'}").write_bytes(b"x" * (i + 1))
    (tmp_path / "in/top.md").write_text("top")
    for hidden in ("in/_x.md", "in/p0/.y.md", "in/p1/_no/z.md"):
        (tmp_path / hidden).parent.mkdir(exist_ok=True)
        (tmp_path / hidden).write_text("no")
    plain = lambda df: sorted((r.path, bytes(r.content), r.length) for r in df.collect())
    for root in (str(tmp_path / "in"), f"file://{tmp_path}/in", f"{tmp_path}/in/p*", f"{tmp_path}/in/top.md"):
        for pattern in ("*.md", "*"):
            want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content", "length")
            assert plain(logs.small_files(spark, root, pattern)) == plain(want)
    assert logs.scan_markdown_index(spark, str(tmp_path / "in")).rdd.getNumPartitions() <= 4
    (tmp_path / "in/p0/none.md").touch()
    assert any(r.path.endswith("none.md") and r.length == 0 for r in logs.small_files(spark, str(tmp_path / "in"), "*.md").collect())


def test_pieces_of_phrases_are_not_sent(spark):
    """a text gives no phrase of which it only has pieces, however frequent; long phrases, rows of one key or none, repeats at a text's edges are found as a plain search finds them, and counted so."""
    many = [f"common words here {i}" for i in range(300)]
    long = ["é" * 40, "é" * 39 + "e", "ab" * 300, "a" * 64, "a" * 65, "b" * 70 + "c"]
    texts = ["Common words here 7 again", "common words here", "é" * 41, "AB" * 301, "a" * 66, "b" * 71 + "c", "ab" * 299 + "a", "", None, "common words here 299", "x" * 200_000 + "common words here 12"] + ["common words here and there"] * 300
    keys = [(None, 1), (1, 1), (1, 1), (1, 1)]
    turns = spark.createDataFrame([(*keys[i % 4], t) for i, t in enumerate(texts)], "session long, idx long, text string")
    given = spark.createDataFrame([(p,) for p in [*many, *long, "7 again", ""] * 2], "phrase string")
    want = sorted((p, str(keys[i % 4])) for p in [*many, *long, "7 again"] for i, t in enumerate(texts) if t and p in t.lower())
    got = scope.phrase_hits(given, turns).collect()
    assert sorted((r.phrase, str((r.session, r.idx))) for r in got) == want and len(want) > 8
    each = {p: sum(q == p for q, _ in want) for p, _ in want}
    assert {r.phrase: r.n for r in scope.phrase_counts(given, turns).collect()} == each
    sent = phrases.windows(scope._phrases(given), turns.select(F.lower("text").alias("text"))).count()
    assert sent <= len(want) + 2  # 303 texts have pieces of 300 phrases each


def test_filter_that_is_full_costs_only_rows(spark, monkeypatch):
    """phrases beyond the filter's size let more through, which the join takes out."""
    monkeypatch.setattr(phrases, "BITS", (15, 15))
    turns = spark.createDataFrame([(i, 0, f"no {i} such {i * 7} text") for i in range(60)], "session long, idx long, text string")
    given = spark.createDataFrame([(f"{i} such {i * 7}",) for i in range(40)] + [(f"{i}-{i}",) for i in range(8000)], "phrase string")
    assert {(r.phrase, r.session) for r in scope.phrase_hits(given, turns).collect()} >= {(f"{i} such {i * 7}", i) for i in range(40)}
    assert phrases.windows(scope._phrases(given), turns.select("text")).count() > scope.phrase_hits(given, turns).count()
    assert {(r.phrase, r.n) for r in scope.phrase_counts(given, turns).collect()} == {(p, n) for p, n in {(p, sum(p in f"no {i} such {i * 7} text" for i in range(60))) for (p,) in given.distinct().collect()} if n}


def test_scope_passes_read_events_once_a_purpose(spark, tmp_path):
    """openings, marks and what is counted are each read for themselves, and a fold of which only the ids are wanted counts nothing."""
    rows = [(k, 1000 * t, op, k, "d", "full", None, "p", 0, d, "manual", c) for k in range(6) for t, op, d, c in [(1, "open", None, None), (2, "item", "committed", None), (3, "begin", None, None), (4, "item", "non_goal", None), (4, "item", "odd", None), (5, "question", None, k % 2 == 0), (5, "question", None, None), (6, "stop", None, None), (7, "item", "committed", None)]]
    spark.createDataFrame(rows, "pass_id long, ts long, op string, session_id long, cwd string, tier string, gate_ts string, prompt_sha1 string, divergence_flagged int, disposition string, source string, changed boolean").write.parquet(f"{tmp_path}/events")
    events = spark.read.parquet(f"{tmp_path}/events")
    some = ledger.fold_scope_passes(events, spark.createDataFrame([], "record_id string"))
    out = ledger.fold_scope_passes(events, some.filter("pass_id = 4").select("record_id"))
    want = [(k, 2, 1, 1, 0, 1, 0, 2, int(k % 2 == 0), 2000) for k in (0, 1, 2, 3, 5)]
    assert sorted(tuple(r) for r in out.select("pass_id", "found_total", "committed", "non_goals", "assumptions", "late_discovered", "divergence_kept", "questions_asked", "questions_valuable", "ceremony_ms").collect()) == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 9


def test_lines_of_scope_records_are_dealt_out_by_number(spark, monkeypatch):
    """no task tells more lines' files apart than a fixed number, on average, and none before they are dealt out; the records are the same."""
    want = sorted(map(tuple, trace_queries.records(spark, SF).collect()))
    monkeypatch.setattr(trace_queries, "LINES", 100)
    some = trace_queries.records(spark, SF)
    assert sorted(map(tuple, some.collect())) == want and len(want) > 1000
    plan = some._jdf.queryExecution().sparkPlan().toString()
    n = duckdb.sql(f"SELECT count(*) FROM '{SF}/lineitem.parquet'").fetchall()[0][0]
    below = plan[plan.index(f"l_partkey#{re.search(r'turn_id#\d+L, l_partkey#(\d+)L, ' + str(n // 100 + 1), plan)[1]}L, {n // 100 + 1})") :]  # the plan's part under the dealing out
    assert "Aggregate" not in below


def test_turns_of_scope_records_are_dealt_out_by_number(spark, monkeypatch, tables):
    """a task joins as many turns to their lines as LINES says, on average, whatever the number of shuffle partitions."""
    monkeypatch.setattr(trace_queries, "LINES", 100)
    some = trace_queries.records(spark, SF)
    n = duckdb.sql(f"SELECT count(*) FROM '{SF}/lineitem.parquet'").fetchall()[0][0] // 100 + 1
    tasks = {r[0]: r[1] for r in some.groupBy(F.spark_partition_id()).count().collect()}
    assert len(tasks) > n / 2 and max(tasks.values()) <= 100
    assert trace_queries.records(spark, tables(lineitem="SELECT * FROM {} LIMIT 50")).rdd.getNumPartitions() == duckdb.sql(f"SELECT count(*) FROM '{SF}/orders.parquet'").fetchall()[0][0] // 100 + 1  # few lines, many turns


@pytest.mark.parametrize("name", ["a10_scope_aggregate", "a11_scope_by_tier"])
def test_scope_records_of_odd_lines(spark, tables, name):
    """lines without a file, turns without any, a turn with most lines."""
    d = tables(lineitem="SELECT * REPLACE (CASE WHEN l_orderkey % 2 = 0 THEN 7 WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey, CASE WHEN l_orderkey % 5 = 0 OR l_linenumber = 2 THEN NULL ELSE l_partkey END AS l_partkey) FROM {}")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in queries.QUERIES[name](spark, d).select(*names).collect()))) == sorted(map(str, want.fetchall()))
