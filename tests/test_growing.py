"""Logs that grow, read by byte ranges: whatever the cut, each line once, when it is complete."""

import bz2
import gzip
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from turnmill.sources import growing, logs
from turnmill.streaming import ingest

TEXT = "".join(f"{i} é😀{'x' * (i % 7)}\n" for i in range(40)) + "\n\nlast line is torn é"


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 10_000])
def test_ranges_cut_anywhere(chunk):
    raw = TEXT.encode()
    want, at = [], 0
    for line in raw.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    got = []
    for _, a, b in growing.grown({"f": len(raw)}, {}, chunk):
        for places, found in growing.lines(io.BytesIO(raw), a, b, block=5):
            got += zip(places, found)
    assert got == want


def test_growth_torn_anywhere(spark, tmp_path):
    """A file grows by any number of bytes, also inside a letter; a file that stays isn't opened; one that shrinks is read anew."""
    log = tmp_path / "log" / "day=1"
    log.mkdir(parents=True)
    raw, got, before = TEXT.encode(), [], {}
    (log / "same.jsonl").write_text("same\n")
    for n, cut in enumerate((0, 1, 5, 8, 9, 100, 333, 334, len(raw))):
        (log / "a.jsonl").write_bytes(raw[:cut])
        found, now = growing.read(spark, str(tmp_path / "log"), before, "*.jsonl", chunk=50)
        got += [(r.start, r.value) for r in found.collect() if r.file.endswith("a.jsonl")]
        assert all(f.endswith("a.jsonl") for f, _, _ in growing.grown(now, before)) or n == 0
        before = now
        (log / "same.jsonl").write_text("else\n")  # were it opened again, this would be seen
    assert [v for _, v in sorted(got)] == TEXT.split("\n")[:-1] and len(before) == 2
    (log / "a.jsonl").write_bytes(b"new\nand torn \xff\n\xf0\x9f")
    found, now = growing.read(spark, f"file://{tmp_path}/log", before, "*.jsonl")
    assert [r.value for r in found.orderBy("start").collect()] == ["new", "and torn �"] and {k.split("/")[-1]: v for k, v in now.items()} == {"a.jsonl": 17, "same.jsonl": 5}
    assert growing.read(spark, str(tmp_path / "log"), now)[0].count() == 0 and growing.read(spark, str(tmp_path / "none"), {})[1] == {}


def test_many_tasks_read_one_file(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(20_000)))
    found, _ = growing.read(spark, str(tmp_path), {}, chunk=20_000)
    assert found.rdd.getNumPartitions() > 10 and sorted(json.loads(r.value)["n"] for r in found.collect()) == list(range(20_000))


def test_stream_resumes(spark, tmp_path):
    """A stream started anew goes on where it was, in the middle of a letter."""
    log, seen, raw = tmp_path / "in", [], '{"_kind": "turn", "turn_id": "é1"}\n{"_kind": "turn", "turn_id": "é2"}\n{torn\n'.encode()
    log.mkdir()
    second = raw.rindex("é".encode()) + 1
    for cut in (second, len(raw), len(raw)):
        (log / "a.jsonl").write_bytes(raw[:cut])
        ingest.stream_log(spark, str(log), lambda df, i: seen.append([json.loads(r.value)["turn_id"] for r in df.collect()]), str(tmp_path / "cp")).awaitTermination()
    assert [x for x in seen if x] == [["é1"], ["é2"]]


@pytest.mark.parametrize("chunk", [50, 10_000])
def test_lines_are_numbered_over_ranges(spark, tmp_path, chunk):
    """Whatever the ranges, line numbers are those of the whole file, empty lines and a last one without an end included; several tasks read a file."""
    texts = {"a.jsonl": TEXT, "b.jsonl": "one\n\ntwo\n", "c.jsonl": "\n", "d.jsonl": "no end"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "empty.jsonl").write_text("")
    rows = growing.numbered(spark, str(tmp_path), chunk)
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in rows.collect())
    want = sorted((n, i, x) for n, text in texts.items() for i, x in enumerate(text.removesuffix("\n").split("\n")))
    assert got == want
    if chunk == 50:
        tasks = rows.filter(F.col("file").endswith("a.jsonl")).select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 3
    assert growing.numbered(spark, str(tmp_path / "none")).count() == 0


def test_transcripts_by_ranges_as_whole(spark, tmp_path, monkeypatch):
    (tmp_path / "s1" / "subagents").mkdir(parents=True)
    (tmp_path / "s1.jsonl").write_text('{"x": 1}\n\n {torn é\n' + '{"x": "é😀"}\n' * 30 + '{"last": 1}')
    (tmp_path / "s1" / "subagents" / "y.jsonl").write_text('{"x": 2}\n')
    cols = ["session", "nested", "line", "row", "bad"]
    small, large = (sorted(map(tuple, logs.read_transcripts(spark, str(tmp_path), n).select(cols).collect())) for n in (60, 1 << 20))
    assert small == large and len(small) == 34 and sum(x[4] for x in small) == 1 and {x[0] for x in small} == {"s1"} and max(x[2] for x in small) == 33
    alone = [sorted(map(tuple, logs.read_transcripts(spark, str(tmp_path / x)).select("line", "row").collect())) for x in ("s1.jsonl", "s*.jsonl")]
    assert alone[0] == alone[1] == sorted((x[2], x[3]) for x in small if not x[1])
    monkeypatch.chdir(tmp_path.parent)  # Spark's readers know the folder in which the JVM began
    rel = os.path.relpath(tmp_path, spark._jvm.java.lang.System.getProperty("user.dir"))
    assert logs.read_transcripts(spark, rel).count() == 34


def test_packed_transcripts_as_plain(spark, tmp_path):
    """a packed transcript, of one member or several, has the session, line numbers and rows of the plain one, by ranges and by Spark's reader."""
    text = '{"x": 1}\n\n {torn é\n' + '{"x": "é😀"}\n' * 30 + '{"last": 1}'
    raw = text.encode()
    files = {"plain": {"s1.jsonl": raw}, "gz": {"s1.jsonl.gz": gzip.compress(raw[:100]) + gzip.compress(raw[100:])}, "bz2": {"s1.jsonl.bz2": bz2.compress(raw)}}
    got = {}
    for kind, own in files.items():
        (tmp_path / kind).mkdir()
        for name, content in own.items():
            (tmp_path / kind / name).write_bytes(content)
        for at in (str(tmp_path / kind), f"{tmp_path}/{kind}/s1*"):
            rows = logs.read_transcripts(spark, at, 60).select("session", "nested", "line", "row", "bad").collect()
            got[kind, at.endswith("*")] = sorted(map(tuple, rows))
    assert len(got["plain", False]) == 33 and all(x == got["plain", False] for x in got.values())


def test_sessions_are_stems_of_names(spark, tmp_path):
    stems = {"a.jsonl": "a", "a.b.jsonl": "a.b", "none": "none", "x.y": "x", "p.jsonl.gz": "p", "q.gz": "q", "é s.jsonl.bz2": "é s"}
    (tmp_path / "up.per").mkdir()
    for name in stems:
        raw = b'{"x": 1}'
        (tmp_path / "up.per" / name).write_bytes(gzip.compress(raw) if name.endswith(".gz") else bz2.compress(raw) if name.endswith(".bz2") else raw)
    got = logs.read_transcripts(spark, str(tmp_path)).select("session", "bad").collect()
    assert sorted(map(tuple, got)) == sorted((x, False) for x in stems.values())
