"""Logs that grow, as a data source of byte ranges, in batch and as a stream (S-3, R-1), and files with numbered lines (S-5).

A position is how many bytes of a file have been seen, a torn last line included. A line belongs to the range that holds its line end, and whoever
reads that range goes back to where the line begins, so that ranges may be cut anywhere, also inside a line or a letter: a line is read once, when its
end is there, by the task whose range the end lies in. Only files that have grown since the position are opened, and of these only the bytes
after it (and the line that was torn there). A file that became shorter is read anew.

Sizes come from listing the folder on the driver, a row for each file. A large file is cut into ranges of `chunk` bytes, a task each, or, where these are
more than TASKS, a task for several, of at most CHUNK bytes together; a task holds BLOCK bytes and the line that it is in. Folders are those that pyarrow opens by URI: local ones, HDFS, object stores.
"""

from __future__ import annotations

import fnmatch
import json
import sys
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, start long, value string"
BLOCK, CHUNK = 1 << 20, 128 << 20
#: How far a range first goes back for the begin of its line, twice as far each time that isn't far enough.
BACK = 1 << 10
#: So many ranges are a task each.
TASKS = 256
#: Endings of packed files with numbered lines, which are unpacked as they are read, and so by one task each.
PACKED = {".gz": "gzip", ".bz2": "bz2"}
#: Ranges whose numbers of lines may be broadcast: with chunks of 128 MB, those of 128 TB in files larger than that.
SENT = 1_000_000


def opened(uri: str) -> tuple[pfs.FileSystem, str, str]:
    """A folder's or file's file system, its path there, and what stands before paths in names of files."""
    if "://" not in uri or uri.startswith("file:"):
        return pfs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/"), "file:"
    fs, path = pfs.FileSystem.from_uri(uri)
    return fs, path, uri.rstrip("/").removesuffix(path)


def sizes(folder: str, pattern: str = "*") -> dict[str, int]:
    """File to size, for all files below the folder whose name fits. Opens none."""
    fs, path, lead = opened(folder)
    found = fs.get_file_info(pfs.FileSelector(path, recursive=True, allow_not_found=True))
    return {lead + f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.is_file and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_"))}


def grown(now: dict[str, int], before: dict[str, int], chunk: int = CHUNK) -> list[tuple[str, int, int]]:
    """Ranges (file, from, to) of what came after the positions."""
    out = []
    for file, size in sorted(now.items()):
        at = before.get(file, 0)
        at = 0 if at > size else at
        out += [(file, a, min(size, a + chunk)) for a in range(at, size, chunk)]
    return out


def lines(handle, first: int, end: int, block: int = BLOCK, last: bool = False) -> Iterator[tuple[list[int], list[bytes]]]:
    """Places and bytes of the lines whose ends lie in [first, end); if it is the file's last range, also of a line without an end."""
    before, at, step = [], first, min(BACK, block)
    while at > 0:  # the line that was begun
        n, step = min(step, at), min(2 * step, block)
        handle.seek(at - n)
        part = handle.read(n)
        k = part.rfind(b"\n")
        before.append(part[k + 1 :])
        at -= n
        if k >= 0:
            break
    held, start = before[::-1], first - sum(map(len, before))
    if first:  # a stream that is unpacked can't seek
        handle.seek(first)
    while first < end and (part := handle.read(min(block, end - first))):
        first += len(part)
        new = part.split(b"\n")
        if len(new) > 1:
            new[0] = b"".join([*held, new[0]])
            held, places = [new.pop()], []
            for line in new:
                places.append(start)
                start += len(line) + 1
            yield places, new
        else:
            held.append(part)
    if last and (rest := b"".join(held)):
        yield [start], [rest]


def packing(file: str) -> str | None:
    return next((kind for end, kind in PACKED.items() if file.endswith(end)), None)


def _text(found: list[bytes]) -> pa.Array:
    try:
        return pa.array(found, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # what is no UTF-8 is replaced
        return pa.array([x.decode("utf-8", "replace") for x in found], pa.string())


def _read(ranges: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
    """A file's ranges, neighbours in the list, are read from one handle; their lines go out together, a block at a time."""
    for file, own in groupby(ranges, lambda r: r[0]):
        fs, path, _ = opened(file)
        with fs.open_input_file(path) as handle:
            at, held, size = [], [], 0
            for _, first, end in own:
                for places, found in lines(handle, first, end):
                    at.extend(places)
                    held.extend(found)
                    size += sum(map(len, found))
                    if size >= BLOCK:
                        yield _batch(file, at, held)
                        at, held, size = [], [], 0
            if held:
                yield _batch(file, at, held)


def _batch(file: str, places: list[int], found: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file, pa.string()), len(found)), pa.array(places, pa.int64()), _text(found)], ["file", "start", "value"])


def bundled(ranges: list[tuple[str, int, int]], chunk: int) -> list[list[tuple[str, int, int]]]:
    """The ranges of each task: one, or some neighbours of at most CHUNK bytes together where there are more than TASKS."""
    n = min(-(-len(ranges) // TASKS), max(1, CHUNK // chunk))
    return [ranges[i : i + n] for i in range(0, len(ranges), max(1, n))]


class Range(InputPartition):
    def __init__(self, file: str, first: int, end: int, last: bool = False):
        self.file, self.first, self.end, self.last = file, first, end, last


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class GrowingReader(DataSourceReader):
    """Reads the ranges that the option names, or the whole folder."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Ranges]:
        said, chunk = self.options.get("ranges"), int(self.options.get("chunk", CHUNK))
        return [Ranges(r) for r in bundled(json.loads(said) if said else grown(sizes(self.options["path"], self.options.get("pattern", "*")), {}, chunk), chunk)]

    def read(self, part: Ranges | None) -> Iterator[pa.RecordBatch]:
        if part is not None:  # no ranges are one empty part
            yield from _read(part.ranges)


class GrowingStream(DataSourceStreamReader):
    """The stream's own offsets are the positions."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes(self.options["path"], self.options.get("pattern", "*"))

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        chunk = int(self.options.get("chunk", CHUNK))
        return [Ranges(r) for r in bundled(grown(end, start, chunk), chunk)]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        yield from _read(part.ranges)


class GrowingLog(DataSource):
    """file, start (the line's first byte), value of each line. Options: path, pattern, chunk (bytes of a range), and in batch ranges (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GrowingReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingStream(dict(self.options))


class NumberedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Range]:
        return [Range(*r) for r in json.loads(self.options["ranges"])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, path, _ = opened(part.file)
        with fs.open_input_file(path) as handle:
            if "count" in self.options:
                handle.seek(part.first)
                at, n = part.first, 0
                while at < part.end and (found := handle.read(min(BLOCK, part.end - at))):
                    at, n = at + len(found), n + found.count(b"\n")
                yield pa.RecordBatch.from_pydict({"file": [part.file], "first": [part.end], "n": [n]}, pa.schema([("file", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))
                return
            n, kind = 0, packing(part.file)
            source, end = (pa.CompressedInputStream(handle, kind), sys.maxsize) if kind else (handle, part.end)
            for _, found in lines(source, part.first, end, last=part.last):
                own = [pa.array([part.file] * len(found), pa.string()), pa.array([part.first] * len(found), pa.int64()), pa.array(range(n, n + len(found)), pa.int64()), _text(found)]
                yield pa.RecordBatch.from_arrays(own, ["file", "first", "n", "value"])
                n += len(found)


class NumberedLines(DataSource):
    """file, first (where the line's range begins), n (the line's number in it), value. Options: ranges (JSON), and count, which gives the range's number of lines instead, by the end of the range."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "file string, first long, n long" + ("" if "count" in self.options else ", value string")

    def reader(self, schema) -> DataSourceReader:
        return NumberedReader(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    spark.dataSource.register(GrowingLog)
    spark.dataSource.register(NumberedLines)
    return spark


def read(spark: SparkSession, path: str, before: dict[str, int], pattern: str = "*", chunk: int = CHUNK) -> tuple[DataFrame, dict[str, int]]:
    """The lines whose ends came after the positions, and the positions now. What is read is settled here: a file that grows later changes neither."""
    now = sizes(path, pattern)
    new = grown(now, before, chunk)
    if not new:
        return spark.createDataFrame([], SCHEMA), now
    return registered(spark).read.format("growing_log").option("ranges", json.dumps(new)).option("chunk", chunk).load(), now


def stream(spark: SparkSession, path: str, pattern: str = "*", chunk: int = CHUNK) -> DataFrame:
    return registered(spark).readStream.format("growing_log").option("path", path).option("pattern", pattern).option("chunk", chunk).load()


def numbered(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """file, line (from 0), value of every line below a folder, a last one without an end and empty ones included. A file of more than `chunk` bytes is read by several tasks, a packed one (PACKED) by one.

    A line's number is its number in its range and the prefix sum of the numbers of lines in its file's ranges before, for which these ranges are read once more; a file of one range needs none. The ranges are settled here, so that a task that runs again cuts alike."""
    found = sizes(path)
    plain = {file: size for file, size in found.items() if not packing(file)}
    ranges = [(file, first, end, end == found[file]) for file, first, end in grown(plain, {}, chunk)]
    ranges += [(file, 0, size, True) for file, size in found.items() if file not in plain]
    if not ranges:
        return spark.createDataFrame([], "file string, line long, value string")
    source = lambda some, **more: registered(spark).read.format("numbered_lines").options(ranges=json.dumps(some), **more).load()
    rows, early = source(ranges), [r for r in ranges if not r[3]]
    if not early:
        return rows.select("file", F.col("n").alias("line"), "value")
    before = source(early, count="true").select("file", "first", F.sum("n").over(Window.partitionBy("file").orderBy("first")).alias("__base"))
    before = F.broadcast(before) if len(early) <= SENT else before
    return rows.join(before, ["file", "first"], "left").select("file", (F.col("n") + F.coalesce("__base", F.lit(0))).alias("line"), "value")
