"""Operator 7: exact dedup by Patricia-trie owners.

Each input partition first inserts its normalised texts into a compressed radix trie, whose terminals keep the smallest id
and a count; so a text goes on once per partition, however many copies there are. Those terminals are dealt out by length and
content hash, and each owner inserts the full byte strings into a trie of its own. A trie over its memory bound writes its
largest subtree to an unnamed file that goes with the task, and works it off at the end by itself, again as a trie.
The owners' digests bring keep_id and group_size back to the rows; copies of a hot text are rows of a skewed join, which
Spark splits.

Null texts are empty texts, and equal to each other. A null doc_id is larger than any id: it is kept only where no equal text
has an id. Rows that repeat a doc_id with an equal text are all kept or all dropped, since
nothing that is returned tells them apart; the pipeline gives each row a key of its own first. A very long text goes on whole. Other
columns are left out, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, prepared, texts

#: Bytes of text that a task's trie holds in memory.
MOST = 96_000_000
LAST = 2**63 - 1


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """The first place from at on where a and b differ, or the end of the shorter."""
    low, high = at, min(len(a), len(b))
    step = 64
    while low < high:
        end = min(high, low + step)
        if a[low:end] == b[low:end]:
            low, step = end, step * 2
        elif end - low == 1:
            return low
        else:
            high, step = end, max(1, (end - low) // 2)
    return low


class Trie:
    """A compressed radix trie; a node is [label, children by first byte, id or None, count]."""

    def __init__(self):
        self.root: list = [b"", {}, None, 0]
        self.size = 0

    def insert(self, text: bytes, owner: int, n: int) -> None:
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, owner, n]
                self.size += end - at + 200
                return
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = common(text[at : at + len(label)], label)
            upper = [label[:same], {label[same]: child}, None, 0]
            child[0] = label[same:]
            node[1][text[at]] = upper
            self.size += 200
            node, at = upper, at + same
        node[2] = owner if node[2] is None else min(node[2], owner)
        node[3] += n

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        todo = [(b"", self.root)]
        while todo:
            before, node = todo.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, node[2], node[3]
            todo += [(text, x) for x in node[1].values()]


class Owners:
    """Tries by the two bytes after a prefix that all texts share, within a bound of memory."""

    HEAD = struct.Struct("<qqq")

    def __init__(self, most: int = MOST, depth: int = 0):
        self.most, self.depth, self.size = most, depth, 0
        self.parts: dict[bytes, Trie] = {}
        self.spilled: dict[bytes, list] = {}  # file, first text, bytes that all share

    def insert(self, text: bytes, owner: int, n: int) -> None:
        key = text[self.depth : self.depth + 2]
        if key in self.spilled:
            self._spill(key, text, owner, n)
            return
        part = self.parts.get(key)
        if part is None:
            part = self.parts[key] = Trie()
        before = part.size
        part.insert(text, owner, n)
        self.size += part.size - before
        if self.size > self.most and (len(self.parts) > 1 or part.size > 400 + 2 * len(text)):
            key = max(self.parts, key=lambda k: self.parts[k].size)
            part = self.parts.pop(key)
            self.size -= part.size
            self.spilled[key] = [tempfile.TemporaryFile(), None, 0]
            for x in part.terminals():
                self._spill(key, *x)

    def _spill(self, key: bytes, text: bytes, owner: int, n: int) -> None:
        s = self.spilled[key]
        if s[1] is None:
            s[1], s[2] = text, len(text)
        else:
            s[2] = min(s[2], common(s[1], text))
        s[0].write(self.HEAD.pack(len(text), owner, n) + text)

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        for part in self.parts.values():
            yield from part.terminals()
        self.parts.clear()
        for file, _, shared in self.spilled.values():
            below = Owners(self.most, shared)
            with file:
                file.seek(0)
                while head := file.read(self.HEAD.size):
                    size, owner, n = self.HEAD.unpack(head)
                    below.insert(file.read(size), owner, n)
            yield from below.terminals()
        self.spilled.clear()


KEY = [("n_bytes", pa.int64()), ("sha", pa.string())]
LOCAL = pa.schema([*KEY, ("body", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
OWNED = pa.schema([*KEY, ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _out(rows: Iterator[tuple], schema: pa.Schema, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += 60 + (len(r[2]) if isinstance(r[2], bytes) else 0)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), schema.types)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), schema.types)], schema=schema)


def _combine(most: int, last: bool):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = Owners(most)
        for batch in batches:
            n = batch["n"].to_pylist() if "n" in batch.schema.names else [1] * batch.num_rows
            for text, owner, k in zip(batch["body"].to_pylist(), batch["owner"].to_pylist(), n):
                tries.insert(text, owner, k)
        digest = ((len(t), hashlib.sha256(t).hexdigest(), t, o, n) for t, o, n in tries.terminals())
        if last:
            yield from _out(((a, b, None if o == LAST else o, n) for a, b, _, o, n in digest), OWNED)
        else:
            yield from _out(digest, LOCAL)

    return run


def normalised(text):
    """Each run of the contract's white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    prepared(df.sparkSession)
    rows = texts(df, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    first = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("owner"), F.col("norm").cast("binary").alias("body"))
    local = first.mapInArrow(_combine(most, False), "n_bytes long, sha string, body binary, owner long, n long")
    owners = local.repartition("n_bytes", "sha").select("body", "owner", "n").mapInArrow(_combine(most, True), "n_bytes long, sha string, keep_id long, group_size long")
    mine = rows.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").cast("long").alias("size"))
    owners = owners.select(F.col("sha").alias("text_sha256"), F.col("n_bytes").alias("size"), "keep_id", "group_size")
    return mine.join(owners, ["text_sha256", "size"], "left").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
