"""Operator 11: two tokenizers' tokens of a text, aligned by the bytes at which both end one.

Tokenizer A is a byte-level BPE (tokenizers file), B a BPE of pieces (sentencepiece model), which puts a space before the text; A gets
space + text. Of each text both lists of byte ends are intersected by galloping: the shorter list drives, each of its ends is looked for in
the longer from where the one before it was found, by doubling steps and then by halving. Lanes of LANE ends go side by side in arrays. The
common ends cut the tokens into groups, and the differences of their ranks say how many tokens of A and of B a group has.

A links with B inside a group. A group's links are counted by its different ids (ids times how often), never written out one by one, and a
document keeps each different pair of ids once, with its number of links. How many documents hold a pair is a count over all documents. The
pairs that more than a HOT-th of all pairs' rows fall on (fewer than HOT of them, whatever the input) are looked up in a broadcast table, so
no key of the join that serves the others has more than a HOT-th of the rows.

Both encoders keep what they know of pieces of text in caches bounded by bytes. B is asked about a run of spaces with the letters after it,
or a line end with those, for no piece of its vocabulary reaches over such a beginning; where one does (checked), or where a run doesn't come
back byte by byte, whole texts are encoded. The tokenizer of A has to be a byte-level BPE with the usual pattern and no normaliser: others
raise ValueError.

Null and empty texts, and those that either side doesn't give back byte by byte (a text with U+2581), have no tokens: zeros and ''. Rows that
repeat an id, or have none, are documents of their own. Other columns are left out, whatever their names. A very long text is a chunk of its
own, and its pairs are written in rows of PIECE at most. An empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import Cache, chunks, kept, prepared, texts

#: Bytes of text that a task aligns at once, unless one text alone is longer; bytes of each encoder's cache.
CHUNK, CACHED = 1_000_000, 60_000_000
#: Ends of the shorter list that a lane looks for; pairs of tokens of a group that are written out before they are counted.
LANE, SMALL = 64, 4096
#: Pairs in a row of the table; pairs that have a larger share of all rows than 1 / HOT are broadcast.
PIECE, HOT = 200_000, 100_000
SPACE = "▁"
SCHEMA = "row long, head boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def galloped(long: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each x the first place in the ascending list, from `at` on, whose value isn't below x; the list's last value isn't."""
    lo, hi, step, last = at.copy(), at.copy(), 1, len(long) - 1
    low = np.flatnonzero(long[hi] < x)
    while len(low):
        lo[low] = hi[low] + 1
        hi[low] = np.minimum(hi[low] + step, last)
        step *= 2
        low = low[long[hi[low]] < x[low]]
    wide = np.flatnonzero(lo < hi)
    while len(wide):
        mid = (lo[wide] + hi[wide]) >> 1
        below = long[mid] < x[wide]
        lo[wide[below]] = mid[below] + 1
        hi[wide[~below]] = mid[~below]
        wide = wide[lo[wide] < hi[wide]]
    return lo


def intersection(short: np.ndarray, long: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both ascending lists of their common values; first: a place in the longer from which each value of the shorter may be found."""
    n = len(short)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lanes, last = -(-n // LANE), len(long) - 1
    found = np.empty(n, np.int64)
    cursor = first[::LANE].copy()
    for j in range(LANE):
        k = np.arange(j, n, LANE)
        x = short[k]
        p = galloped(long, x, np.minimum(cursor[: len(k)], last))
        found[k] = p
        cursor[: len(k)] = p + (long[p] == x)
        if len(k) < lanes:
            cursor = cursor[: len(k)]
    both = np.flatnonzero(long[found] == short)
    return both, found[both]


class _A:
    """A's ids of pieces, special strings being plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cut = said.get("pre_tokenizer") or {}
        if said["model"].get("type") != "BPE" or said.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or said["model"].get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.merges, _ = bpe.from_merges(path)
        self.size = max(self.merges.vocabulary) + 1
        self.length = np.array([len(self.merges.vocabulary.get(i, b"")) for i in range(self.size)], np.int64)
        self.cache = Cache(CACHED)

    def encode(self, batch: list[str]) -> list[bytes]:
        cut = bpe.pieces(batch)
        if new := self.cache.missing(set().union(*cut)):
            ids, counts = self.merges.merged([w.encode() for w in new])
            packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            self.cache.add(new, [packed[a:b] for a, b in zip([0, *ends], ends)])
        return [b"".join(map(self.cache.__getitem__, words)) for words in cut]


class _B:
    """B's ids; b"" where a text doesn't come back."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        over = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.runs = None if over else re.compile(" +[^ \n]*|\n[^ \n]*").findall
        self.cache = Cache(CACHED)

    def _back(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def _asked(self, runs: list[str]) -> list[bytes]:
        """Ids of runs; b"" for those that don't come back. Before a line end the library puts a space of its own, which is taken off again."""
        out = []
        for run, ids in zip(runs, self.model.encode([r[r[0] == " " :] for r in runs], num_threads=1)):
            if run[0] != " " and ids and self.bytes[ids[0]] == b" ":
                ids = ids[1:]
            out.append(np.array(ids, "<u4").tobytes() if ids and self._back(ids) == run.encode() else b"")
        return out

    def _whole(self, spaced: str) -> bytes:
        ids = self.model.encode(spaced[1:], num_threads=1)
        return np.array(ids, "<u4").tobytes() if self._back(ids) == spaced.encode() else b""

    def encode(self, batch: list[str]) -> list[bytes]:
        """Each text begins with the space that the library adds."""
        if self.runs is None:
            return [self._whole(t) for t in batch]
        cut = [self.runs(t) for t in batch]
        if new := self.cache.missing(set().union(*cut)):
            self.cache.add(new, self._asked(new))
        out = []
        for text, runs in zip(batch, cut):
            ids = [self.cache[r] for r in runs]
            out.append(b"".join(ids) if all(ids) else self._whole(text))
        return out


class Aligned:
    """The groups of some texts that both tokenizers give back: flat ids, and of each group where its tokens end in both."""

    def __init__(self, ids_a: list[bytes], ids_b: list[bytes], length_a: np.ndarray, length_b: np.ndarray):
        self.a, self.b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (ids_a, ids_b))
        self.of_a, self.of_b = (np.array([len(x) // 4 for x in ids], np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(length_a[self.a]), np.cumsum(length_b[self.b])
        # bytes, and so ends, of all texts follow each other in both lists, and each text's last end is common
        first_a, first_b = np.cumsum(self.of_a) - self.of_a, np.cumsum(self.of_b) - self.of_b
        drives = self.of_a <= self.of_b
        by_a, by_b = np.repeat(drives, self.of_a), np.repeat(~drives, self.of_b)
        i, at_b = intersection(ends_a[by_a], ends_b, np.repeat(first_b, self.of_a)[by_a])
        j, at_a = intersection(ends_b[by_b], ends_a, np.repeat(first_a, self.of_b)[by_b])
        at_a, at_b = np.concatenate([np.flatnonzero(by_a)[i], at_a]), np.concatenate([at_b, np.flatnonzero(by_b)[j]])
        order = np.argsort(at_a)
        self.upto_a, self.upto_b, self.ends = at_a[order] + 1, at_b[order] + 1, ends_a[at_a[order]]
        self.n_a, self.n_b = np.diff(self.upto_a, prepend=0), np.diff(self.upto_b, prepend=0)
        self.doc = np.searchsorted(np.cumsum(self.of_a), self.upto_a)  # of each group

    def links(self) -> np.ndarray:
        out = np.zeros(len(self.of_a), np.int64)
        np.add.at(out, self.doc, self.n_a * self.n_b)
        return out

    def groups(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.of_a))

    def digests(self, names: list[bytes], size_a: int, size_b: int) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` of each text. names: A's ids with ',' then with '|', B's with ',' then with ';'."""
        group_a, group_b = np.repeat(np.arange(len(self.n_a)), self.n_a), np.repeat(np.arange(len(self.n_b)), self.n_b)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.upto_a - 1], last_b[self.upto_b - 1] = 1, 1
        line = np.empty(len(self.a) + len(self.b), np.int64)
        line[np.arange(len(self.a)) + (self.upto_b - self.n_b)[group_a]] = self.a + size_a * last_a
        line[np.arange(len(self.b)) + self.upto_a[group_b]] = 2 * size_a + self.b + size_b * last_b
        ends = np.cumsum(self.of_a + self.of_b).tolist()
        return [hashlib.sha256(b"".join(map(names.__getitem__, line[x:y].tolist()))[:-1]).hexdigest() for x, y in zip([0, *ends], ends)]

    def pairs(self, size_b: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each text: its number, its different pairs (a * size_b + b, ascending), and how many links each has."""
        n = self.n_a * self.n_b
        small = np.flatnonzero(n <= SMALL)
        group = np.repeat(small, n[small])
        k = np.arange(len(group)) - np.repeat(np.cumsum(n[small]) - n[small], n[small])
        begin_a, begin_b = self.upto_a - self.n_a, self.upto_b - self.n_b
        pair = self.a[begin_a[group] + k // self.n_b[group]] * size_b + self.b[begin_b[group] + k % self.n_b[group]]
        doc = self.doc[group]
        found, times, docs = [pair], [np.ones(len(pair), np.int64)], [doc]
        for g in np.flatnonzero(n > SMALL).tolist():  # by different ids and how often each occurs
            (x, many_x), (y, many_y) = (np.unique(ids[a:b], return_counts=True) for ids, a, b in ((self.a, begin_a[g], self.upto_a[g]), (self.b, begin_b[g], self.upto_b[g])))
            found.append((x[:, None] * size_b + y).ravel())
            times.append((many_x[:, None] * many_y).ravel())
            docs.append(np.full(len(found[-1]), self.doc[g]))
        pair, times, doc = map(np.concatenate, (found, times, docs))
        order = np.lexsort((pair, doc))
        pair, times, doc = pair[order], times[order], doc[order]
        new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])]) if len(pair) else np.zeros(0, np.int64)
        times, pair, doc = np.add.reduceat(times, new) if len(new) else times, pair[new], doc[new]
        cut = np.searchsorted(doc, np.arange(len(self.of_a) + 1)).tolist()
        for d, (x, y) in enumerate(zip(cut, cut[1:])):
            yield d, pair[x:y], times[x:y]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.A, self.B = _A(a_path), _B(b_path)
        self.names = [f"{i}{c}".encode() for size, marks in ((self.A.size, ",|"), (self.B.size, ",;")) for c in marks for i in range(size)]

    def encode(self, batch: list[str]) -> tuple[list[int], list[bytes], list[bytes]]:
        """Which texts have tokens, and their ids in A and B."""
        some = [i for i, t in enumerate(batch) if t]
        spaced = [f" {batch[i]}" for i in some]
        ids = list(zip(some, spaced, self.A.encode(spaced), self.B.encode(spaced))) if some else []
        ids = [(i, a, b) for i, t, a, b in ids if b and int(self.A.length[np.frombuffer(a, "<u4")].sum()) == len(t.encode())]
        return [x[0] for x in ids], [x[1] for x in ids], [x[2] for x in ids]

    def align(self, batch: list[str]) -> tuple[list[int], Aligned]:
        some, a, b = self.encode(batch)
        return some, Aligned(a, b, self.A.length, self.B.length)


@functools.cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    """One for all tasks of a worker."""
    return Aligner(a_path, b_path)


def _digested(a_path: str, b_path: str):
    schema = pa.schema([("row", pa.int64()), ("head", pa.bool_()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in chunks(batches, most=CHUNK):
            ids = batch["doc_id"].to_pylist()
            some, found = aligner.align(batch["text"].to_pylist())
            facts = list(zip(found.of_a.tolist(), found.of_b.tolist(), found.groups().tolist(), found.links().tolist(), found.digests(aligner.names, aligner.A.size, aligner.B.size)))
            rows, pairs, times = [], [], []
            for d, pair, n in found.pairs(aligner.B.size):
                for at in range(0, len(pair), PIECE):
                    rows.append((row + some[d], at == 0, ids[some[d]], *facts[d]))
                    pairs.append(pair[at : at + PIECE])
                    times.append(n[at : at + PIECE])
            for i in sorted(set(range(len(ids))).difference(some)):
                rows.append((row + i, True, ids[i], 0, 0, 0, 0, ""))
                pairs.append(np.zeros(0, np.int64))
                times.append(pairs[-1])
            row += len(ids)
            offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*rows), schema)), *lists], schema=schema)

    return run


def _spans(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for batch in chunks(batches, most=CHUNK):
            some, found = aligner.align(batch["text"].to_pylist())
            cut = np.searchsorted(found.doc, np.arange(len(some) + 1))
            lead = np.cumsum(found.of_a) - found.of_a, np.cumsum(found.of_b) - found.of_b
            begin = np.r_[0, found.ends[cut[1:] - 1]] if len(some) else np.zeros(1, np.int64)
            at = {d: i for i, d in enumerate(some)}
            out = {c: [] for c in ("a_ids", "b_ids", "ends", "upto_a", "upto_b")}
            for i in range(batch.num_rows):
                d = at.get(i)
                for c in out:
                    if d is None:
                        out[c].append([])
                    elif c in ("a_ids", "b_ids"):
                        ids, of, first = (found.a, found.of_a, lead[0]) if c == "a_ids" else (found.b, found.of_b, lead[1])
                        out[c].append(ids[first[d] : first[d] + of[d]])
                    else:
                        values, less = {"ends": (found.ends, begin), "upto_a": (found.upto_a, lead[0]), "upto_b": (found.upto_b, lead[1])}[c]
                        out[c].append(values[cut[d] : cut[d + 1]] - less[d])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.list_(pa.int64())) for x in out.values())], ["doc_id", *out])

    return run


def align(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids, and of each group where it ends: in bytes of space + text (ends), and in tokens of A and B (upto_a, upto_b). Empty arrays where a text has no tokens."""
    prepared(df.sparkSession)
    return texts(df).mapInArrow(_spans(a_path, b_path), "doc_id long, a_ids array<long>, b_ids array<long>, ends array<long>, upto_a array<long>, upto_b array<long>")


def links(df: DataFrame, a_path: str, b_path: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    prepared(df.sparkSession)
    aligned = kept(texts(df).mapInArrow(_digested(a_path, b_path), SCHEMA), "aligned")
    size_b = _size(b_path)
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    top = Window.partitionBy(F.floor(F.col("pair") / size_b))  # an id of A meets at most all ids of B
    counts = kept(counts.withColumn("best", F.col("n") == F.max("n").over(top)), "pair-counts")
    share = (counts.agg(F.sum("n")).first()[0] or 0) / hot
    often, rest = counts.filter(F.col("n") > share), counts.filter(F.col("n") <= share)  # fewer than `hot` have more than that share
    linked = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    held = linked.join(F.broadcast(often), "pair", "left")
    sums = [F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    known = held.filter("n is not null").groupBy("row").agg(*sums)
    others = held.filter("n is null").select("row", "pair", "times").join(rest, "pair").groupBy("row").agg(*sums)
    every = known.unionByName(others).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    docs = aligned.filter("head").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(every, "row", "left")
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", whole("n_best"), whole("count_sum"), "groups_sha256")


@functools.cache
def _size(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
