"""Operator 5: token ids as flat unsigned integer files with 64-bit document offsets.

The documents are dealt out by ranges of doc_id and sorted; each partition writes `NNNNN.ids` (ids of all its documents, one
after the other, in the smallest unsigned type that holds the vocabulary), `NNNNN.idx` (64-bit: where each document's ids
begin, and the end) and `NNNNN.doc` (64-bit doc_ids). The partitions' sizes, a row each, give every partition's base by prefix
sums. Readers map the files.

Ids come from the tokenizers library. White space is never part of a piece of this vocabulary and nothing is normalised or merged
across it, so a text of Latin-1 letters, whose normal form is itself but for case, is cut into the vocabulary's own pieces, and the
library is given each different piece once, many in one call: the last id of a piece is marked as a word's end. Other runs, and
those that may hold a special token, go to the library as they are. What it said is kept in a cache bounded by bytes. A
tokenizer whose file says that it cuts otherwise is given whole texts.

Null texts are empty and hold the end id alone. Null doc_ids come first; rows of equal doc_id are ordered by the beginning of
their text, then as they came, and so a doc_id that many rows share is spread over many files. A very long text is a chunk of its
own. Other columns are left out, whatever their names. An empty table writes no file and reads back as an empty one.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .bpe import WHITE
from .common import Cache, chunks, prepared, scratch, texts

NO_ID = -(2**63)
_WHITE = re.compile("[" + "".join(map(chr, WHITE)) + "]+")
#: This vocabulary's pieces, written out for lower-case Latin-1.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+").findall
#: Marks a run that the library has to see as it is; no text holds it.
_WHOLE = "\ud800"


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces(text: str) -> list[str]:
    """What the library may be asked about piece by piece."""
    if "<|" not in text and _latin(text):
        return _PIECES(text.lower())
    out = []
    for run in _WHITE.split(text):
        if "<|" in run or not _latin(run):
            out.append(_WHOLE + run)
        else:
            out += _PIECES(run.lower())
    return out


#: How a vocabulary's file says that texts are cut as pieces() cuts them.
_NORMALISED = ["NFC", "Replace", "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def cut_alike(path: str) -> bool:
    """Whether a tokenizer drops white space, lowers case and cuts words as pieces() does, so that it may be asked about pieces."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    normal, cuts = ((said.get(k) or {}).get(part) or [] for k, part in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    return (
        [n["type"] for n in normal] == _NORMALISED and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": "\\s+"}, " ")
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _SPLIT} and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"] and said["model"].get("end_of_word_suffix") == "</w>" and all(t["content"].startswith("<|") for t in said["added_tokens"])
    )


class Encoder:
    def __init__(self, path: str, dtype: str, end_id: int):
        self.library, self.cuts = _library(path), cut_alike(path)
        self.dtype, self.end = np.dtype(dtype), np.array([end_id], dtype).tobytes()
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.cache = Cache()

    def _one_by_one(self, runs: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(runs, add_special_tokens=False)]

    def _together(self, new: list[str], at_once: int = 64) -> list[bytes]:
        lines = [" ".join(new[k : k + at_once]) for k in range(0, len(new), at_once)]
        ids = [e.ids for e in self.library.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.fromiter((i for x in ids for i in x), self.dtype)
        until = ((np.flatnonzero(self.ends[flat]) + 1) * self.dtype.itemsize).tolist()
        if len(until) != len(new):
            return self._one_by_one(new)
        packed = flat.tobytes()
        return [packed[a:b] for a, b in zip([0, *until], until)]

    def encode(self, batch: list[str]) -> list[bytes]:
        if not self.cuts:
            return [ids + self.end for ids in self._one_by_one(batch)]
        cut = [pieces(t) for t in batch]
        if new := self.cache.missing(set().union(*cut)):
            whole = [w for w in new if w[0] == _WHOLE]
            plain = [w for w in new if w[0] != _WHOLE]
            self.cache.add(whole, self._one_by_one([w[1:] for w in whole]))
            self.cache.add(plain, self._together(plain))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) + self.end for words in cut]


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _encoder(path: str, dtype: str, end_id: int) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, dtype, end_id)


def _write(path: str, target: str, dtype: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        at, offsets, ids = 0, [0], []
        name = f"{target}/{shard:05d}"
        batches = chunks(batches)
        first = next(batches, None)
        if first is None:
            return
        coder = _encoder(path, dtype, end_id)
        with files.whole(f"{name}.ids") as put:
            while first is not None:
                for packed in coder.encode(first["text"].to_pylist()):
                    put(packed)
                    at += len(packed) // coder.dtype.itemsize
                    offsets.append(at)
                ids.append(first["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False))
                first = next(batches, None)
        with files.whole(f"{name}.idx") as put:
            put(np.array(offsets, "<i8").tobytes())
        with files.whole(f"{name}.doc") as put:
            put(np.concatenate(ids).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(offsets) - 1], "n_tokens": [at]}, pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return run


def write(df: DataFrame, path: str, end_id: int = 1, target: str | None = None) -> dict:
    """Write the files of df's texts. Returns where they are, the type, and a row (shard, n_docs, n_tokens, base) for each partition."""
    spark = prepared(df.sparkSession)
    target = target or scratch(spark, "token-files")
    dtype = "<u2" if max(_library(path).get_vocab_size() - 1, end_id) < 2**16 else "<u4"
    order = ["doc_id", F.substring("text", 1, 64), F.monotonically_increasing_id()]
    keyed = texts(df).select("doc_id", "text", *(c.alias(f"k{i}") for i, c in enumerate(order[1:])))
    ordered = keyed.repartitionByRange("doc_id", "k0", "k1").sortWithinPartitions("doc_id", "k0", "k1").select("doc_id", "text")
    shards = sorted(map(tuple, ordered.mapInArrow(_write(path, target, dtype, end_id), "shard long, n_docs long, n_tokens long").collect()))
    base = np.cumsum([0, *(s[2] for s in shards)]).tolist()
    return {"target": target, "dtype": dtype, "shards": [(*s, b) for s, b in zip(shards, base)]}


def _read(target: str, dtype: str, most: int = 1 << 21):
    """Documents are read in blocks of so many ids, or one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch["shard"].to_pylist(), batch["base"].to_pylist()):
                ids, offsets, docs = (files.mapped(f"{target}/{shard:05d}.{x}", d) for x, d in (("ids", dtype), ("idx", "<i8"), ("doc", "<i8")))
                at, doc = offsets[: len(offsets)], docs[: len(docs)]
                a = 0
                while a < len(doc):
                    b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
                    wide = memoryview(ids[int(at[a]) : int(at[b])].astype("<u4")).cast("B")
                    cut = ((at[a : b + 1] - at[a]) * 4).tolist()
                    crc = [zlib.crc32(wide[x:y]) for x, y in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[a:b], mask=doc[a:b] == NO_ID), pa.array(at[a:b] + base), pa.array(np.diff(at[a : b + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    a = b

    return run


def read(spark: SparkSession, written: dict) -> DataFrame:
    """doc_id, start (in ids of all documents), n_tokens, ids_crc32 of each document, from the files alone."""
    prepared(spark)
    rows = [(s, b) for s, _, _, b in written["shards"]]
    at = spark.createDataFrame(rows, "shard long, base long").repartition(max(1, len(rows)))
    return at.mapInArrow(_read(written["target"], written["dtype"]), "doc_id long, start long, n_tokens long, ids_crc32 long")
