"""Operator 1: byte-level BPE encoding and decoding.

Pieces come from the scan in bpe.py; each different piece is merged once for all its occurrences in a chunk and kept in a
bounded cache as packed ids. Offsets say where in the text's bytes each id begins; decoding needs the ids alone and gives the
same offsets. There is no shuffle: every stage is a map over the input's partitions.

Nulls are empty texts; an empty text has no ids, empty digests are those of no bytes. Repeated rows and null ids pass through,
other columns of the input are left out, whatever their names. A very long text is a chunk of its own. An empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import Cache, chunks, prepared, texts


class Encoder:
    def __init__(self, path: str):
        self.merges = bpe.from_ranks(path)
        self.cache = Cache()
        size = max(self.merges.vocabulary) + 1
        words = [self.merges.vocabulary.get(i, b"") for i in range(size)]
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Of each text the ids, packed as little-endian unsigned 32-bit integers."""
        cut = bpe.pieces(batch)
        cache = self.cache
        if new := cache.missing(set().union(*cut)):
            ids, counts = self.merges.merged([w.encode() for w in new])
            packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            cache.add(new, [packed[a:b] for a, b in zip([0, *ends], ends)])
        return [b"".join(map(cache.__getitem__, words)) for words in cut]

    def decode(self, packed: bytes) -> tuple[bytes, np.ndarray]:
        """The bytes, and where each id's bytes begin."""
        ids = np.frombuffer(packed, "<u4")
        length = self.length[ids]
        offsets = np.cumsum(length) - length
        return self.bytes[np.repeat(self.start[ids] - offsets, length) + np.arange(int(length.sum()))].tobytes(), offsets


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path)
        for batch in chunks(batches):
            ids = coder.encode(batch["text"].to_pylist())
            offsets = [coder.decode(x)[1].astype("<i8").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())], ["doc_id", "n_tokens", "ids", "offsets"])

    return run


def encode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed unsigned 32-bit) and offsets (packed 64-bit: the first byte of each id) of each text."""
    prepared(df.sparkSession)
    return texts(df).mapInArrow(_encoded(path), "doc_id long, n_tokens long, ids binary, offsets binary")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path)
        for batch in batches:
            out = [coder.decode(x or b"")[0] for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return run


def decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded (bytes) from encode()'s ids."""
    prepared(df.sparkSession)
    return df.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, decoded binary")


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in chunks(batches):
            ids = coder.encode(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(coder.decode(x)[0]) for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """encode() and decode() in one pass, of which only counts and digests leave the task."""
    prepared(df.sparkSession)
    return texts(df).mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
