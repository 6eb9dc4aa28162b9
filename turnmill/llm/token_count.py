"""Operator 4: token counts by rank-synchronous merging in arrays.

The pieces of a chunk of texts are ragged arrays; in each round every sequence applies its own lowest-rank pair, all at once,
and the symbols that are left are counted. The counts of pieces seen before are kept in a bounded cache. Special strings
inside a text count as one token each, as the library's default has it, and no merge crosses them. No shuffle.

Nulls are empty texts with 0 tokens; repeated rows and null ids pass through, other columns are left out, whatever their names. A very
long text is a chunk of its own. An empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import Cache, chunks, prepared, raw, texts


class Counter:
    def __init__(self, path: str):
        self.merges, self.special = bpe.from_merges(path)
        self.cache = Cache()

    def _apart(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of those there are; at each place the first that fits is taken."""
        parts, found = [text], 0
        for s in self.special:
            parts = [x for p in parts for x in p.split(s)]
        found = len(parts) - 1
        return parts, found

    def count(self, batch: list[str]) -> list[int]:
        flat: list[str] = []
        extra, spans = [], []
        for t in batch:
            parts, found = self._apart(t)
            spans.append((len(flat), len(flat) + len(parts)))
            flat += parts
            extra.append(found)
        cut = bpe.pieces(flat)
        cache = self.cache
        if new := cache.missing(set().union(*cut)):
            cache.add(new, self.merges.merged([w.encode() for w in new])[1].tolist())
        sums = [sum(map(cache.__getitem__, words)) for words in cut]
        return [sum(sums[a:b]) + x for (a, b), x in zip(spans, extra)]


@functools.cache
def _counter(path: str) -> Counter:
    """One for all tasks of a worker."""
    return Counter(path)


def _counted(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in chunks(batches):
            n = np.array(counter.count(batch["text"].to_pylist()), np.int64)
            _, at = raw(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(df: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each text, by the tokenizers file at path."""
    prepared(df.sparkSession)
    return texts(df).mapInArrow(_counted(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
