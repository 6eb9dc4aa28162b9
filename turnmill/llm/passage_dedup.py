"""Operator 10 by words: repeated passages of MIN_WORDS words or more, wherever in a line they begin or end; later copies are deleted.

A text is the sequence of its words (maximal runs without white space), compared byte by byte through 64-bit hashes. Every passage of
so many words that another place repeats is covered by its windows of exactly min_words words, so these are what is looked for: a
window, by a 128-bit hash of its words, is deleted if an equal one is earlier, by doc_id, then by text hash, then by word. The first
copy of a window always stays, but copies may overlap it, as runs of lines may.

Not all windows are shuffled. Equal windows have the same least hash among their runs of half as many words, so first these least
hashes are counted, and then only windows whose own occurs at two places or more go on; no repeated window is left out by that.

Null and empty texts have no words and never change. Null ids come after all others; rows that repeat both id and text fare alike. A
deleted stretch takes along the white space up to the next word that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, kept, mixed, prepared, raw, refuse, unused, words
from .line_dedup import MIN_WORDS, _documents, _uid

_KEY = ["doc_id", "uid"]
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _rolled(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of each run of so many words, wherever it stands."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    powers, back = np.full(len(h), base, np.uint64), np.full(len(h), pow(base, -1, 2**64), np.uint64)
    powers[0] = back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.multiply.accumulate(powers), dtype=np.uint64)])
    return mixed((sums[size:] - sums[:-size]) * np.multiply.accumulate(back)[: len(h) - size + 1])


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each so many neighbours."""
    out, n = h, 1
    while 2 * n <= size:
        out, n = np.minimum(out[:-n], out[n:]), 2 * n
    return np.minimum(out[: len(out) - (size - n)], out[size - n :]) if size > n else out


def _each(batches: Iterator[pa.RecordBatch], size: int):
    """(batch, row, word hashes, hashes of runs of half the size, the least of these in each window) of texts with a window at least."""
    half = max(1, size // 2)
    for batch in chunks(batches):
        _, _, h, first = words(*raw(batch["text"]), lower=False)
        for i in np.flatnonzero(np.diff(first) >= size).tolist():
            own = h[first[i] : first[i + 1]]
            runs = _rolled(own, half, _BASES[0])
            yield batch, i, own, runs, _least(runs, size - half + 1)


def _signs(size: int):
    """(doc_id, uid, sign, n): the windows' least hashes of each document and how often it has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, _, runs, least in _each(batches, size):
            signs = np.unique(least)
            values, n = np.unique(runs, return_counts=True)
            n = n[np.searchsorted(values, signs)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(signs), batch["doc_id"][i].as_py())), pa.array(np.full(len(signs), batch["uid"][i].as_py())), pa.array(signs.view(np.int64)), pa.array(n.astype(np.int64))], [*_KEY, "sign", "n"])

    return run


def _windows(size: int):
    """(doc_id, uid, at, a, b): the first word and hash of each window with a sign that repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, own, _, least in _each(batches, size):
            at = np.flatnonzero(np.isin(least.view(np.int64), batch["signs"][i].values.to_numpy()))
            a, b = (_rolled(x, size, base)[at].view(np.int64) for x, base in zip((own, mixed(own ^ np.uint64(_BASES[1]))), _BASES))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch["doc_id"][i].as_py())), pa.array(np.full(len(at), batch["uid"][i].as_py())), pa.array(at.astype(np.int32)), pa.array(a), pa.array(b)], [*_KEY, "at", "a", "b"])

    return run


def repeated(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, uid, at: the first words (ascending from 0) of a document's windows that an earlier one equals."""
    prepared(df.sparkSession)
    docs = _documents(df, id_col, text_col)
    signs = kept(docs.mapInArrow(_signs(min_words), "doc_id long, uid long, sign long, n long"), "signs").distinct()  # rows that repeat id and text are one
    hot = signs.groupBy("sign").agg(F.sum("n").alias("n")).filter("n > 1").select("sign")
    some = signs.join(hot, "sign").groupBy(_KEY).agg(F.collect_list("sign").alias("signs"))
    found = docs.join(some, _KEY).mapInArrow(_windows(min_words), "doc_id long, uid long, at int, a long, b long")
    found = kept(found, "windows")
    own = F.struct(*_KEY, "at")
    first = found.groupBy("a", "b").agg(F.min(own).alias("first"), F.max(own).alias("last")).filter("first < last").select("a", "b", "first")
    later = found.join(first, ["a", "b"]).filter(own > F.col("first"))
    return later.groupBy(_KEY).agg(F.array_sort(F.collect_set("at")).alias("at"))


def _cut(size: int, text_col: str, at_col: str):
    """The batches with __words, __removed and what is left of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            data, offsets = raw(batch[text_col])
            starts, ends, _, first = words(data, offsets, lower=False)
            base, left, spans = int(offsets[0]), [], []
            for i, at in enumerate(batch[at_col]):
                text = batch[text_col][i].as_py()
                if at.is_valid:
                    s, e = starts[first[i] : first[i + 1]] + base - offsets[i], ends[first[i] : first[i + 1]] + base - offsets[i]
                    at = at.values.to_numpy()
                    cut = np.flatnonzero(np.diff(at) > size) + 1  # spans that touch are one
                    pairs = list(zip(at[np.r_[0, cut]].tolist(), (at[np.r_[cut - 1, len(at) - 1]] + size).tolist()))
                    own, out, now = text.encode(), [], 0
                    for a, b in pairs:
                        out.append(own[now : s[a]])
                        now = s[b] if b < len(s) else e[-1]
                    text = b"".join([*out, own[now:]]).decode()
                    spans.append([f"{a}-{b - 1}" for a, b in pairs])
                else:
                    spans.append([])
                left.append(text)
            names = [n for n in batch.schema.names if n != at_col]
            columns = [pa.array(left, pa.string()) if n == text_col else batch[n] for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first).astype(np.int64)), pa.array(spans, pa.list_(pa.string()))], [*names, "__words", "__removed"])

    return run


def dedup(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with __words (how many each text had), __removed (first and last word of each stretch that went) and the rest as its text. A column of df that has one of these names is refused with ValueError."""
    refuse(df, "__words", "__removed")
    i, u, p = (unused(df.columns, x) for x in ("__id", "__uid", "__at"))
    gone = repeated(df, min_words, id_col, text_col).select(F.col("doc_id").alias(i), F.col("uid").alias(u), F.col("at").alias(p))
    own = (F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)) == F.col(i)) & (_uid(F.coalesce(F.col(text_col), F.lit(""))) == F.col(u))
    rows = df.join(gone, own, "left").drop(i, u)
    schema = T.StructType([*df.schema, T.StructField("__words", T.LongType()), T.StructField("__removed", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(_cut(min_words, text_col, p), schema)


def digest(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, removed (stretches as first-last, comma-separated), text_sha256 of what is left, for every row."""
    out = dedup(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words)
    return out.select("doc_id", F.col("__words").alias("n_words"), F.array_join("__removed", ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
