"""Which of many phrases stand in which texts (J-11), found where the text is read: nothing of a text is sent but what a filter takes for a phrase."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: Bytes up to which phrases are looked for at every place of a text; longer ones only where their first HEAD bytes may stand. Bytes of text and of windows in hand at once (a text or a window more at most).
HEAD, CHUNK, GATHER = 64, 1 << 16, 1 << 23
#: Bits of the filter for each phrase and, as powers of two, at least and in all (beyond that it lets more through, and a join does the rest); bits that a phrase sets; bits of a Spark bitmap.
EACH, BITS, PROBES, BITMAP = 32, (15, 28), 8, 32_768

_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN, _MIX, _LEN = (np.uint64(x) for x in (_BASE, pow(_BASE, -1, 1 << 64), 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BYTES = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of bytes times powers, and the powers' inverses, by which the hash of any window is one difference."""
    powers = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(data.size, x)]))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * powers(_UP)[:-1])]), powers(_DOWN)


def _mixed(h: np.ndarray, n) -> np.ndarray:
    """n: the windows' length, 0 for the head of a longer phrase."""
    h = ((h ^ (h >> np.uint64(32))) + np.asarray(n, np.uint64) * _LEN) * _MIX
    return h ^ (h >> np.uint64(29))


def _probe(h: np.ndarray, k: int, mask: np.uint64) -> np.ndarray:
    return (h + np.uint64(k) * ((h >> np.uint64(17)) | np.uint64(1)) if k else h) & mask


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    return np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1], np.frombuffer(data or b"", np.uint8)


def _bits(mask: int):
    """The filter's bits that phrases set, those of their heads included."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                offsets, data = _parts(batch.column(0))
                sums, down = _sums(data[offsets[0] : offsets[-1]])
                a, b = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
                h = _mixed((sums[b] - sums[a]) * down[a], b - a)
                a = a[b - a > HEAD]
                h = np.concatenate([h, _mixed((sums[a + HEAD] - sums[a]) * down[a], 0)])
                for k in range(PROBES):
                    yield pa.RecordBatch.from_arrays([pa.array(_probe(h, k, np.uint64(mask)).astype(np.int64))], ["bit"])

    return run


def _filter(phrases: DataFrame, mask: int) -> np.ndarray:
    """The filter, put together of bitmaps that tasks make: (mask + 1) / 8 bytes."""
    bit = phrases.mapInArrow(_bits(mask), "bit long")
    maps = bit.groupBy(F.shiftright("bit", BITMAP.bit_length() - 1).alias("map")).agg(F.bitmap_construct_agg(F.col("bit") % BITMAP).alias("bits"))
    flags = np.zeros((mask + 1) // 8, np.uint8)
    for r in maps.collect():
        flags[r["map"] * BITMAP // 8 : (r["map"] + 1) * BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    return flags


def _passing(flags: np.ndarray, h: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Places (those in at, or all) whose hash the filter lets through."""
    mask = np.uint64(flags.size * 8 - 1)
    for k in range(PROBES):
        p = _probe(h, k, mask)
        ok = np.flatnonzero((flags[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
        h, at = h[ok], ok if at is None else at[ok]
    return at


def _different(starts: np.ndarray, data: np.ndarray, at: np.ndarray, n: int) -> pa.Table:
    """Each text (row) and window of n bytes at one of the places, once; starts: the texts' and the end."""
    row = np.searchsorted(starts, at, "right") - 1
    whole = at + n <= starts[row + 1]
    row, at = row[whole], at[whole]
    step, some = max(1, GATHER // n), []
    for i in range(0, at.size, step):
        own = at[i : i + step]
        taken = data[(own[:, None] + np.arange(n)).ravel()]
        keys = pa.Array.from_buffers(pa.binary(), own.size, [None, pa.py_buffer(np.arange(own.size + 1, dtype=np.int32) * np.int32(n)), pa.py_buffer(taken)])
        some.append(pa.table({"row": row[i : i + step], "key": keys}).group_by(["row", "key"]).aggregate([]))
    if len(some) > 1:
        some = [pa.concat_tables(some).group_by(["row", "key"]).aggregate([])]
    return some[0] if some else pa.table({"row": pa.array([], pa.int64()), "key": pa.array([], pa.binary())})


def _windows(flags, lengths: list[int]):
    """For each row (its text last) the windows that the filter lets through, with the row's other columns."""

    def run(batches):
        seen = flags.value
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, all_ = _parts(batch.column(batch.num_columns - 1))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
                starts, data = offsets[a : b + 1] - offsets[a], all_[offsets[a] : offsets[b]]
                sums, down = _sums(data)
                heads = None
                for n in (n for n in lengths if n <= data.size):
                    if n <= HEAD:
                        at = _passing(seen, _mixed((sums[n:] - sums[:-n]) * down[: sums.size - n], n))
                    else:
                        if heads is None:
                            heads = _passing(seen, _mixed((sums[HEAD:] - sums[:-HEAD]) * down[: sums.size - HEAD], 0))
                        at = heads[heads + n <= data.size]
                        at = _passing(seen, _mixed((sums[at + n] - sums[at]) * down[at], n), at)
                    if at.size:
                        found = _different(starts, data, at, n).combine_chunks()
                        rows = pa.array(found["row"].to_numpy() + a)
                        if len(rows):
                            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-1]), found["key"].combine_chunks()], [*batch.schema.names[:-1], "phrase"])
                a = b

    return run


def windows(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """phrase and the other columns of texts, for each text and each different piece of it that is a phrase or, seldom, has the hash of one; whoever counts on it joins the phrases. phrases: phrase (distinct, not empty, written); texts: text, lower-cased already.

    Hashes of all windows as long as some phrase come from prefix sums; a Bloom filter of bounded size, sent to all, says which may be phrases, and these are given in whole. So what is sent grows with what is found, not with how often pieces of phrases occur."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    spark, others = texts.sparkSession, [c for c in texts.columns if c != "text"]
    sizes = phrases.groupBy(F.octet_length("phrase").alias("n")).agg(F.count("*").alias("phrases")).collect()  # a row a length
    mask = (1 << min(BITS[1], max(BITS[0], (EACH * sum(r.phrases for r in sizes)).bit_length()))) - 1
    shape = StructType([*(texts.schema[c] for c in others), StructField("phrase", BinaryType())])
    if not sizes:
        return spark.createDataFrame([], StructType([*shape.fields[:-1], StructField("phrase", StringType())]))
    flags = spark.sparkContext.broadcast(_filter(phrases, mask))
    found = texts.filter("text is not null").select(*others, "text").mapInArrow(_windows(flags, sorted(r.n for r in sizes)), shape)
    return found.withColumn("phrase", F.col("phrase").cast("string"))
