"""What the operators share: scratch tables, bounded Arrow batches, text buffers as arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: The white space of the contracts: space and tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch; a batch of long texts stays within memory.
BATCH_ROWS = 1000
#: Bytes of text that a task works on at once, unless one text alone is longer.
CHUNK = 2_000_000
#: Bytes of a worker's cache.
CACHE_BYTES = 160_000_000


def prepared(spark: SparkSession) -> SparkSession:
    """Python workers find this package; Arrow batches are small."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, paths]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local session gets a temporary one; a cluster has to name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="turnmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/turnmill/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: the lineage ends there, and a lost executor costs no rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables that kept() wrote and nothing reads any more."""
    for df in frames:
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(names: list[str], wanted: str) -> str:
    """wanted, or with more marks before it where a column has that name."""
    held = {n.lower() for n in names}
    while wanted.lower() in held:
        wanted = f"_{wanted}"
    return wanted


def refuse(df: DataFrame, *names: str) -> None:
    """ValueError if df has a column of one of the names that an operator adds."""
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"the input has columns named {', '.join(sorted(clash))}")


def numbered(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with one more column, each row's place in the order, from 0: rows are dealt out by ranges and sorted there, and prefix sums of the partitions' sizes, a row each, place them."""
    at, schema = f"{df.schema.simpleString()[7:-1]}, __part int, __at long", [*df.columns, "__part", "__at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(n, n + batch.num_rows))], schema)
            n += batch.num_rows

    placed = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, at), "numbered")
    sizes = placed.groupBy("__part").agg(F.max("__at").alias("n"))
    base = sizes.select("__part", (F.sum(F.col("n") + 1).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") - 1).alias("__base"))
    return placed.join(base, "__part").withColumn(name, F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with null texts empty, whatever else df holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), offsets


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece have most bytes at most, or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


class Cache(dict):
    """What a worker knows of pieces of text, within a bound of bytes (estimated). When half of it is full, that becomes the older half, from which pieces that occur again are taken over."""

    def __init__(self, most: int = CACHE_BYTES):
        super().__init__()
        self.most, self.size, self.before = most, 0, {}

    def missing(self, pieces: set[str]) -> list[str]:
        """Those that have to be added now."""
        if self.size > self.most // 2:
            self.before, self.size = dict(self), 0
            self.clear()
        new = pieces.difference(self)
        if old := new & self.before.keys():
            self.add(old, map(self.before.__getitem__, old))
            new -= old
        return list(new)

    def add(self, pieces, values) -> None:
        self.update(zip(pieces, values))
        self.size += 200 * len(pieces) + 5 * sum(map(len, pieces))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15) | np.uint64(1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as bytes: the start, end and 64-bit hash (A-Z lower-cased, unless lower is false) of every word, and where each text's words begin (one more than texts)."""
    global _POWERS
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
        edge[1:-1] = inside[1:] != inside[:-1]
        cuts = offsets[1:-1] - base  # a word ends where its text does
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        joined = cuts[inside[cuts] & inside[cuts - 1]]
        at = np.sort(np.concatenate([np.flatnonzero(edge), joined, joined]))
    else:
        at = np.zeros(0, np.int64)
    starts, ends = at[::2], at[1::2]
    first = np.searchsorted(starts, offsets - base)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), first
    length = ends - starts
    if (most := int(length.max())) > len(_POWERS):
        _POWERS = _powers(2 * most)
    letters = (_LOWER[data[inside]] if lower else data[inside]).astype(np.uint64) + np.uint64(1)
    begin = np.cumsum(length) - length
    letters *= _POWERS[np.arange(len(letters)) - np.repeat(begin, length)]
    return starts, ends, mixed(np.add.reduceat(letters, begin)), first
