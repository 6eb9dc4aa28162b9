"""Operator 10: repeated line runs, by prefix doubling over line-ID sequences; later copies are deleted.

A text is the sequence of its lines (cut at line feeds). A line's ID is the order of its content's 128-bit hash. Suffixes are ranked
by their first 1, 2, 4, ... lines: the rank for 2 n lines is the order of the pair (rank for n lines here, rank for n lines n lines
further on), found by a range sort and prefix sums of the partitions' sizes. Suffixes that no other shares n lines with drop out,
so the sorted suffixes that stay are the intervals whose longest common prefix has n lines at least. The interval of a run of any
length m is the pair of ranks of its first and last n lines, n the power of two with n <= m <= 2 n.

A run counts from MIN_WORDS words on. Every stretch that repeats is covered by its shortest such runs: those that begin at each of
its lines, and those that end at each. So of these shortest runs each document has two a line at most, and the union of those whose
interval has an earlier member is what the maximal repeated runs cover; these lines are deleted. Earlier: by doc_id, then by text
hash, then by line. The first copy of a run always stays.

Null and empty texts are one empty line and never change. Null ids come after all others. Rows that repeat both id and text are one
document for this purpose and fare alike. A very long text is a list of lines in one row while it is cut. Other columns pass through
dedup(), which lets its marks be named. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, kept, numbered, prepared, refuse, unused

MIN_WORDS = 50
_KEY = ["doc_id", "uid"]


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc_id"), text.alias("text")).withColumn("uid", _uid(F.col("text")))


def _uid(text: Column) -> Column:
    return F.xxhash64(text, F.lit(3))


def _runs(least: int):
    """The shortest runs of at least so many words: (start, length) of those that begin and those that end at each line."""
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("line", pa.int32()), ("m", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, uids, lines, sizes = [], [], [], []
            for doc, uid, n in zip(batch["doc_id"].to_pylist(), batch["uid"].to_pylist(), batch["n_words"]):
                until = np.cumsum(np.r_[0, n.values.to_numpy()])
                if until[-1] < least:
                    continue
                at = np.arange(len(until) - 1)
                end = np.searchsorted(until, until[:-1] + least)  # the first end with enough words
                fits = end < len(until)
                start = np.searchsorted(until, until[1:] - least, "right") - 1  # the last start with enough words
                long = start >= 0
                both = np.unique(np.stack([np.r_[at[fits], start[long]], np.r_[(end - at)[fits], (at + 1 - start)[long]]], 1), axis=0)
                docs.append(np.full(len(both), doc))
                uids.append(np.full(len(both), uid))
                lines.append(both[:, 0])
                sizes.append(both[:, 1])
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(uids)), pa.array(np.concatenate(lines).astype(np.int32)), pa.array(np.concatenate(sizes).astype(np.int32))], schema=schema)

    return run


def _ranked(active: DataFrame, name: str) -> DataFrame:
    """active (doc_id, uid, line, r, s) with `rank`, the order of its pair (r, s) among those that several have; others are left out. The pairs' table is written first, so that the rows of a pair that very many have are a skewed join's, which Spark splits."""
    pairs = active.groupBy("r", "s").agg(F.count("*").alias("n")).filter("n > 1").select("r", "s")
    ranks = kept(numbered(pairs, ["r", "s"]), name)
    return kept(active.join(ranks, ["r", "s"]).select(*_KEY, "line", "rank"), name)


def repeated(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, uid, lines: which lines of a document (ascending from 0) later copies of runs cover."""
    prepared(df.sparkSession)
    docs = _documents(df, id_col, text_col)
    cut = docs.select(*_KEY, F.split("text", "\n", -1).alias("lines"))
    lines = kept(cut.select(*_KEY, F.posexplode("lines").alias("line", "text")).select(*_KEY, "line", F.xxhash64("text").alias("r"), F.xxhash64(F.lit(1), "text").alias("s"), F.regexp_count("text", F.lit(WORD)).alias("n_words")).dropDuplicates([*_KEY, "line"]), "lines")
    first = _ranked(lines.drop("n_words"), "ranks")
    words = lines.groupBy(_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "n_words"))), lambda x: x["n_words"]).alias("n_words"))
    runs = words.mapInArrow(_runs(min_words), "doc_id long, uid long, line int, m int")
    runs = kept(runs.join(first.select(*_KEY, "line"), [*_KEY, "line"], "left_semi"), "runs")  # a line that nothing repeats begins no repeated run
    longest = runs.agg(F.max("m")).first()[0] or 0
    levels, n = [first], 1
    while 2 * n <= longest:
        last = levels[-1]
        on = last.select(*_KEY, (F.col("line") - n).alias("line"), F.col("rank").alias("s"))
        levels.append(_ranked(last.withColumnRenamed("rank", "r").join(on, [*_KEY, "line"]), "ranks"))
        n *= 2
    marked = None
    for k, ranks in enumerate(levels):
        some = runs.filter((F.col("m") >= 2**k) & (F.col("m") < 2 ** (k + 1)))
        head = ranks.select(*_KEY, "line", F.col("rank").alias("a"))
        tail = ranks.select(*_KEY, F.col("line").alias("last"), F.col("rank").alias("b"))
        some = some.join(head, [*_KEY, "line"]).withColumn("last", F.col("line") + F.col("m") - 2**k).join(tail, [*_KEY, "last"])
        some = some.select(*_KEY, "line", "m", F.lit(k).alias("k"), "a", "b")
        marked = some if marked is None else marked.unionByName(some)
    marked = kept(marked, "intervals")
    own = F.struct("doc_id", "uid", "line")
    earliest = kept(marked.groupBy("k", "m", "a", "b").agg(F.min(own).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "earliest")  # written, so that a run of very many copies is a skewed join's
    later = marked.join(earliest, ["k", "m", "a", "b"]).filter(own > F.col("first"))
    covered = later.select(*_KEY, F.explode(F.sequence("line", F.col("line") + F.col("m") - 1)).alias("line"))
    return covered.groupBy(_KEY).agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "__lines", removed_col: str = "__removed") -> DataFrame:
    """df with lines_col (how many lines each text had), removed_col (which of them went, null for none) and the rest as its text. A column of df that has one of these names is refused with ValueError."""
    refuse(df, lines_col, removed_col)
    i, u, cut = (unused([*df.columns, lines_col, removed_col], x) for x in ("__id", "__uid", "__cut"))
    gone = repeated(df, min_words, id_col, text_col).select(F.col("doc_id").alias(i), F.col("uid").alias(u), F.col("lines").alias(removed_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = (F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)) == F.col(i)) & (_uid(text) == F.col(u))
    out = df.join(gone, own, "left").drop(i, u).withColumn(cut, F.split(text, "\n", -1))
    out = out.withColumn(lines_col, F.size(cut))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.col(lines_col) - 1), F.col(removed_col)), lambda k: F.get(cut, k))
    return out.withColumn(text_col, F.when(F.col(removed_col).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))).drop(cut)


def digest(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers, comma-separated), text_sha256 of what is left, for every row."""
    out = dedup(df.select("doc_id", "text"), min_words)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("__lines").cast("long").alias("n_lines"), F.when(F.col("__removed").isNull(), 0).otherwise(F.size("__removed")).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("__removed", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
