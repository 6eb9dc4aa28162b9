"""A corpus for training: what a quality classifier and two kinds of dedup leave, mixed by source and encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the columns of
documents. The classifier's fit isn't SQL, so ORACLE_SQL is None; tests/llm holds the stages against brute force.

Nulls: a null text is an empty text; empty texts are scored like others, are exact copies of each other, link with nothing in the
near-duplicate stage, and have no words that the mix could take. A null id is larger than any, so a copy that has one stays before one
that has none. Ties and repeated rows: rows that share an id, or have none, are told apart by a key of their own; of equal texts, and of
near duplicates, exactly one row stays, of the smallest id, and among rows of that id the first by text and a hash of all its columns; the mix
counts each row once. Very long texts are worked on whole. Columns beyond those of documents pass through every stage but the last,
whatever their names. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import byte_bpe, exact_dedup, jaccard_join, quality_mil, source_mix
from turnmill.llm.common import kept, prepared, table, unused
from turnmill.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"))
    score = unused(docs.columns, "__score")
    return quality_mil.scored(docs, model, score).filter(F.col(score) >= quality_mil.THRESHOLD).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, of the smallest doc_id."""
    rows, row = _keyed(docs)
    return _only(rows, row, exact_dedup.dedup(rows, id_col=row).filter("kept").select("doc_id"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, of the smallest doc_id."""
    rows, row = _keyed(docs)
    return _only(rows, row, jaccard_join.components(rows, id_col=row).filter("doc_id = component_id").select("doc_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it."""
    rows, row = _keyed(docs)
    mix = source_mix.mix_documents(rows.select(F.col(row).alias("doc_id"), "source", "text")).filter("repeats > 0")
    n, k = unused(rows.columns, "__repeats"), unused(rows.columns, "__k")
    joined = rows.join(mix.select(F.col("doc_id").alias(row), F.col("repeats").cast("int").alias(n)), row)
    return joined.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    return byte_bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, and its name: doc_id, or where that repeats or is null, the row's place by doc_id (null last), text, and a hash of all columns."""
    row = unused(docs.columns, "__row")
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        return docs.withColumn(row, F.col("doc_id").cast("long")), row
    # ranges are found by a text's beginning alone, so that no whole text is sampled; rows of one id and beginning are sorted in one task, on disk if they are many
    order = docs.repartitionByRange(F.asc_nulls_last("doc_id"), F.substring("text", 1, 256)).sortWithinPartitions(F.asc_nulls_last("doc_id"), "text", F.xxhash64(*docs.columns))
    return kept(order.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _only(rows: DataFrame, row: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among ids, without it."""
    return rows.join(ids.withColumnRenamed("doc_id", row), row, "left_semi").drop(row)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixed", mixed), ("encoded", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them the rows are written to the shared folder and read again."""
    prepared(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
