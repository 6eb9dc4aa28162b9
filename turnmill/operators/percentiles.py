"""Nearest-rank percentiles (A-1): the sorted value at rint(p * (n - 1)); null for a group without values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of one coarse bucket, as a power of two: a group's rows are first counted by these.
COARSE = 10


def nearest(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """keys and a column for each wanted percentile of a whole-number value.

    Rows are counted by coarse bucket, then only those of the bucket that holds a percentile by value: neither step sorts a group's rows,
    and each sorts as many counts at most as there are buckets in a group, or values in a bucket."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), F.floor(F.col(value) / (1 << COARSE)).alias("__b"))
    by = Window.partitionBy(*keys)
    ranks = F.array(*(F.struct(F.lit(n).alias("name"), F.rint(F.lit(p) * (F.col("__all") - 1)).alias("at")) for n, p in wanted.items()))
    coarse = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    coarse = coarse.withColumn("__upto", F.sum("__n").over(by.orderBy("__b"))).withColumn("__all", F.sum("__n").over(by))
    held = coarse.withColumn("__w", F.explode(ranks)).filter((F.col("__w.at") < F.col("__upto")) & (F.col("__w.at") >= F.col("__upto") - F.col("__n")))
    held = held.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__b").alias("__hb"), F.col("__w.name").alias("__name"), (F.col("__w.at") - F.col("__upto") + F.col("__n")).alias("__at"))
    same = F.col("__b") == F.col("__hb")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__k{i}"))
    fine = rows.join(held, same).groupBy(*keys, "__name", "__at", "__v").agg(F.count("*").alias("__n"))
    fine = fine.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*keys, "__name").orderBy("__v")))
    at = {n: F.min(F.when((F.col("__name") == n) & (F.col("__upto") > F.col("__at")), F.col("__v"))).alias(n) for n in wanted}
    return fine.groupBy(*keys).agg(*at.values())
