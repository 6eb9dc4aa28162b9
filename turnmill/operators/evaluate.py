"""Measuring classifiers: strata, splits, confusion, intervals, drift (E)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 20


def stratum_weights(gold: DataFrame, population: dict[int, int]) -> DataFrame:
    """E-1: a weight for each row's stratum; population: how many each stratum stands for."""
    spark = gold.sparkSession
    n = gold.groupBy("stratum").agg(F.count("*").alias("n"))
    pop = spark.createDataFrame(list(population.items()), "stratum int, pop long")
    weights = n.join(pop, "stratum", "left").select("stratum", F.coalesce(F.col("pop") / F.col("n"), F.lit(0.0)).alias("weight"))
    return gold.join(weights, "stratum")


def assign_splits(gold: DataFrame, holdout: float = 0.4, seed: int = 5) -> DataFrame:
    """E-2: whole sessions are held out, max(1, round(n * holdout)) of them in the order of a hash. Sessions are counted by the hash's first 12 bits, and only those of the bucket in which the cut falls are sorted."""
    sessions = gold.select("session").distinct().withColumn("__h", F.xxhash64("session", F.lit(seed))).withColumn("__b", F.shiftright("__h", 52))
    n = sessions.groupBy("__b").agg(F.count("*").alias("__n"))  # 4096 rows at most
    n = n.withColumn("__upto", F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    n = n.withColumn("__take", F.greatest(F.lit(1.0), F.rint(F.col("__all") * holdout)) - F.col("__upto") + F.col("__n")).select("__b", "__n", "__take")
    placed = sessions.join(n, "__b")
    within = (F.col("__take") > 0) & (F.col("__take") < F.col("__n"))
    order = F.row_number().over(Window.partitionBy("__b").orderBy("__h", "session"))
    cut = placed.filter(within).withColumn("__k", order).filter(F.col("__k") <= F.col("__take")).select("session")
    out = placed.filter(F.col("__take") >= F.col("__n")).select("session").unionByName(cut).withColumn("__out", F.lit(True))
    return gold.join(out, "session", "left").withColumn("split", F.when(F.col("__out"), "held_out").otherwise("train")).drop("__out")


def confusion(rows: DataFrame) -> DataFrame:
    """E-3: counts and weights; a null prediction abstains and is no negative."""
    is_ = {"tp": (1, 1), "fp": (1, 0), "fn": (0, 1), "tn": (0, 0)}
    each = [x for k, (p, y) in is_.items() for x in (F.count_if((F.col("prediction") == p) & (F.col("label") == y)).alias(k), F.coalesce(F.sum(F.when((F.col("prediction") == p) & (F.col("label") == y), F.col("weight"))), F.lit(0.0)).alias(f"w_{k}"))]
    return rows.agg(*each, F.count_if(F.col("prediction").isNull()).alias("abstained"))


def scores(c: DataFrame, mark: str = "") -> DataFrame:
    """E-4 of confusion()'s row; mark w_ takes the weighted counts."""
    tp, fp, fn, tn = (F.col(f"{mark}{k}").cast("double") for k in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    accuracy = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return c.select(F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), accuracy.alias("accuracy"), F.when(chance < 1, (accuracy - chance) / (1 - chance)).alias("kappa"), n.alias("n"), F.when(n < LEAST, "silent").otherwise("measured").alias("verdict"))


def population_rate(rows: DataFrame) -> DataFrame:
    """E-5: the weighted rate that is predicted, the true one, and the weights that answered and abstained."""
    w, p, y = F.col("weight"), F.col("prediction"), F.col("label")
    said = p.isNotNull()
    return rows.agg(F.try_divide(F.sum(F.when(said, w * p)), F.sum(F.when(said, w))).alias("estimated"), F.try_divide(F.sum(w * y), F.sum(w)).alias("true_rate"), F.coalesce(F.sum(F.when(said, w)), F.lit(0.0)).alias("answered"), F.coalesce(F.sum(F.when(~said, w)), F.lit(0.0)).alias("abstained"))


def poisson(key: np.ndarray, draws: int) -> np.ndarray:
    """How often each key, an unsigned 64-bit hash, is in each draw: Poisson(1) by a hash of both."""
    h = key[:, None] ^ (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 15)])), u, "right")


def session_bootstrap(rows: DataFrame, draws: int = 2000, seed: int = 9) -> DataFrame:
    """E-6: a 95 % interval of the weighted rate by resampling whole sessions.

    Each session's times in a draw are Poisson(1) by a hash, the usual bootstrap where rows are spread out. A task sums the draws of its sessions as vectors, so that draws rows leave it, however many sessions it has. Silent below two sessions."""
    per = rows.filter("prediction is not null").groupBy("session").agg(F.sum(F.col("weight") * F.col("prediction")).cast("double").alias("pos"), F.sum("weight").cast("double").alias("all")).withColumn("key", F.xxhash64("session", F.lit(seed)))

    def summed(batches):
        pos, every = np.zeros(draws), np.zeros(draws)
        for batch in batches:
            key, a, b = (batch[c].to_numpy() for c in ("key", "pos", "all"))
            for k in range(0, len(key), 500):
                times = poisson(key[k : k + 500].view(np.uint64), draws)
                pos += a[k : k + 500] @ times
                every += b[k : k + 500] @ times
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(pos), pa.array(every)], ["draw", "pos", "all"])

    drawn = per.select("key", "pos", "all").mapInArrow(summed, "draw long, pos double, all double")
    rates = drawn.groupBy("draw").agg(F.try_divide(F.sum("pos"), F.sum("all")).alias("rate")).filter("rate is not null")
    ranked = rates.groupBy().agg(F.sort_array(F.collect_list("rate")).alias("r"))  # draws values
    at = lambda q: F.try_element_at("r", (F.floor(F.size("r") * q) + 1).cast("int"))
    enough = per.agg(F.count("*").alias("sessions"))
    return ranked.crossJoin(enough).select("sessions", F.when(F.col("sessions") >= 2, at(0.025)).alias("low"), F.when(F.col("sessions") >= 2, at(0.975)).alias("high"), F.when(F.col("sessions") < 2, "silent").otherwise("measured").alias("verdict"))


def drift(live: DataFrame, pinned: dict[int, int], tolerance: float = 0.02) -> DataFrame:
    """E-7: by stratum the relative difference; nothing pinned but something live is infinite."""
    want = live.sparkSession.createDataFrame(list(pinned.items()), "stratum int, pinned long")
    both = live.groupBy("stratum").agg(F.count("*").alias("live")).join(want, "stratum", "full").fillna(0, ["live", "pinned"])
    gap = F.when(F.col("pinned") == 0, F.when(F.col("live") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.abs(F.col("live") - F.col("pinned")) / F.col("pinned"))
    return both.withColumn("gap", gap).withColumn("drifted", F.col("gap") > tolerance)


def holdout_ledger(spends: DataFrame) -> DataFrame:
    """E-9: how often the held-out rows were spent on a classifier's version; only the first is independent."""
    n = F.row_number().over(Window.partitionBy("classifier", "version").orderBy("at", "report"))
    return spends.withColumn("spend_number", n).withColumn("independent", F.col("spend_number") == 1)
