"""Arms: features, choices, recency-weighted success, graduation evidence (P, A-8, A-9, J-1, J-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, text
from . import keyed, kpi

DAY = 86_400_000


def success_table(scored: DataFrame, now: int, half_life: float = 30.0, lookback: int = 180) -> DataFrame:
    """A-8: mean score of each (bucket, arm), weighted by 0.5 ** (age / half-life); ages in the future count as 0. scored: bucket, chosen, kpi_score, started_at."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("started_at")) / DAY)
    rows = scored.filter(F.col("bucket").isNotNull() & F.col("kpi_score").isNotNull() & (F.col("started_at") >= now - lookback * DAY)).withColumn("__w", F.pow(F.lit(0.5), age / half_life))
    return rows.groupBy("bucket", "chosen").agg((F.sum(F.col("__w") * F.col("kpi_score")) / F.sum("__w")).alias("mean"), F.count("*").alias("n"))


def features(turns: DataFrame, prompts: DataFrame) -> DataFrame:
    """P-1: prompts holds turn_id and text; a missing one is empty."""
    rows = turns.join(prompts, "turn_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select(
        "turn_id", "started_at", F.coalesce("prompt_tokens", F.floor(F.length("text") / 4)).alias("prompt_tokens"), text.prompt_verbs(F.col("text")).alias("verbs"), text.count_file_refs(F.col("text")).alias("file_refs"),
        F.coalesce(kpi.occupancy(), F.lit(0.0)).alias("occupancy"), "is_subagent", scalars.hour_bucket(F.col("started_at")).alias("hour"),
    )


def bucket() -> Column:
    """P-2: language, first verb, size, scope."""
    size = F.when(F.col("prompt_tokens") < 1000, "s").when(F.col("prompt_tokens") < 4000, "m").otherwise("l")
    return F.concat_ws(":", F.lit("unknown"), F.coalesce(F.try_element_at("verbs", F.lit(1)), F.lit("none")), size, F.when(F.col("is_subagent") == 1, "sub").otherwise("top"))


def vector() -> Column:
    """P-2: name to value, each scaled to [0, 1]."""
    parts = {
        "prompt_tokens": F.least(F.col("prompt_tokens") / 8000, F.lit(1.0)), "file_refs": F.least(F.col("file_refs") / 10, F.lit(1.0)), "is_subagent": F.col("is_subagent").cast("double"), "context_occupancy": F.col("occupancy"), "hour_bucket": F.col("hour") / 3,
    } | {f"verb_{v}": F.array_contains("verbs", v).cast("double") for v in text.VERBS}
    return F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])


def linear(arms: list[str], weights: dict[str, dict[str, float]], features_: Column) -> Column:
    """P-3: each arm's weighted sum of the features, in the arms' order; what isn't weighed counts nothing."""
    each = []
    for arm in arms:
        each.append(sum((F.coalesce(F.try_element_at(features_, F.lit(k)), F.lit(0.0)) * float(w) for k, w in weights.get(arm, {}).items()), F.lit(0.0)))
    return F.array(*each)


def choose(rows: DataFrame, arms: list[tuple[str, float]], weights: dict[str, dict[str, float]], success: DataFrame, beta: float = 1.0, gamma: float = 0.2, prior: float = 0.8, least: int = 20, epsilon: float = 0.05, seed: int = 11, live: bool = False) -> DataFrame:
    """P-3 and J-14: for each row the arm of the highest score, the first one on ties; with probability epsilon, by a hash of turn_id and seed, any arm, which counts as explored if it is another. Also every arm's score (scores), epsilon, the reason, and whether the choice is only recorded (shadow).

    The arms are literals; success is joined by bucket, one row for each bucket. Without arms the choice is `default`, as for a file that couldn't be read."""
    rows = rows.withColumn("bucket", bucket())
    if not arms:
        none = F.lit(None).cast("double")
        return rows.select("turn_id", "bucket", F.lit("default").alias("chosen"), F.lit(False).alias("explored"), none.alias("score"), F.create_map().cast("map<string,double>").alias("scores"), none.alias("epsilon"), F.lit("config_error").alias("reason"), F.lit(True).alias("shadow"))
    table = success.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("chosen", F.struct("mean", "n")))).alias("__s"))  # an entry for each arm
    names = F.array(*(F.lit(a) for a, _ in arms))
    rows = rows.withColumn("__l", linear([a for a, _ in arms], weights, vector())).join(table, "bucket", "left")
    scores = []
    for i, (arm, cost) in enumerate(arms):
        own = F.try_element_at("__s", F.lit(arm))
        scores.append(F.get("__l", i) + beta * F.when(F.coalesce(own["n"], F.lit(0)) >= least, own["mean"]).otherwise(F.lit(prior)) - gamma * cost)
    rows = rows.withColumn("__x", F.array(*scores)).withColumn("__best", F.array_position("__x", F.array_max("__x")))
    draw = lambda salt: F.pmod(F.xxhash64("turn_id", F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1_000_000
    pick = F.when(draw("e") < epsilon, F.floor(draw("a") * len(arms)) + 1).otherwise(F.col("__best")).cast("int")
    rows = rows.withColumn("__pick", pick).withColumn("explored", F.col("__pick") != F.col("__best"))
    return rows.select(
        "turn_id", "bucket", F.element_at(names, F.col("__pick")).alias("chosen"), "explored", F.element_at("__x", F.col("__pick")).alias("score"), F.map_from_arrays(names, "__x").alias("scores"), F.lit(float(epsilon)).alias("epsilon"),
        F.when(F.col("explored"), "explore").otherwise("argmax").alias("reason"), F.lit(not live).alias("shadow"),
    )


def shadow_decisions(rows: DataFrame, arms: list[tuple[str, float]], half_life_days: float = 30.0, beta: float = 1.0, gamma: float = 0.2, prior: float = 0.8, least: int = 20) -> DataFrame:
    """P-4: replay in order of time, where each decision feeds the next. rows: turn_id, bucket, started_at, kpi_score, and, where they have them, linear (P-3, by arm) and decided (an arm chosen before, which only feeds). Turns without a score wait; a rerun with its own decisions as decided gives none.

    A success is only looked up in the turn's own bucket, so buckets go by apart, each in order, and running decayed sums by arm are all that is held."""
    names, costs = [a for a, _ in arms], [c for _, c in arms]

    def step(state, row):
        state = state or [[0.0, 0.0, 0, 0] for _ in arms]  # weighted sum, weights, n, time
        lin = row["linear"] if row["linear"] is not None else [0.0] * len(arms)
        scores = [x + beta * (s / w if n >= least and w else prior) - gamma * c for x, c, (s, w, n, _) in zip(lin, costs, state)]
        best = names.index(row["decided"]) if row["decided"] in names else max(range(len(arms)), key=scores.__getitem__)
        s, w, n, at = state[best]
        f = 0.5 ** ((row["started_at"] - at) / DAY / half_life_days) if n else 0.0
        state[best] = [s * f + row["kpi_score"], w * f + 1, n + 1, row["started_at"]]
        return state, (names[best], float(scores[best]))

    lin = F.col("linear") if "linear" in rows.columns else F.lit(None).cast("array<double>")
    done = F.col("decided") if "decided" in rows.columns else F.lit(None).cast("string")
    slim = rows.filter("kpi_score is not null").select("bucket", "turn_id", "started_at", "kpi_score", lin.alias("linear"), done.alias("decided"))
    out = keyed.in_order(slim, ["bucket"], ["started_at", "turn_id"], step, "chosen string, score double")
    return out.filter("decided is null").select("turn_id", "bucket", "chosen", "score")


def weights_version(config: bytes) -> Column:
    """P-5: a constant that changes iff the configuration's bytes do."""
    import hashlib

    return F.lit(hashlib.sha256(config).hexdigest()[:12])


def domain_status(decided: DataFrame, domains: dict[str, bool], arms: dict[str, list[str]], config: bytes, least: int = 20) -> DataFrame:
    """P-6: of each domain whether its choices are followed (live), the version of its configuration, and A-9 for each of its arms. decided: domain, chosen, kpi_score, tier, mode; what a choice is compared with depends on the domain."""
    actual = {"model_tier": "tier", "mode_delegation": "mode"}
    out = None
    for domain, live in domains.items():
        rows = decided.filter(F.col("domain") == domain)
        rows = rows if actual.get(domain) in rows.columns else rows.withColumn("__none", F.lit(None).cast("string"))
        own = graduation_report(rows, arms.get(domain, []), least, actual.get(domain) if actual.get(domain) in rows.columns else None)
        one = own.select(F.lit(domain).alias("domain"), F.lit(live).alias("live"), weights_version(config).alias("weights_version"), "chosen", "n", "agree", "disagree", "cleared", "delta")
        out = one if out is None else out.unionByName(one)
    return out


def graduation_report(decided: DataFrame, arms: list[str], least: int = 20, actual: str | None = "tier") -> DataFrame:
    """A-9: by arm how many scored decisions, and their mean score where what was used agrees with the choice and where not (null if nothing says what was used); arms never chosen have 0."""
    spark = decided.sparkSession
    agree = F.col("chosen").eqNullSafe(F.col(actual)) if actual else F.lit(None).cast("boolean")
    sums = decided.filter("kpi_score is not null").groupBy("chosen").agg(F.count("*").alias("n"), F.avg(F.when(agree, F.col("kpi_score"))).alias("agree"), F.avg(F.when(~agree, F.col("kpi_score"))).alias("disagree"))
    names = spark.createDataFrame([(a,) for a in arms], "chosen string")
    return names.join(sums, "chosen", "left").fillna(0, ["n"]).withColumn("cleared", F.col("n") >= least).withColumn("delta", F.col("agree") - F.col("disagree"))
