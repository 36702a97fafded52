"""Masked reductions, sampling filters and controllers as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def masked_stats(df: DataFrame, key: str, value: str, mask: str) -> DataFrame:
    """Masked mean and unbiased variance."""
    x = F.when(F.col(mask), F.col(value).cast("double"))
    return df.groupBy(key).agg(F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.count(x).alias("n"))


def whiten(c: Column, keys: list[str]) -> Column:
    w = W.partitionBy(*keys)
    return (c - F.avg(c).over(w)) / F.sqrt(F.var_samp(c).over(w) + 1e-8)


def nucleus(df: DataFrame, keys: list[str], p: str, tie: str, mass: float) -> DataFrame:
    """The fewest most likely rows whose probability reaches ``mass``; null probabilities come last. Keys are summed in ranges."""
    from .sequences import with_prefix_sum

    falling = df.withColumn("__falling", F.coalesce(-F.col(p), F.lit(1.0)))
    return with_prefix_sum(falling, keys, ["__falling", tie], p, "__before").where(F.col("__before") < mass).drop("__falling", "__before")


def history_zscore(df: DataFrame, key: str, order: list[str], value: str, size: int, least: int) -> DataFrame:
    """z-score in the key's last ``size`` values, over all rows so far while a key has fewer than ``least``."""
    own = W.partitionBy(key).orderBy(*order).rowsBetween(-(size - 1), 0)
    mean, std = F.avg(value).over(own), F.stddev_pop(value).over(own)
    total = df.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    out = df.withColumns({"__om": mean, "__os": std, "__n": F.count(value).over(own)}).crossJoin(F.broadcast(total))
    few = F.col("__n") < least
    z = (F.col(value) - F.when(few, F.col("__m")).otherwise(F.col("__om"))) / (F.when(few, F.col("__s")).otherwise(F.col("__os")) + 1e-6)
    return out.withColumn("z", z).drop("__om", "__os", "__n", "__m", "__s")


def preference_loss(chosen: Column, rejected: Column, beta: float, kind: str) -> Column:
    """sigmoid, hinge or ipo loss of the log-ratio difference; for kto see ``kto_losses``."""
    d = chosen - rejected
    if kind == "sigmoid":
        return F.log1p(F.exp(-F.abs(beta * d))) + F.greatest(F.lit(0.0), -beta * d)
    if kind == "hinge":
        return F.greatest(F.lit(0.0), 1 - beta * d)
    return F.pow(d - 1 / (2 * beta), 2)


def kl_penalty(lp: Column, ref: Column, kind: str) -> Column:
    d = lp - ref  # of whole distributions for "full", see ``full_kl``
    return {"kl": d, "abs": F.abs(d), "mse": 0.5 * d * d}[kind]


def adaptive_kl(kls: Column, start: float, target: float, horizon: float, n: int) -> Column:
    """The coefficient after a sequence of KL values: clipped proportional steps."""
    return F.aggregate(kls, F.lit(start), lambda k, x: k * (1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), x / target - 1)) * (n / horizon)))


def pool_grid(df: DataFrame, keys: list[str], x: str, y: str, value: str, side: int) -> DataFrame:
    """Mean and maximum over side x side cells."""
    return df.groupBy(*keys, F.floor(F.col(x) / side).alias("cx"), F.floor(F.col(y) / side).alias("cy")).agg(F.avg(value).alias("mean"), F.max(value).alias("top"))


def merge_moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """Running mean and spread of a key; partial moments merge in any order."""
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def full_kl(lp: Column, ref: Column) -> Column:
    """Divergence of two arrays of log probabilities: the sum of p (log p - log r)."""
    return F.aggregate(F.zip_with(lp, ref, lambda p, r: F.exp(p) * (p - r)), F.lit(0.0), lambda a, x: a + x)


def token_rewards(df: DataFrame, key: str, order: str, kl: str, mask: str, score: str, beta: float) -> DataFrame:
    """``df`` with ``reward``: -beta times the KL value, and the score on the last unmasked token of each key."""
    last = F.max(F.when(F.col(mask), F.col(order))).over(W.partitionBy(key))
    return df.withColumn("reward", -beta * F.col(kl) + F.when(F.col(order) == last, F.col(score)).otherwise(0.0))


def kto_losses(df: DataFrame, beta: float) -> DataFrame:
    """``df`` (policy_chosen, policy_rejected, ref_chosen, ref_rejected) with the losses of both halves; each half's divergence is the other's mean, at least 0."""
    chosen, rejected = F.col("policy_chosen") - F.col("ref_chosen"), F.col("policy_rejected") - F.col("ref_rejected")
    means = df.agg(F.greatest(F.avg(chosen), F.lit(0.0)).alias("__c"), F.greatest(F.avg(rejected), F.lit(0.0)).alias("__r"))
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    both = df.crossJoin(F.broadcast(means))  # one row
    return both.withColumns({"loss_chosen": 1 - sigmoid(beta * (chosen - F.col("__r"))), "loss_rejected": 1 - sigmoid(beta * (F.col("__c") - rejected))}).drop("__c", "__r")


def top_k_nucleus(df: DataFrame, keys: list[str], weight: str, tie: str, k: int, mass: float) -> DataFrame:
    """The k heaviest rows per key, of which the fewest whose share of their sum reaches ``mass``."""
    order = W.partitionBy(*keys).orderBy(F.desc(weight), tie)
    top = df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")
    return nucleus(top.withColumn("__p", F.col(weight) / F.sum(weight).over(W.partitionBy(*keys))), keys, "__p", tie, mass).drop("__p")


def moment_states(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable state per group: n, mean and sum of squared deviations."""
    x = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.coalesce(F.var_pop(x), F.lit(0.0)) * F.count(x)).alias("m2"))


def merge_moment_states(states: DataFrame, key: str) -> DataFrame:
    """n, mean and unbiased variance per key from the states of its parts (Chan's update), folded in pairs."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def join(a, x):
        n, d = a["n"] + x["n"], x["mean"] - a["mean"]
        share = F.try_divide(x["n"].cast("double"), n)
        return F.struct(n.alias("n"), F.coalesce(a["mean"] + d * share, a["mean"]).alias("mean"), F.coalesce(a["m2"] + x["m2"] + d * d * a["n"] * share, a["m2"]).alias("m2"))

    parts = F.sort_array(F.collect_list(F.struct("n", "mean", "m2")))
    folded = states.groupBy(key).agg(F.aggregate(parts, start, join).alias("s"))
    return folded.select(key, F.col("s.n").alias("n"), F.col("s.mean").alias("mean"), F.try_divide(F.col("s.m2"), F.col("s.n") - 1).alias("var"))


def row_losses(df: DataFrame, logits: str, labels: str, name: str = "loss") -> DataFrame:
    """``df`` with ``name``: the mean of -log softmax(logits)[label] over the positions of a row whose label is not negative.

    logits: an array per position, labels: an index per position (negative: masked). A row whose labels are
    all masked, or without positions, has a null loss; a null array as well.
    """
    from tidewater.functions import vectors as V

    each = F.zip_with(logits, labels, lambda x, y: F.when(y >= 0, -V.log_softmax_at(x, y)))
    known = F.filter(each, lambda x: x.isNotNull())
    return df.withColumn(name, F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)))
