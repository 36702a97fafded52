"""Accuracy metrics: grouped, macro, pivoted, binned, grouping sets, win rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def accuracy_by(df: DataFrame, *keys: str, correct: str = "correct") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(F.col(correct).cast("long")).alias("n_correct"), F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy")
    )


def micro_macro(df: DataFrame, key: str) -> DataFrame:
    """Over all rows, and the mean of the keys' accuracies."""
    by = accuracy_by(df, key)
    return by.agg((F.sum("n_correct") / F.sum("n")).alias("micro"), F.avg("accuracy").alias("macro"), F.count("*").alias("n_groups"))


def family_rollup(df: DataFrame, family: str, task: str) -> DataFrame:
    """Mean of task accuracies within each family, and over all tasks (family null)."""
    by = accuracy_by(df, family, task)
    return by.groupBy(family).agg(F.avg("accuracy").alias("macro"), F.count("*").alias("n_tasks")).unionByName(
        by.agg(F.lit(None).cast("string").alias(family), F.avg("accuracy").alias("macro"), F.count("*").alias("n_tasks"))
    )


def task_share(df: DataFrame, task: str, value: str) -> DataFrame:
    """Sum of a task's metric over the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.groupBy(task).agg(F.sum(value).alias("s")).crossJoin(F.broadcast(total)).select(task, (F.col("s") / F.col("total")).alias("share"))


def pivot_mean(df: DataFrame, row: str, column: str, values: list, value: Column) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.avg(value))


def right_closed_bin(c: Column, edges: list[float]) -> Column:
    """'a-b' for a < c <= b; null outside."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out = F.when((c > a) & (c <= b), f"{a:g}-{b:g}").otherwise(out)
    return out


def grouping_sets(df: DataFrame, sets: list[list[str]], *, correct: str = "correct") -> DataFrame:
    names = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in names]).agg(
        F.sum(F.col(correct).cast("long")).alias("n_correct"), F.count("*").alias("n")
    )


def answered_accuracy(df: DataFrame, key: str, answer: str, correct: str = "correct") -> DataFrame:
    """Unanswered rows leave the denominator."""
    said = F.col(answer) != ""
    return df.groupBy(key).agg(
        F.count_if(said).alias("n_answered"), F.count("*").alias("n"), F.try_divide(F.sum(F.when(said, F.col(correct).cast("double"))), F.count_if(said)).alias("accuracy")
    )


def confusion_split(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth")).agg(
        F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(guess)).alias("n_right"), F.count_if(F.col(guess) == 1).alias("n_said_one")
    )


def win_rate(df: DataFrame, ab: str, ba: str, name: str) -> DataFrame:
    """Wins in either order over twice the pairs."""
    wins = F.sum((F.col(ab) == name).cast("int")) + F.sum((F.col(ba) == name).cast("int"))
    return df.agg((wins / (2.0 * F.count("*"))).alias("win_rate"), F.count("*").alias("n"))


def relative_change(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Mean relative change between consecutive runs of a key."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(order))
    return df.withColumn("change", F.try_divide(F.col(value) - before, before)).groupBy(key).agg(F.avg("change").alias("mean_change"))


def softmax_mean(df: DataFrame, key: str, score: str, value: str) -> DataFrame:
    """Softmax-weighted mean per key, shifted by the maximum; partial sums merge in any order."""
    top = df.groupBy(key).agg(F.max(score).alias("top"))
    w = F.exp(F.col(score) - F.col("top"))
    return df.join(top, key).groupBy(key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("weighted"))


def completeness(df: DataFrame, key: str, n: int) -> DataFrame:
    """Groups and whether they hold n rows."""
    return df.groupBy(key).agg(F.count("*").alias("n"), (F.count("*") == n).alias("complete"))


def adaptive_bins(df: DataFrame, key: str, position: Column) -> DataFrame:
    """Histogram of positions in [0, 1): 10 bins from 100 rows on, 5 from 20, else 1; density per bin width."""
    tenth, fifth = F.least(F.floor(position * 10), F.lit(9)), F.least(F.floor(position * 5), F.lit(4))
    cells = df.groupBy(key, tenth.alias("tenth"), fifth.alias("fifth")).agg(F.count("*").alias("c"))  # a key has few, however many its rows
    cells = cells.withColumn("n", F.sum("c").over(W.partitionBy(key)))
    bins = F.when(F.col("n") >= 100, 10).when(F.col("n") >= 20, 5).otherwise(1)
    place = F.when(bins == 10, F.col("tenth")).when(bins == 5, F.col("fifth")).otherwise(F.lit(0)).cast("long")
    return cells.groupBy(key, bins.alias("bins"), place.alias("bin")).agg(F.sum("c").alias("n")).withColumn("density", F.col("n") * F.col("bins").cast("double"))


def require_complete(df: DataFrame, key: str, n: int) -> DataFrame:
    """The groups, each of which must hold n rows; another number is an error."""
    c = F.count("*")
    return df.groupBy(key).agg(F.when(c == n, c).otherwise(F.raise_error(F.concat(F.lit("group of "), c.cast("string"), F.lit(" rows")))).alias("n"))


def with_missing(df: DataFrame, key: str, place: str, n: int) -> DataFrame:
    """(key, place, missing): the places of each group, each once, and marked as missing those from 0 to n - 1 that no row has."""
    own = df.groupBy(key).agg(F.collect_set(place).alias("__own"))
    every = own.select(key, "__own", F.explode(F.array_union("__own", F.sequence(F.lit(0), F.lit(n - 1)))).alias(place))
    return every.select(key, place, (~F.array_contains("__own", F.col(place))).alias("missing"))


def softmax_states(df: DataFrame, keys: list[str], score: Column, value: Column) -> DataFrame:
    """keys and a mergeable state (m, l, o): greatest score, sum of weights and of weighted values relative to it.

    One pass without a shuffle: a task keeps a state per group and rescales it when the
    maximum grows; states are handed over when there are ``_GROUPS`` and at the end, so
    a group has a few rows per task. Rows of a null score have no weight; null keys are a group.
    """
    n = len(keys)
    kinds = df.select(*keys).schema
    schema = T.StructType([*kinds.fields, *[T.StructField(c, T.DoubleType()) for c in ("m", "l", "o")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, tuple[float, float, float]] = {}

        def handed() -> pa.RecordBatch:
            columns = list(zip(*[(*k, *s) for k, s in states.items()], strict=True)) or [()] * (n + 3)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

        for batch in batches:
            place: dict[tuple, int] = {}
            group = np.array([place.setdefault(k, len(place)) for k in zip(*[batch.column(i).to_pylist() for i in range(n)], strict=True)], np.int64)
            s = batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64)
            v = batch.column(n + 1).to_numpy(zero_copy_only=False).astype(np.float64)
            known = ~np.isnan(s) & ~np.isnan(v)
            group, s, v = group[known], s[known], v[known]
            m = np.full(len(place), -np.inf)
            np.maximum.at(m, group, s)
            w = np.exp(s - m[group])
            l, o = np.bincount(group, w, len(place)), np.bincount(group, w * v, len(place))  # noqa: E741
            for k, i in place.items():
                if m[i] == -np.inf:
                    continue
                was = states.get(k, (-np.inf, 0.0, 0.0))
                top = max(was[0], m[i])
                old, new = float(np.exp(was[0] - top)), float(np.exp(m[i] - top))
                states[k] = (float(top), was[1] * old + float(l[i]) * new, was[2] * old + float(o[i]) * new)
            if len(states) >= _GROUPS:
                yield handed()
                states.clear()
        yield handed()

    return df.select(*keys, score.cast("double").alias("__s"), value.cast("double").alias("__v")).mapInArrow(run, schema)


#: Groups whose states a task holds at once.
_GROUPS = 100_000


def merge_softmax(states: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``weighted``, the weighted mean, of states of any parts: each is rescaled to the greatest maximum of its group."""
    top = states.withColumn("__top", F.max("m").over(W.partitionBy(*keys)))  # a few rows per task and group
    share = F.exp(F.col("m") - F.col("__top"))
    return top.groupBy(*keys).agg((F.sum(F.col("o") * share) / F.sum(F.col("l") * share)).alias("weighted"))


def even_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in bins of equal width from the least to the greatest value."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / float(bins), F.lit(1e-9))
    placed = df.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))  # one row of ends
    return placed.groupBy("bin").agg(F.count("*").alias("n"))


def response_density(df: DataFrame, key: str, at: str) -> DataFrame:
    """Responses per unit of time in ten segments of each key's span, averaged over segments.

    Keys of over 10 responses have ten segments, those of over 5 have five, each of
    which stands for two; keys of fewer are left out. The sum is divided by the
    number of the keys' own segments. Returns bin and density.
    """
    w = W.partitionBy(key)
    span = df.select(key, F.col(at).alias("t"), F.count("*").over(w).alias("n"), F.min(at).over(w).alias("a"), F.max(at).over(w).alias("b")).where("n > 5")
    bins = F.when(F.col("n") > 10, 10).otherwise(5)
    span = span.withColumn("bins", bins).withColumn("width", F.greatest(F.col("b") - F.col("a"), F.lit(1.0)) / F.col("bins"))
    own = span.withColumn("bin", F.least(((F.col("t") - F.col("a")) / F.col("width")).cast("int"), F.col("bins") - 1))
    rate = own.groupBy(key, "bins", "width", "bin").agg((F.count("*") / F.first("width")).alias("rate"))
    total = span.select(key, "bins").distinct().agg(F.sum("bins").alias("segments"))
    each = F.when(F.col("bins") == 10, F.array("bin")).otherwise(F.array(F.col("bin") * 2, F.col("bin") * 2 + 1))
    sums = rate.select(F.explode(each).alias("bin"), "rate").groupBy("bin").agg(F.sum("rate").alias("rate"))
    return sums.crossJoin(F.broadcast(total)).select("bin", (F.col("rate") / F.col("segments")).alias("density"))  # one row
