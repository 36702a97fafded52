"""Sampled sound as rows of chunks: (keys, chunk, samples with interleaved channels). No decoding, only arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .retrieval import small
from .sequences import joined_on


def mixed_down(samples: Column, channels: int) -> Column:
    """The mean of the channels at each time; a frame that is cut off at the end counts with the channels it has."""
    x = samples.cast("array<double>")
    mean = lambda part: F.aggregate(part, F.lit(-0.0), lambda a, v: a + v) / F.size(part)
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / channels).cast("int") - 1), lambda i: mean(F.slice(x, i * channels + 1, channels)))


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded; unlike Spark's round, what is negative and too small stays a negative zero."""
    near = F.round(x, digits)
    return F.when((near == 0) & x.cast("string").startswith("-"), F.lit(-0.0)).otherwise(near)


def mono(chunks: DataFrame, samples: str, channels: int) -> DataFrame:
    """``chunks`` with one channel; an empty or null chunk has no samples."""
    filled = F.size(F.coalesce(samples, F.array())) > 0
    return chunks.withColumn(samples, F.when(filled, mixed_down(F.col(samples), channels)).otherwise(F.array().cast("array<double>")))


def peak_normalised(chunks: DataFrame, keys: list[str], samples: str) -> DataFrame:
    """``chunks`` scaled so that the greatest magnitude of each key is 1; silence stays. One pass finds peaks, the other scales."""
    peak = chunks.groupBy(*keys).agg(F.max(F.array_max(F.transform(samples, lambda x: F.abs(x)))).alias("__peak"))
    scaled = F.when(F.col("__peak") > 0, F.transform(samples, lambda x: x / F.col("__peak"))).otherwise(F.col(samples))
    return joined_on(chunks, small(peak), keys).withColumn(samples, scaled).drop("__peak")


def sliced(chunks: DataFrame, keys: list[str], chunk: str, samples: str, spans: DataFrame, rate: float, ident: str) -> DataFrame:
    """keys, ``ident`` and ``samples`` from start to end seconds of each of ``spans`` (keys, ident, start, end), across borders of chunks.

    Sample i is at i / rate and belongs to a span if floor(start rate) <= i < floor(end rate).
    Chunks follow each other by ``chunk``. A span beyond the sound has what there is of it.
    """
    size = F.size(samples).cast("long")
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = chunks.select(*keys, chunk, size.alias("__n")).withColumn("__from", before)  # lengths only
    placed = joined_on(chunks, at, [*keys, chunk])
    asked = spans.select(*keys, ident, F.floor(F.col("start") * rate).cast("long").alias("__a"), F.floor(F.col("end") * rate).cast("long").alias("__b"))
    width = chunks.agg(F.max(size)).first()[0] or 1  # both sides meet in cells as wide as the longest chunk
    cell = lambda c: F.expr(f"({c}) div {width}")
    left = placed.where("__n > 0").withColumn("__cell", F.explode(F.array_distinct(F.array(cell("__from"), cell("__from + __n - 1")))))
    right = asked.where("__b > __a").withColumn("__cell", F.explode(F.sequence(cell("__a"), cell("__b - 1"))))
    met = joined_on(left, right, [*keys, "__cell"]).where("__a < __from + __n AND __b > __from AND __cell = greatest(__a, __from) div " + str(width))
    piece = F.slice(F.col(samples), (F.greatest("__a", "__from") - F.col("__from") + 1).cast("int"), (F.least(F.col("__b"), F.col("__from") + F.col("__n")) - F.greatest("__a", "__from")).cast("int"))
    own = met.groupBy(*keys, ident).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col("__from"), piece.alias("x")))), lambda p: p["x"])).alias(samples))  # a span is a row
    return own.select(*keys, ident, samples)
