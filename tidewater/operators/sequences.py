"""Windows over ordered rows: ordinals, sessions, clips, prefix sums, packing, alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def joined_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join on ``keys`` in which null matches null, as in a group or window."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    renamed = renamed.select(*[F.col(c).alias(c) for c in renamed.columns])  # fresh columns: both sides may come from one table
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"__right_{k}" for k in keys])


def ordinal(keys: list[str], order: list[str]) -> Column:
    return (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long")


def previous_end(keys: list[str], order: list[str], end: str) -> Column:
    """End of the row before, 0 for the first."""
    return F.lag(end, 1, 0.0).over(W.partitionBy(*keys).orderBy(*order))


def nest(df: DataFrame, keys: list[str], order: str, fields: list[str], name: str = "items") -> DataFrame:
    """One row per key with its rows as an array in order."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name))


def explode_words(df: DataFrame, text: str, start: Column, end: Column) -> DataFrame:
    """Words at equal times between start and end; words that repeat the one before, and texts with brackets, are left out."""
    pieces = F.split(F.col(text), " ")
    kept = F.filter(F.transform(pieces, lambda w, i: F.struct(w.alias("word"), F.when(i > 0, F.get(pieces, i - 1)).alias("before"))), lambda x: x["before"].isNull() | (x["before"] != x["word"]))
    rows = df.where(~F.col(text).contains("[") & ~F.col(text).contains("]")).withColumns({"__words": F.transform(kept, lambda x: x["word"]), "__start": start, "__end": end})
    step = (F.col("__end") - F.col("__start")) / F.size("__words")
    return (
        rows.withColumn("__step", step)
        .select("*", F.posexplode("__words").alias("pos", "word"))
        .withColumns({"word_start": F.col("__start") + F.col("pos") * F.col("__step"), "word_end": F.col("__start") + (F.col("pos") + 1) * F.col("__step")})
        .drop("__words", "__start", "__end", "__step")
    )


def gap_sessions(df: DataFrame, keys: list[str], ts: str, gap: float, tie: str) -> DataFrame:
    """``df`` with ``session``: the number of gaps longer than ``gap`` before the row."""
    order = W.partitionBy(*keys).orderBy(ts, tie)
    return df.withColumn("__new", F.when(F.col(ts) - F.lag(ts).over(order) > gap, 1).otherwise(0)).withColumn("session", F.sum("__new").over(order)).drop("__new")


def running_text(keys: list[str], order: list[str], text: str) -> Column:
    """All texts before this one, joined by a space."""
    return F.array_join(F.collect_list(text).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), " ")


def pack_constant(df: DataFrame, keys: list[str], order: str, length: str, size: int) -> DataFrame:
    """Sequences with an end mark each, laid end to end and cut in pieces of ``size``; the unfinished piece goes.

    Returns keys, piece, and the (source, from, to) stretches it holds.
    """
    placed = with_prefix_sum(df.withColumn("__len", F.col(length) + 1), keys, [order], "__len", "__at")
    total = placed.groupBy(*keys).agg(F.sum("__len").alias("__total"))
    first, last = F.floor(F.col("__at") / size), F.floor((F.col("__at") + F.col("__len") - 1) / size)
    spread = joined_on(placed, total, keys).withColumn("piece", F.explode(F.sequence(first, last)))
    spread = spread.where((F.col("piece") + 1) * size <= F.col("__total"))
    return spread.select(
        *keys,
        "piece",
        F.col(order).alias("source"),
        (F.greatest(F.col("__at"), F.col("piece") * size) - F.col("__at")).alias("from_token"),
        (F.least(F.col("__at") + F.col("__len"), (F.col("piece") + 1) * size) - F.col("__at")).alias("to_token"),
    )


def trailing_trim(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Without the empty rows after a key's last non-empty one."""
    last = F.max(F.when(F.col(text) != "", F.col(order))).over(W.partitionBy(*keys))
    return df.withColumn("__last", last).where(F.col(order) <= F.col("__last")).drop("__last")


def first_at_or_after(ticks: DataFrame, points: DataFrame, keys: list[str], tick: str, point: str) -> DataFrame:
    """As-of join, forward: for each tick the first point not before it; one sort of both sides, no range join."""
    both = ticks.select(*keys, F.col(tick).alias("__t"), F.lit(1).alias("__is_tick"), F.lit(None).cast(points.schema[point].dataType).alias("__p")).unionByName(
        points.select(*keys, F.col(point).alias("__t"), F.lit(0).alias("__is_tick"), F.col(point).alias("__p"))
    )
    order = W.partitionBy(*keys).orderBy(F.desc("__t"), "__is_tick").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(point, F.last("__p", ignorenulls=True).over(order)).where("__is_tick = 1").select(*keys, F.col("__t").alias(tick), point)


def with_prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its key that come before; null is a key like others.

    A key, however many rows it has, is summed in ranges of the first column of
    ``order``, and each range is shifted by the sums of those before it. Tables of no more
    rows than a task ranks are summed by key.
    """
    cuts = _cuts(df, order[0])
    if not cuts:
        return df.withColumn(name, F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    split = _split(df, order[0], cuts)
    sums = split.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))  # a row per key and range
    base = sums.select(*keys, "__range", F.coalesce(before, F.lit(0)).alias("__base"))
    inner = W.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = split.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return joined_on(own, base, [*keys, "__range"]).withColumn(name, F.col(name) + F.col("__base")).drop("__range", "__base")


def with_ordinal(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, the place from 0 among the rows of its key; a key of very many rows is numbered in ranges."""
    return with_prefix_sum(df.withColumn("__one", F.lit(1)), keys, order, "__one", name).drop("__one")


def counts_until(points: DataFrame, events: DataFrame, keys: list[str], ident: list[str], until: str, at: str) -> DataFrame:
    """keys, ident and ``n``, the events of the key at or before each point; one sort of both sides, no range join."""
    both = points.select(*keys, *ident, F.col(until).alias("__x"), F.lit(0).alias("__one")).unionByName(
        events.select(*keys, *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in ident], F.col(at).alias("__x"), F.lit(1).alias("__one"))
    )
    w = W.partitionBy(*keys).orderBy("__x", F.desc("__one")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("n", F.sum("__one").over(w)).where("__one = 0").select(*keys, *ident, "n")


def _size(field: T.StructField) -> Column | int:
    """Bytes of a column, about; a number for those of one width."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType)):
        return F.coalesce(8 * F.size(F.col(f"`{field.name}`")), F.lit(0))
    return 8


def _cuts(df: DataFrame, order: str) -> list:
    """Quantiles of ``order`` that cut the table in ranges of about ``RANGE_ROWS`` rows or ``RANGE_BYTES``, 64 at least; none if all rows are no more than both."""
    sizes = [_size(f) for f in df.schema.fields]
    wide = [s for s in sizes if isinstance(s, Column)]
    if wide and not isinstance(df.schema[order].dataType, T.StringType):  # strings have no quantiles
        n, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(wide, F.lit(0).cast("long"))), F.lit(0))).first()
    else:
        n, size = df.count(), 0
    size += n * sum(s for s in sizes if isinstance(s, int)) if wide else 0
    if n <= RANGE_ROWS and size <= RANGE_BYTES:
        return []
    parts = max(64, min(MAX_RANGES, max(n // RANGE_ROWS, size // RANGE_BYTES)))
    found = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 20 * parts).alias("c")).first().c
    return sorted(set(found or []))


def _split(df: DataFrame, order: str, cuts: list) -> DataFrame:
    # the place among sorted cuts is one more than that of the last cut below the value
    part = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col(order))) if cuts else F.lit(0)
    return df.withColumn("__range", part)


def ranged(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``__range``, the number of its quantile of ``order``; one range if a task can rank all rows."""
    return _split(df, order, _cuts(df, order))


#: Rows and bytes that a task ranks, about, and most ranges.
RANGE_ROWS, RANGE_BYTES, MAX_RANGES = 1_000_000, 32 << 20, 512


def contiguous_parts(df: DataFrame, order: str, n: int) -> DataFrame:
    """``part`` of ceil(N / n) rows each; there may be fewer parts than n. Rank and count come from range partitions, not one task."""
    return with_rank(df, order).withColumn("part", F.floor(F.col("rank") / F.greatest(F.ceil(F.col("total") / n), F.lit(1))))


def with_rank(df: DataFrame, order: str) -> DataFrame:
    """``rank`` from 0 in the order of a unique column, and ``total``, without a single-partition sort.

    Rows are cut in ranges by quantiles, ranked inside, and shifted by the counts of the ranges before.
    """
    split = ranged(df, order)
    counts = split.groupBy("__range").agg(F.count("*").alias("n"))
    every = W.orderBy("__range")  # a row per range
    base = counts.select("__range", (F.sum("n").over(every) - F.col("n")).alias("__base"), F.sum("n").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    inner = W.partitionBy("__range").orderBy(order)
    return split.join(F.broadcast(base), "__range").withColumn("rank", F.row_number().over(inner) - 1 + F.col("__base")).drop("__range", "__base")


def seeded_order(seed: int, *cols: str) -> Column:
    """A reproducible pseudo-random order that SQL engines share: a multiplicative hash of integer columns."""
    mixed = F.lit(seed).cast("long")
    for c in cols:
        mixed = F.pmod(mixed * 31 + F.col(c).cast("long") * 2654435761, F.lit(4294967296))
    return mixed


def weighted_sample(df: DataFrame, keys: list[str], weight: Column, u: Column, k: int, tie: str) -> DataFrame:
    """k rows per key without replacement, by the largest ln(u) / weight."""
    score = F.log(u) / weight
    return df.withColumn("__s", score).withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__s"), tie))).where(F.col("__r") <= k).drop("__s", "__r")


def capped(df: DataFrame, keys: list[str], order: str, keep: Column, cap: int) -> DataFrame:
    """At most ``cap`` rows per key: those to keep, and of the others as many as fit, at equal steps."""
    from tidewater.functions.timeline import uniform_positions

    kept = W.partitionBy(*keys, "__keep").orderBy(order)
    every = W.partitionBy(*keys)
    marked = df.withColumn("__keep", keep)
    marked = marked.withColumns({"__r": F.row_number().over(kept) - 1, "__m": F.count("*").over(W.partitionBy(*keys, "__keep")), "__k": F.count_if("__keep").over(every)})
    left = F.greatest(F.lit(cap) - F.col("__k"), F.lit(0))
    places = F.coalesce(*[F.when(left == n, uniform_positions(F.col("__m"), n)) for n in range(1, cap + 1)])
    fits = F.coalesce(F.array_contains(places, F.col("__r").cast("int")), F.lit(False))
    return marked.where(F.col("__keep") | fits).drop("__keep", "__r", "__m", "__k")


def partial_permutation(df: DataFrame, key: str, place: str, total: str, degree: float, first: Column, second: Column, tie: str) -> DataFrame:
    """Rows with ``new_place``: a share ``degree`` of the places, chosen by the order of ``first``, is permuted by that of ``second``.

    Fewer than two chosen places change nothing; where the permutation is the
    identity, the chosen places rotate by one.
    """
    w = W.partitionBy(key)
    chosen = df.withColumns({"__h": first, "__k": F.rint(F.col(total) * degree)}).withColumn("__r", F.row_number().over(w.orderBy("__h", tie)))
    chosen = chosen.withColumn("__on", (F.col("__k") >= 2) & (F.col("__r") <= F.col("__k")))
    on = chosen.where("__on").withColumns({"__a": F.row_number().over(w.orderBy(place)), "__b": F.row_number().over(w.orderBy(second, tie))})
    same = F.max((F.col("__a") != F.col("__b")).cast("int")).over(w) == 0
    on = on.withColumn("__b", F.when(same, F.pmod(F.col("__a") + F.col("__k") - 2, F.col("__k")) + 1).otherwise(F.col("__b")))
    to = on.select(F.col(key).alias("__key"), F.col("__a").alias("__to"), F.col(place).alias("new_place"))
    moved = on.join(to, (F.col(key) == F.col("__key")) & (F.col("__b") == F.col("__to"))).select(*df.columns, "new_place")
    return moved.unionByName(chosen.where("not __on").select(*df.columns, F.col(place).alias("new_place")))


def clip_permutation(df: DataFrame, key: str, place: str, total: str, clips: int, noise) -> DataFrame:
    """Rows with ``new_place``: clips of ceil(total / clips) rows keep their inner order, the clips are permuted by ``noise`` of their number."""
    size = F.ceil(F.col(total) / F.least(F.lit(clips), F.col(total)))
    own = df.withColumn("__clip", F.floor(F.col(place) / size))
    clip = own.groupBy(key, "__clip").agg(F.count("*").alias("__n"), F.min(place).alias("__from"))
    clip = clip.withColumn("__h", noise(F.col(key), F.col("__clip")))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(key).orderBy("__h", "__clip").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    clip = clip.withColumn("__at", before).drop("__h", "__n")
    return own.join(clip, [key, "__clip"]).withColumn("new_place", F.col("__at") + F.col(place) - F.col("__from")).drop("__clip", "__at", "__from")


def strict_batches(df: DataFrame, stride: str, ident: str, noise: Column, size: int) -> DataFrame:
    """(stride, batch, slot, ident): batches of rows of the same stride, short ones filled up with their own rows; the last stride's short batch goes."""
    n = F.row_number().over(W.partitionBy(stride).orderBy(noise, ident)) - 1
    rows = df.select(F.col(stride).alias("stride"), F.col(ident).alias("id"), n.alias("n")).withColumn("batch", F.floor(F.col("n") / size))
    own = rows.groupBy("stride", "batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
    top = df.agg(F.max(stride).alias("top"))
    full = own.crossJoin(F.broadcast(top)).where((F.size("ids") == size) | (F.col("stride") < F.col("top")))  # one row
    slots = full.select("stride", "batch", "ids", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    return slots.select("stride", "batch", "slot", F.get("ids", F.pmod(F.col("slot"), F.size("ids"))).alias(ident))


def dissimilar(df: DataFrame, key: str, order: str, vector: str, threshold: float) -> DataFrame:
    """Rows whose vector's cosine with the last row kept before it is below ``threshold``; a key's first row is kept. A fold per key."""
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        kept, last = [], None
        for v in pdf[vector]:
            v = np.asarray(v, float)
            ok = last is None or float(v @ last) < threshold * float(np.linalg.norm(v) * np.linalg.norm(last))
            kept.append(ok)
            last = v if ok else last
        return pdf[kept]

    return df.groupBy(key).applyInPandas(run, df.schema)
