"""Lookup joins with fallbacks, interval and as-of joins, tracking."""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last of rows with the same key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def priority_lookup(left: DataFrame, right: DataFrame, tries: list[tuple[Column, Column]], value: str, default: str = "") -> DataFrame:
    """``value`` of the first (left key, right key) pair that matches; one equi-join per pair.

    Each right key keeps its last value in ``right``'s order of ``value``.
    """
    out, found = left, []
    for i, (a, b) in enumerate(tries):
        table = right.groupBy(b.alias(f"__k{i}")).agg(F.max(value).alias(f"__v{i}"))
        out = out.join(table, a == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        found.append(f"__v{i}")
    return out.withColumn(value, F.coalesce(*found, F.lit(default))).drop(*found)


def prefix_match(left: DataFrame, right: DataFrame, text: str, prefix: str) -> DataFrame:
    """Rows whose text starts with a prefix that is not empty.

    Both meet on as many first characters as the greatest power of two in the prefix's
    length, so a text has a key for each such power in use (at most the logarithm of the
    longest prefix), and what meets agrees in half of the prefix or more. A text's start is
    compared with prefixes of less than twice a key's characters, so it goes along cut to those.
    """
    cut = right.where(F.length(prefix) > 0).withColumn("__n", F.pow(F.lit(2), F.floor(F.log2(F.length(prefix)))).cast("int"))
    used = F.broadcast(cut.select("__n").distinct())  # at most 31 rows
    key = lambda c: F.xxhash64(F.expr(f"substring(`{c}`, 1, __n)"))
    texts = left.join(used, F.length(text) >= F.col("__n")).withColumns({"__h": key(text), "__head": F.expr(f"substring(`{text}`, 1, __n - 1 + __n)")})
    return texts.join(cut.withColumn("__h", key(prefix)), ["__n", "__h"]).where(F.col("__head").startswith(F.col(prefix))).drop("__n", "__h", "__head")


#: Shorter intervals are treated as of this length, 2 ** -20.
_LEAST_LEVEL = -20


def _level(start: str, end: str) -> Column:
    """The least power of two that is no shorter than the interval."""
    length = F.col(end).cast("double") - F.col(start)
    return F.greatest(F.when(length > 0, F.ceil(F.log2(length))).otherwise(_LEAST_LEVEL), F.lit(_LEAST_LEVEL)).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level))


def _nodes(intervals: DataFrame, start: str, end: str, level: Column) -> Column:
    """The cells of a level that an interval no longer than them touches: two at most."""
    return F.array_distinct(F.array(_cell(F.col(start), level), _cell(F.col(end), level)))


def stab(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Pairs with start <= at <= end, for intervals of any length.

    An interval lies in one or two cells of the level of its length; a point has a cell in each level in
    use (a few dozen at most), so neither side grows with the lengths. Intervals that end before they start are left out.
    """
    own = intervals.where(F.col(start) <= F.col(end)).withColumn("__level", _level(start, end))
    used = F.broadcast(own.select("__level").distinct())
    i = own.withColumn("__cell", F.explode(_nodes(own, start, end, F.col("__level"))))
    p = points.crossJoin(used).withColumn("__cell", _cell(F.col(at), F.col("__level")))  # levels in use
    return p.join(i, [*keys, "__level", "__cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__level", "__cell")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of intervals that share a point, each once, whatever their lengths: they meet in a cell of the longer one's level.

    ``a`` and ``b`` name start and end of ``left`` and ``right``; other columns have different names.
    """
    x = left.where(F.col(a[0]) <= F.col(a[1])).withColumn("__la", _level(*a))
    y = right.where(F.col(b[0]) <= F.col(b[1])).withColumn("__lb", _level(*b))
    levels = lambda df, c: F.broadcast(df.select(F.col(c).alias("__level")).distinct())

    def meet(p, pl, pab, q, ql, qab, strict):
        # p goes to all levels of q from its own on, where it touches two cells at most
        up = p.join(levels(q, ql), (F.col("__level") > F.col(pl)) if strict else (F.col("__level") >= F.col(pl)))
        up = up.withColumn("__cell", F.explode(_nodes(up, *pab, F.col("__level"))))
        home = q.withColumn("__level", F.col(ql)).withColumn("__cell", F.explode(_nodes(q, *qab, F.col(ql))))
        return up.join(home, [*keys, "__level", "__cell"])

    both = meet(x, "__la", a, y, "__lb", b, False).unionByName(meet(y, "__lb", b, x, "__la", a, True))
    first = F.greatest(F.col(a[0]).cast("double"), F.col(b[0]).cast("double"))  # only the cell of the first shared point counts
    hit = (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])) & (F.col("__cell") == _cell(first, F.col("__level")))
    return both.where(hit).drop("__la", "__lb", "__level", "__cell")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def run_diff(a: DataFrame, b: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Keys that are right in ``a`` and wrong in ``b``; of rows with the same key the last by ``order`` counts, if it is given."""
    if order:
        a, b = (df.groupBy(key).agg(F.max_by("correct", order).alias("correct")) for df in (a, b))
    return a.select(key, F.col("correct").alias("__a")).join(b.select(key, F.col("correct").alias("__b")), key).where("__a = 1 and __b = 0").select(key)


def greedy_pairs(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Each left row takes the first unused right row of its key, in id order; a null key takes none. Keys are numbered in ranges."""
    from .sequences import with_ordinal

    n = lambda df, c: with_ordinal(df.select(key, c).where(F.col(key).isNotNull()), [key], [c], "__n")
    return n(left, left_id).join(n(right, right_id), [key, "__n"]).drop("__n")


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def track_boxes(boxes: DataFrame, key: str, *, threshold: float = 0.7, least: int = 2) -> DataFrame:
    """Boxes (key, frame, x1, y1, x2, y2) to tracks, those of a frame in the order of x1 and y1; short tracks go.

    Each box goes to the live track whose last box it overlaps most, if by more than
    ``threshold``, else it opens a track. Of boxes that go to the same track the one
    that overlaps most stays and the others are gone. Tracks without a box in a
    frame end, and all end at a frame number without boxes. A fold per key.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracks: list[list[tuple]] = []
        live: list[list[tuple]] = []
        before = None
        # null frames are in no group; plain lists, as a table per frame costs far more than its boxes
        rows = pdf[pdf["frame"].notna()].sort_values(["frame", "x1", "y1"])
        boxes = zip(rows["frame"].astype("int64").tolist(), *[rows[c].astype("float64").tolist() for c in ("x1", "y1", "x2", "y2")], strict=True)
        for frame, own in groupby(boxes, key=itemgetter(0)):
            new = list(own)
            old = live if before == frame - 1 else []
            taken: dict[int, tuple[float, tuple]] = {}
            opened = []
            for b in new:
                s, i = max(((_iou(t[-1][1:], b[1:]), -i) for i, t in enumerate(old)), default=(0.0, 0))
                if s > threshold:
                    if -i not in taken or s > taken[-i][0]:
                        taken[-i] = (s, b)
                else:
                    opened.append([b])
            for i, (_, b) in taken.items():
                old[i].append(b)
            tracks += opened
            live, before = [old[i] for i in taken] + opened, frame
        out = [(pdf[key].iloc[0], k, *b) for k, t in enumerate(x for x in tracks if len(x) >= least) for b in t]
        return pd.DataFrame(out, columns=[key, "track", "frame", "x1", "y1", "x2", "y2"])

    kind = boxes.schema[key].dataType.simpleString()
    return boxes.groupBy(key).applyInPandas(run, f"{key} {kind}, track long, frame long, x1 double, y1 double, x2 double, y2 double")


def iou(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Intersection over union of boxes x1, y1, x2, y2."""
    side = lambda lo, hi, lo2, hi2: F.greatest(F.least(F.col(hi), F.col(hi2)) - F.greatest(F.col(lo), F.col(lo2)), F.lit(0.0))
    area = lambda c: (F.col(c[2]) - F.col(c[0])) * (F.col(c[3]) - F.col(c[1]))
    both = side(a[0], a[2], b[0], b[2]) * side(a[1], a[3], b[1], b[3])
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def suppress_overlaps(boxes: DataFrame, key: str, threshold: float = 0.5, ident: str = "id") -> DataFrame:
    """Non-maximum suppression per key: by score, then x1, then id, a box goes if its IoU with a kept one is over ``threshold``.

    boxes: key, ``ident`` (unique; not needed), x1, y1, x2, y2, score. Boxes whose widths meet are paired by
    levels and cells, so a key spreads over tasks; then, in rounds, boxes that no undecided
    better box overlaps are kept and what those overlap goes. Of boxes of equal place only the best is paired.
    """
    from tidewater.sources.scratch import written

    place = ["x1", "y1", "x2", "y2"]
    if ident not in boxes.columns:
        return suppress_overlaps(written(boxes.withColumn(ident, F.monotonically_increasing_id()), "boxes"), key, threshold, ident).drop(ident)
    order = F.struct(-F.col("score"), F.col("x1"), F.col(ident))
    best = F.min_by(F.struct(*[c for c in boxes.columns if c not in (key, *place)]), order)
    rows = written(boxes.groupBy(key, *place).agg(best.alias("__best")).select(key, *place, "__best.*"), "boxes")
    if threshold >= 1:
        return boxes
    a = rows.select(key, F.col(ident).alias("a"), *[F.col(c).alias(f"a_{c}") for c in place], (-F.col("score")).alias("a_s"))
    b = rows.select(key, F.col(ident).alias("b"), *[F.col(c).alias(f"b_{c}") for c in place], (-F.col("score")).alias("b_s"))
    pairs = overlapping(a, b, [key], ("a_x1", "a_x2"), ("b_x1", "b_x2"))
    before = F.struct("a_s", "a_x1", "a") < F.struct("b_s", "b_x1", "b")
    left = written(pairs.where(before & (iou(("a_x1", "a_y1", "a_x2", "a_y2"), ("b_x1", "b_y1", "b_x2", "b_y2")) > threshold)).select("a", "b"), "overlaps")
    gone = None
    while not left.isEmpty():
        heads = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")  # no undecided better box overlaps them
        out = written(left.join(heads, "a", "left_semi").select("b").distinct(), "suppressed")
        gone = out if gone is None else gone.unionByName(out)
        left = written(left.join(out, "b", "left_anti").join(out.select(F.col("b").alias("a")), "a", "left_anti"), "overlaps")
    kept = rows if gone is None else rows.join(gone.distinct().withColumnRenamed("b", ident), ident, "left_anti")
    return kept.select(*boxes.columns)


def keyed_lookup(left: DataFrame, right: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """``left`` with the ``value`` of its key; of rows with the same key the last by ``order`` counts, and an empty value there is an error."""
    last = right.groupBy(*keys).agg(F.max_by(value, order).alias(value))
    checked = F.when(F.length(value) > 0, F.col(value)).otherwise(F.raise_error(F.concat(F.lit("empty record for "), F.concat_ws(", ", *keys))))
    return left.join(last.withColumn(value, checked), keys)


def words_per_tick(words: DataFrame, keys: list[str], order: str, end: str, step: float) -> DataFrame:
    """``words`` with the tick at which a pointer that stops at the first word not over yet passes them: that of the latest end so far."""
    reached = F.max(end).over(W.partitionBy(*keys).orderBy(order))
    return words.withColumn("tick", F.ceil(reached / step) * step)


def covering(points: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], at: str, ident: str) -> DataFrame:
    """``points`` with ``cover``: 'query' inside an interval (start, end) of ``first``, else 'response' inside one of ``second``, else null."""
    hit = lambda spans, name: stab(points.select(*keys, ident, at), spans, keys, at, "start", "end").select(ident).distinct().withColumn(name, F.lit(True))
    both = points.join(hit(first, "__q"), ident, "left").join(hit(second, "__r"), ident, "left")
    return both.withColumn("cover", F.when(F.col("__q"), "query").when(F.col("__r"), "response")).drop("__q", "__r")
