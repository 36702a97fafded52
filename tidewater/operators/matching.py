"""Predictions to truths by several keys in turn, where a used truth is not found again.

What does not depend on order is done by joins. The rest is the fixed point of rounds:
each round takes the places at which truths are used from the round before, lets claims
by triplet win where they come first, and folds only the predictions that no exact key
places over the free truths of their base name. A prediction's outcome depends on earlier
predictions only, so the k-th round has at least the first k that depend on others right,
and when a round changes nothing, all of them are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.sources.scratch import written

TRIPLET = ["task", "source", "idx"]


def base_name(c: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.substring_index(c, "/", -1), r"(?<=.)\.[^.]*$", "")


def normal(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def _last(truths: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The last truth of each key, under ``name``."""
    return truths.groupBy(*keys).agg(F.max_by("triplet", "pos").alias(name))


def _first_free(truths: pd.DataFrame, asking: pd.DataFrame) -> list[tuple[int, str]]:
    """(pos, triplet) of each asking row of a base name: the first free truth whose question starts its own, else the first free one.

    ``used`` is the place from which a truth is used by others.
    """
    names, questions, used = truths["triplet"].tolist(), truths["q"].tolist(), truths["used"].tolist()
    by_name: dict[str, list[int]] = {}
    by_question: dict[str, list[int]] = {}
    for i, (name, q) in enumerate(zip(names, questions, strict=True)):
        by_name.setdefault(name, []).append(i)
        if q:
            by_question.setdefault(q, []).append(i)
    lengths = sorted({len(q) for q in by_question})
    gone, out, first = [False] * len(names), [], 0
    for pos, q in zip(asking["pos"].tolist(), asking["q"].tolist(), strict=True):
        free = lambda i: not gone[i] and not used[i] < pos  # noqa: E731, B023
        same = [next((i for i in by_question.get(q[:n], ()) if free(i)), None) for n in lengths if n <= len(q)]
        found = min((i for i in same if i is not None), default=None)
        if found is None:
            while first < len(names) and (gone[first] or used[first] < pos):
                first += 1  # used earlier is used for all that come later
            found = first if first < len(names) else None
        if found is not None:
            out.append((pos, names[found]))
            for i in by_name[names[found]]:
                gone[i] = True
    return out


def _fold(asking: DataFrame, truths: DataFrame, used: DataFrame) -> DataFrame:
    """(pos, triplet, base) of the predictions that only free truths can place, per base name."""

    def run(key: tuple, own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("pos").fillna({"used": float("inf")})
        found = _first_free(known, own.sort_values("pos"))
        return pd.DataFrame([(p, t, key[0]) for p, t in found], columns=["pos", "triplet", "base"])

    about = truths.join(asking.select("base").distinct(), "base", "left_semi").select("pos", "triplet", "q", "base")
    about = about.join(used, ["triplet", "base"], "left").withColumn("used", F.col("used").cast("double"))
    return asking.select("pos", "q", "base").groupBy("base").cogroup(about.groupBy("base")).applyInPandas(run, "pos long, triplet string, base string")


def consuming_match(preds: DataFrame, truths: DataFrame) -> DataFrame:
    """Each prediction's truth by the first key that finds one; used truths are not found again by the keys that look for unused ones.

    preds: pos, task, source, idx, video, q, a; truths: pos, task, source, idx, video, q.
    Keys in order: (task, source, idx) unused; (video, q); (base name, q); an unused
    truth of the base name whose question starts the prediction's; the first unused
    truth of the base name. ``pos`` is the order, unique in each table. Of truths with one
    key the last counts. Predictions without a truth are left out, as are those of a null
    video that no triplet places; truths have no nulls but in q. Returns task, source, idx,
    a and pos. Only predictions that no exact key places meet in one task per base name.
    """
    name = lambda: F.to_json(F.struct(*[F.col(c).cast(k).alias(c) for c, k in zip(TRIPLET, ("string", "string", "long"), strict=True)]))
    t = truths.select(F.col("pos").cast("long"), name().alias("triplet"), F.col("video").cast("string").alias("video"), normal(F.col("q")).alias("q"), base_name(F.col("video")).alias("base"))
    given = F.col("task").isNotNull() & F.col("source").isNotNull() & F.col("idx").isNotNull()
    p = preds.select(F.col("pos").cast("long"), F.when(given, name()).alias("triplet"), F.col("video").cast("string").alias("video"), normal(F.col("q")).alias("q"), base_name(F.col("video")).alias("base"))
    p = p.join(t.select("triplet", F.lit(True).alias("known")).distinct(), "triplet", "left").withColumn("claim", F.when(F.col("known"), F.col("triplet")))
    p = p.join(_last(t, ["video", "q"], "by_video"), ["video", "q"], "left").join(_last(t, ["base", "q"], "by_base"), ["base", "q"], "left")
    p = written(p.select("pos", "claim", F.coalesce("by_video", "by_base").alias("fixed"), "base", "q"), "match")
    settled = p.where("claim IS NULL AND fixed IS NOT NULL").select("pos", F.col("fixed").alias("triplet"))
    sure = settled.groupBy("triplet").agg(F.min("pos").alias("sure"))
    claims = p.where("claim IS NOT NULL")
    first = claims.groupBy(F.col("claim").alias("triplet")).agg(F.min("pos").alias("claimed"))
    falls = p.where("fixed IS NULL AND base IS NOT NULL")
    moved, mark = preds.sparkSession.createDataFrame([], "pos long, triplet string, base string"), None
    while True:
        # moved: what the last round placed by other keys than the triplet; base is null where an exact key did
        elsewhere = moved.groupBy("triplet").agg(F.min("pos").alias("moved"))
        at = first.join(sure, "triplet", "left").join(elsewhere, "triplet", "left")
        wins = at.where(F.col("claimed") < F.least(F.coalesce("sure", F.lit(1 << 62)), F.coalesce("moved", F.lit(1 << 62)))).select(F.col("claimed").alias("pos"), "triplet")
        lost = claims.join(wins.select("pos"), "pos", "left_anti")
        by_key = lost.where("fixed IS NOT NULL").select("pos", F.col("fixed").alias("triplet"), F.lit(None).cast("string").alias("base"))
        asking = falls.join(wins.select("pos"), "pos", "left_anti")
        # a fold knows its own placements; those of folds of other base names count where truths share a triplet
        others = moved.where("base IS NOT NULL").withColumnRenamed("base", "of")
        shared = t.select("triplet", "base").distinct().join(others, "triplet").where(F.col("base") != F.col("of")).select("triplet", "base", "pos")
        everywhere = wins.select("triplet", "pos").unionByName(sure.select("triplet", F.col("sure").alias("pos"))).unionByName(by_key.select("triplet", "pos"))
        used = t.select("triplet", "base").distinct().join(everywhere, "triplet").unionByName(shared).groupBy("triplet", "base").agg(F.min("pos").alias("used"))
        moved = written(by_key.unionByName(_fold(asking, t, used)), "match-round")
        last, mark = mark, tuple(moved.agg(F.count("*"), F.sum(F.xxhash64("pos", "triplet").cast("decimal(38,0)"))).first())
        if mark == last:
            break
    placed = settled.unionByName(wins).unionByName(moved.select("pos", "triplet"))
    fields = F.from_json("triplet", "task string, source string, idx long").alias("t")
    return placed.join(preds.select(F.col("pos").cast("long"), "a"), "pos").select(fields, "a", "pos").select("t.*", "a", "pos")
