"""Stateful stream operators, each with a batch twin of the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def blocks_batch(events: DataFrame, key: str, order: list[str], value: str, size: int) -> DataFrame:
    """Full blocks of ``size`` consecutive rows per key: (key, block, n, total); the remainder stays out."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    return (
        events.withColumn("block", F.floor(n / size)).groupBy(key, "block").agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).where(F.col("n") == size)
    )


def blocks_stream(events: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """As ``blocks_batch``, emitted when a block is full; state holds the unfinished block's count and sum.

    Rows of a key must arrive in order (within a trigger they are sorted by ts and event_id).
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, n, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        for v in pd.concat(list(frames)).sort_values(["ts", "event_id"])[value]:
            n, total = n + 1, total + float(v)
            if n == size:
                out.append((k[0], block, n, round(total, 4)))
                block, n, total = block + 1, 0, 0.0
        state.update((block, n, total))
        yield pd.DataFrame(out, columns=[key, "block", "n", "total"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, block long, n long, total double", "block long, n long, total double", "append", GroupStateTimeout.NoTimeout
    )


def segments(events: DataFrame, key: str, order: list[str], first: int, recent: int) -> DataFrame:
    """``segment`` of each row in a key's stream so far: init (the first), local (the last), global (between)."""
    w = W.partitionBy(key)
    i, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return events.withColumn("segment", F.when(i <= first, "init").when(i > n - recent, "local").otherwise("global"))


def sink_and_window(events: DataFrame, key: str, order: list[str], sink: int, window: int) -> DataFrame:
    """The first ``sink`` and last ``window`` rows of each key."""
    return segments(events, key, order, sink, window).where("segment <> 'global'").drop("segment")


def tumbling(events: DataFrame, length: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window("ts", length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, length: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def late_safe(events: DataFrame, delay: str) -> DataFrame:
    """With a watermark on ``ts``, which becomes a timestamp of the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def memory_answers(events: DataFrame, key: str, order: list[str], query: Column, reblock: Column, *, first: int, recent: int, size: int, then: int) -> DataFrame:
    """What each query row finds in its key's memory, which queries do not change.

    Frames (all other rows) fill the first segment, then the local window; what
    leaves the window is spilled in full blocks of ``size``, the rest remains. From
    the key's first re-blocking row on blocks have ``then`` frames and those spilled
    before are gone. Adds n_init, n_local, n_blocks and remainder.
    """
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(key)
    marked = events.withColumns({"__q": query, "__b": reblock})
    seen = marked.withColumns({"__f": F.count_if(~F.col("__q") & ~F.col("__b")).over(w), "__n": F.count_if("__b").over(w)})
    at = F.max(F.when(F.col("__b") & (F.col("__n") == 1), F.col("__f"))).over(whole)
    out = F.greatest(F.col("__f") - first - recent, F.lit(0))
    gone = F.when(F.col("__n") > 0, F.floor(F.greatest(at - first - recent, F.lit(0)) / size) * size).otherwise(0)
    width = F.when(F.col("__n") > 0, then).otherwise(size)
    answers = seen.withColumns({"__out": out, "__gone": gone, "__w": width}).where("__q")
    return answers.withColumns(
        {
            "n_init": F.least(F.col("__f"), F.lit(first)),
            "n_local": F.least(F.greatest(F.col("__f") - first, F.lit(0)), F.lit(recent)),
            "n_blocks": F.floor((F.col("__out") - F.col("__gone")) / F.col("__w")),
            "remainder": F.pmod(F.col("__out") - F.col("__gone"), F.col("__w")),
        }
    ).drop("__q", "__b", "__f", "__n", "__out", "__gone", "__w")


def memory_stream(events: DataFrame, key: str, *, query: str, reblock: str, kind: str, value: str, first: int, recent: int, size: int, then: int) -> DataFrame:
    """As ``memory_answers`` on a stream, a row per query; also the value of the key's first frame, which stays for its session.

    State: frames seen, frames spilled and gone, whether re-blocked, first value. Rows of a key
    must arrive in order (within a trigger they are sorted by ts and event_id).
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, gone, again, fixed = state.get if state.exists else (0, 0, False, None)
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            what = getattr(r, kind)
            beyond = max(n - first - recent, 0)
            if what == query:
                w = then if again else size
                out.append((k[0], r.event_id, min(n, first), min(max(n - first, 0), recent), (beyond - gone) // w, (beyond - gone) % w, fixed))
            elif what == reblock:
                gone, again = (gone, True) if again else (beyond // size * size, True)
            else:
                fixed = float(getattr(r, value)) if n == 0 else fixed
                n += 1
        state.update((n, gone, again, fixed))
        yield pd.DataFrame(out, columns=[key, "event_id", "n_init", "n_local", "n_blocks", "remainder", "fixed"])

    own = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(
        step, f"{key} {own}, event_id long, n_init long, n_local long, n_blocks long, remainder long, fixed double", "n long, gone long, again boolean, fixed double", "append", GroupStateTimeout.NoTimeout
    )


def new_frames(questions: DataFrame, events: DataFrame, key: str, order: str, until: str, at: str) -> DataFrame:
    """``questions`` with ``prev`` (the latest time of a question before it) and ``n_new``, the events in [prev, until) to be read before it.

    A question that asks about an earlier time reads nothing. One sort of both sides per key, no range join.
    """
    prev = F.coalesce(F.max(until).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    q = questions.withColumn("prev", prev)
    ends = q.select(key, order, F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col(until).alias("t")), F.struct(F.lit(-1).alias("sign"), F.col("prev").alias("t")))).alias("x"))
    ends = ends.where("x.t is not null").select(key, order, "x.sign", "x.t", F.lit(0).alias("one"))
    points = events.select(key, F.lit(None).cast(questions.schema[order].dataType).alias(order), F.lit(0).alias("sign"), F.col(at).alias("t"), F.lit(1).alias("one"))
    before = F.sum("one").over(W.partitionBy(key).orderBy("t", "one").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = ends.unionByName(points).withColumn("n", before).where("sign <> 0").groupBy(key, order).agg(F.sum(F.col("sign") * F.col("n")).alias("n_new"))
    return q.join(found, [key, order]).withColumn("n_new", F.greatest("n_new", F.lit(0)))


def append_batches(stream: DataFrame, path: str, checkpoint: str, work=None):
    """Start a query that writes each micro-batch, after ``work(frame, batch id)`` if it is given, to its own folder of ``path``.

    A batch that is run again replaces its folder, so nothing is written twice.
    """

    def write(frame: DataFrame, batch: int) -> None:
        (work(frame, batch) if work else frame).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_batches(frames: DataFrame, questions: DataFrame, key: str, path: str, checkpoint: str):
    """Interleave: each micro-batch of frames is joined with the questions (key, …) of its keys, and the answers are appended."""
    counted = lambda frame, _: frame.groupBy(key).agg(F.count("*").alias("n_frames")).join(questions, key)
    return append_batches(frames, path, checkpoint, counted)
