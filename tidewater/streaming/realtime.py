"""Real-time turns: frames are sampled at ticks and handed over turn by turn, questions are answered in between.

A session of a key begins with its first frame, which is the time of tick 0, and ends with
an end mark. Tick j is at j * step and takes the first frame not before it. The first
turn has ``initial`` ticks, each later one ``steady``; a turn is complete when its last
tick has a frame, and at the end of the session what is left of ticks is a turn too. A
question is answered after the frames before it, of which those since the last
question are new.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.operators.sequences import joined_on, with_prefix_sum

#: What a row is.
FRAME, QUESTION, END = 0, 1, 2
COLUMNS = "session long, kind string, n long, start double, stop double, first_frame long, last_frame long, n_frames long"


def turns_batch(rows: DataFrame, key: str, *, step: int, initial: int, steady: int) -> DataFrame:
    """key and, per turn, answer and session end: session, kind, n (turn, question or number of turns), start, stop, first_frame, last_frame, n_frames.

    rows: key, us (microseconds), ident, what (FRAME, QUESTION or END). ``step`` is in
    microseconds; start and stop are seconds since the session's first frame. n_frames counts a
    turn's ticks, an answer's new frames or a session's frames. The last session of
    a key ends with its last row. Frames are aggregated by tick before they meet in a
    key's order. A null time is left out; rows of one time go by ident.
    """
    own = rows.where(F.col("us").isNotNull()).select(key, "us", "ident", "what")
    one = lambda what: F.when(F.col("what") == what, 1).otherwise(0)
    own = with_prefix_sum(own.withColumn("__end", one(END)), [key], ["us", "ident"], "__end", "session").drop("__end")
    group = [key, "session"]
    seen = with_prefix_sum(own.withColumn("__frame", one(FRAME)), group, ["us", "ident"], "__frame", "seen").drop("__frame")
    frames = own.where(F.col("what") == FRAME)
    origin = frames.groupBy(*group).agg(F.min("us").alias("origin"))
    first = joined_on(frames, origin, group).groupBy(*group, F.expr(f"(us - origin) div {step}").alias("tick")).agg(F.min(F.struct("us", "ident"))["ident"].alias("frame"))
    before = F.coalesce(F.lag("tick").over(W.partitionBy(*group).orderBy("tick")), F.lit(-1))  # a row per tick with frames of its own
    ticks = first.withColumn("from", before + 1).select(*group, "frame", F.explode(F.sequence("from", "tick")).alias("tick"))
    turn = F.when(F.col("tick") < initial, 0).otherwise(F.expr(f"1 + (tick - {initial}) div {steady}")).cast("long")
    none = F.lit(None)
    seconds = lambda c: (c * step).cast("double") / 1e6
    turns = ticks.groupBy(*group, turn.alias("n")).agg(F.min("tick").alias("a"), F.max("tick").alias("b"), F.min_by("frame", "tick").alias("first_frame"), F.max_by("frame", "tick").alias("last_frame"))
    shown = turns.select(*group, F.lit("turn").alias("kind"), "n", seconds(F.col("a")).alias("start"), seconds(F.col("b") + 1).alias("stop"), "first_frame", "last_frame", (F.col("b") - F.col("a") + 1).alias("n_frames"))
    asked = seen.where(F.col("what") == QUESTION)
    new = F.col("seen") - F.coalesce(F.lag("seen").over(W.partitionBy(*group).orderBy("us", "ident")), F.lit(0))
    empty = [none.cast("double").alias("start"), none.cast("double").alias("stop"), none.cast("long").alias("first_frame"), none.cast("long").alias("last_frame")]
    answers = asked.select(*group, F.lit("answer").alias("kind"), F.col("ident").alias("n"), *empty, new.alias("n_frames"))
    counts = own.groupBy(*group).agg(F.lit(0).cast("long").alias("n"), F.sum(one(FRAME)).alias("frames"))
    counts = counts.unionByName(turns.groupBy(*group).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("frames")))
    ends = counts.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("frames").alias("n_frames"))
    ends = ends.select(*group, F.lit("end").alias("kind"), "n", *empty, "n_frames")
    return shown.unionByName(answers).unionByName(ends)


class _Turns(StatefulProcessor):
    """State of a key: its session's counters, rows ahead of the watermark, and the frames of the turn that is open."""

    def __init__(self, key: str, step: int, initial: int, steady: int, expire: int) -> None:
        self.key, self.step, self.initial, self.steady, self.expire = key, step, initial, steady, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "session long, origin long, turn long, frames long, asked long, last long")
        self.waiting = handle.getListState("waiting", "us long, ident long, what long")
        self.open = handle.getListState("open", "us long, ident long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(u), int(i), int(w)) for pdf in rows for u, i, w in zip(pdf["us"], pdf["ident"], pdf["what"], strict=True)]
        self.waiting.appendList(new)
        last = max(u for u, *_ in new)
        self.handle.registerTimer(last // 1000 + 1)  # once the watermark has passed all of these
        self.handle.registerTimer((last + self.expire) // 1000 + 1)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        ready = sorted(r for r in rows if r[0] < mark)
        if len(ready) < len(rows):
            self.waiting.put([r for r in rows if r[0] >= mark])
        elif rows:
            self.waiting.clear()
        session, origin, turn, frames, asked, last = self.counters.get() if self.counters.exists() else (0, None, 0, 0, 0, None)
        held = [tuple(r) for r in self.open.get()]
        out: list[tuple] = []
        live = last is not None  # the session has a row

        def close() -> None:
            nonlocal session, origin, turn, frames, asked, held, live
            if origin is not None:
                turn = self._emit(out, session, origin, turn, held, True)
            out.append((session, "end", turn, None, None, None, None, frames))
            session, origin, turn, frames, asked, held, live = session + 1, None, 0, 0, 0, [], False

        for us, ident, what in ready:
            live, last = True, us
            if what == FRAME:
                origin = us if origin is None else origin
                held.append((us, ident))
                frames += 1
                if len(held) % 64 == 0:
                    turn, held = self._advance(out, session, origin, turn, held)
            elif what == QUESTION:
                out.append((session, "answer", ident, None, None, None, None, frames - asked))
                asked = frames
            else:
                close()
        if origin is not None:
            turn, held = self._advance(out, session, origin, turn, held)
        if live and len(ready) == len(rows) and last + self.expire < mark:
            close()  # nothing came for long: the session ends without a mark
        self.counters.update((session, origin, turn, frames, asked, last if live else None))
        if held:
            self.open.put(held)
        else:
            self.open.clear()
        yield self._frame([(key[0], *r) for r in out])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, *(c.split()[0] for c in COLUMNS.split(", "))])

    def _ticks(self, turn: int) -> tuple[int, int]:
        return (0, self.initial) if turn == 0 else (self.initial + (turn - 1) * self.steady, self.initial + turn * self.steady)

    def _emit(self, out: list, session: int, origin: int, turn: int, held: list, ends: bool) -> int:
        """Turns whose ticks all have a frame, and with ``ends`` the rest of the ticks; the number of the next turn."""
        if not held:
            return turn
        top = (held[-1][0] - origin) // self.step
        while True:
            a, b = self._ticks(turn)
            if a > top or b - 1 > top and not ends:
                return turn
            b = min(b - 1, top)
            at = [next(i for u, i in held if u >= origin + j * self.step) for j in (a, b)]
            out.append((session, "turn", turn, a * self.step / 1e6, (b + 1) * self.step / 1e6, *at, b - a + 1))
            turn += 1

    def _advance(self, out: list, session: int, origin: int, turn: int, held: list) -> tuple[int, list]:
        turn = self._emit(out, session, origin, turn, held, False)
        first = origin + self._ticks(turn)[0] * self.step
        return turn, [f for f in held if f[0] >= first] or held[-1:]

    def close(self) -> None:
        pass


def turns_stream(rows: DataFrame, key: str, *, at: str, delay: str, step: int, initial: int, steady: int, expire: int) -> DataFrame:
    """As ``turns_batch`` on a stream of rows in any order within ``delay`` of event time ``at``; append mode.

    Event-time timers hand over what the watermark has passed. A key without rows for
    ``expire`` microseconds ends its session as an end mark would. State of a key: the rows
    ahead of the watermark and the frames of one turn. Needs the RocksDB state store.
    """
    own = rows.withWatermark(at, delay).select(key, "us", "ident", "what", at).where(F.col("us").isNotNull())
    kind = rows.schema[key].dataType.simpleString()
    return own.groupBy(key).transformWithStateInPandas(_Turns(key, step, initial, steady, expire), f"{key} {kind}, {COLUMNS}", "Append", "EventTime")
