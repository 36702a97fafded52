"""Times, frames and windows as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_to_seconds(c: Column) -> Column:
    """'HH:MM:SS' (or any number of fields) to seconds."""
    parts = F.reverse(F.split(c, ":"))
    return F.aggregate(F.transform(parts, lambda x, i: x.cast("double") * F.pow(F.lit(60.0), i)), F.lit(0.0), lambda a, x: a + x)


def time_label(a: Column, b: Column) -> Column:
    return F.format_string("Time=%07.1f-%07.1fs", a, b)


def floor_to_grid(t: Column, fps: float, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(F.floor(t * fps) / fps, lo), hi)


def ceil_to_grid(t: Column, fps: float, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(F.ceil(t * fps) / fps, lo), hi)


def window_frames(start: Column, end: Column, fps: float, n: Column) -> Column:
    """Frame indices of a window, clamped to [0, n) and at least one."""
    a = F.least(F.greatest(F.floor(start * fps), F.lit(0)), n - 1)
    b = F.least(F.greatest(F.ceil(end * fps), a + 1), n)
    return F.sequence(a.cast("long"), (b - 1).cast("long"))


def shift_window(start: Column, end: Column, total: Column, place: str) -> Column:
    """New start of a window of the same length at head, q25, mid, q75 or tail."""
    room = F.greatest(total - (end - start), F.lit(0.0))
    return room * {"head": 0.0, "q25": 0.25, "mid": 0.5, "q75": 0.75, "tail": 1.0}[place]


def moved_window(length: Column, total: Column, share: float) -> Column:
    """New start of a window of ``length``: centred at a share of the total, at the start for 0 and at the end for 1; within the total."""
    room = F.greatest(total - length, F.lit(0.0))
    if share <= 0:
        return F.lit(0.0)
    wanted = total - length if share >= 1 else share * total - 0.5 * length
    return F.greatest(F.least(wanted, room), F.lit(0.0))


def frame_of(t: Column, fps: float, default: Column) -> Column:
    return F.coalesce((t * fps).cast("int"), default)


def uniform_positions(n: Column, k: int, *, rounded: bool = False) -> Column:
    """k positions from 0 to n-1 at equal steps, truncated or rounded half to even; all positions if n <= k."""
    step = (n - 1).cast("double") / (k - 1 if k > 1 else 1)
    f = F.rint if rounded else F.floor
    return F.when(n <= k, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: f(i * step).cast("int")))


def steady_group(i: Column, first: int = 6, then: int = 2) -> Column:
    """Group of a frame: one group of ``first`` frames, then groups of ``then``."""
    return F.when(i < first, F.lit(0)).otherwise(1 + F.floor((i - first) / then)).cast("long")


def moved_position(i: Column, start: Column, end: Column, target: Column) -> Column:
    """Where frame i lies after frames [start, end) moved to ``target`` of the remaining sequence."""
    size = end - start
    goal = F.when(target > start, F.greatest(target - size, F.lit(0))).otherwise(target)
    rest = F.when(i >= end, i - size).otherwise(i)
    return F.when((i >= start) & (i < end), goal + i - start).otherwise(F.when(rest >= goal, rest + size).otherwise(rest))


def smart_count(total: Column, rate: Column, fps: float, least: int = 4, most: int = 768, factor: int = 2) -> Column:
    """Frames to take of ``total`` at ``rate`` per unit of time for ``fps`` per unit: an even number within bounds, at most the total."""
    wanted = F.least(F.greatest(total / rate * fps, F.lit(float(least))), F.lit(float(most)), total.cast("double"))
    return (F.floor(wanted / factor) * factor).cast("int")


def linear_positions(n: Column, k: Column) -> Column:
    """k positions from 0 to n - 1 at equal steps, rounded half to even; k may exceed n."""
    step = F.when(k > 1, (n - 1).cast("double") / (k - 1)).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.rint(i * step).cast("int"))
