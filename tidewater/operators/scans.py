"""Recurrences and greedy cuts along the rows of a key, without one task for a whole key.

Keys of more than ``BLOCK`` rows are cut into blocks of consecutive rows. A recurrence
x = a x' + b is a chain of affine maps: each block's maps are composed to one, the few
maps of a key's blocks are folded in order, and each block then runs from what comes in.
A greedy cut is a chain of pointers: each block finds where a chain that enters it at a
given row leaves it, pointer doubling over those entries finds the rows at which a key's
one chain enters each block, and each block then walks its part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.sources.scratch import written

from .retrieval import small
from .sequences import joined_on, ranged, with_ordinal

#: Rows of a key that one task takes.
BLOCK = 200_000


def _blocked(df: DataFrame, keys: list[str], order: list[str], block: int) -> DataFrame:
    """``df`` with ``__range``: ranges of the first column of ``order`` for keys of more than ``block`` rows, 0 for all others."""
    sizes = df.groupBy(*keys).agg((F.count("*") > block).alias("__large"))
    if sizes.where("__large").isEmpty():
        return df.withColumn("__range", F.lit(0))
    return joined_on(ranged(df, order[0]), small(sizes), keys).withColumn("__range", F.when(F.col("__large"), F.col("__range")).otherwise(0)).drop("__large")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[bool, int, int]]]]:
    """Batches of sorted rows with the (starts a group, from, to) stretches of rows of equal first ``n_keys`` columns."""
    last = None
    for batch in batches:
        rows = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)], strict=True))
        cuts = [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]]
        stretches, begin = [], 0
        for end in [*cuts, len(rows)]:
            if end > begin:
                stretches.append((rows[begin] != last, begin, end))
                last, begin = rows[end - 1], end
        yield batch, stretches


def affine_scan(df: DataFrame, keys: list[str], order: list[str], a: Column, b: Column, name: str, *, start: float = 0.0, reverse: bool = False, block: int | None = None) -> DataFrame:
    """``df`` with ``name``: x = a x' + b, where x' is the value of the row before (``start`` for a key's first), in ``order`` or reversed.

    Null a or b count as 1 or 0; null keys are a key. Rows that tie in ``order`` have
    no defined result; rows that tie in its first column stay in one block.
    """
    group = [*keys, "__range"]
    placed = _blocked(df, keys, order, block or BLOCK).withColumns({"__a": F.coalesce(a.cast("double"), F.lit(1.0)), "__b": F.coalesce(b.cast("double"), F.lit(0.0))})
    ordered = [F.desc(c) if reverse else F.asc(c) for c in order]
    rows = lambda d: d.repartition(*group).sortWithinPartitions(*group, *ordered)
    summary_schema = T.StructType([*[placed.schema[c] for c in group], T.StructField("A", T.DoubleType()), T.StructField("B", T.DoubleType())])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, out = (1.0, 0.0), None
        n = len(group)

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*out, pa.array([whole[0]]), pa.array([whole[1]])], names=summary_schema.fieldNames())

        for batch, stretches in _groups(batches, n):
            x, y = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            for new, begin, end in stretches:
                if new:
                    if out is not None:
                        yield one()
                    whole, out = (1.0, 0.0), [batch.column(i).slice(begin, 1) for i in range(n)]
                p, q = whole
                for i in range(begin, end):
                    p, q = p * x[i], q * x[i] + y[i]
                whole = (p, q)
        if out is not None:
            yield one()

    several = placed.where("__range > 0").select(*keys).distinct()
    if several.isEmpty():
        started = placed.withColumn("__x", F.lit(start))
    else:
        maps = rows(placed.select(*group, "__a", "__b", *order)).mapInArrow(lambda it: compose(it), summary_schema)
        maps = written(maps, "maps")  # a row per key and block
        parts = F.sort_array(F.collect_list(F.struct((-F.col("__range") if reverse else F.col("__range")).alias("r"), "A", "B")))
        # what enters each block: the maps of the blocks before it, folded in order
        enter = F.aggregate("__parts", F.struct(F.lit(start).alias("x"), F.array().cast("array<double>").alias("xs")), lambda s, m: F.struct((s["x"] * m["A"] + m["B"]).alias("x"), F.concat(s["xs"], F.array(s["x"])).alias("xs")))["xs"]
        entered = maps.groupBy(*keys).agg(parts.alias("__parts")).select(*keys, F.explode(F.arrays_zip(F.transform("__parts", lambda m: F.abs(m["r"])).alias("__range"), enter.alias("__x"))).alias("e"))
        entered = entered.select(*keys, F.col("e.__range").cast("int").alias("__range"), F.col("e.__x").alias("__x"))
        started = joined_on(placed, small(entered), group)
    keep = [c for c in df.columns if c not in keys and c != name]
    schema = T.StructType([*[df.schema[c] for c in [*keys, *keep]], T.StructField(name, T.DoubleType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, n = start, len(group)
        for batch, stretches in _groups(batches, n):
            x, y, come = (batch.column(i).to_pylist() for i in (n, n + 1, n + 2))
            out = []
            for new, begin, end in stretches:
                value = come[begin] if new else value
                for i in range(begin, end):
                    value = value * x[i] + y[i]
                    out.append(value)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], *[batch.column(i) for i in range(n + 3, n + 3 + len(keep))], pa.array(out, pa.float64())], names=schema.fieldNames())

    inner = rows(started).select(*group, "__a", "__b", "__x", *keep)
    return inner.mapInArrow(walk, schema).select(*[c for c in df.columns if c != name], name)


def following(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, *, block: int | None = None) -> DataFrame:
    """``df`` with ``name``, the ``value`` of the key's next row or null; blocks look over their edge by their first row."""
    group = [*keys, "__range"]
    placed = _blocked(df, keys, order, block or BLOCK)
    own = F.lead(F.struct(F.col(value).alias("v"))).over(W.partitionBy(*group).orderBy(*order))
    firsts = placed.groupBy(*group).agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__f"))
    nexts = firsts.withColumn("__next", F.lead("__f").over(W.partitionBy(*keys).orderBy("__range"))).drop("__f")  # a row per key and block
    return joined_on(placed.withColumn("__own", own), small(nexts), group).withColumn(name, F.coalesce("__own", "__next")["v"]).drop("__own", "__next", "__range")


def generalized_advantage(df: DataFrame, keys: list[str], order: list[str], reward: str, value: str, gamma: float, lam: float, *, block: int | None = None) -> DataFrame:
    """``df`` with ``advantage``: delta + gamma lam times the next row's, delta = reward + gamma next value - value; nothing follows a key's last row."""
    looked = following(df, keys, order, value, "__after", block=block)
    delta = F.col(reward) + gamma * F.coalesce("__after", F.lit(0.0)) - F.col(value)
    return affine_scan(looked, keys, order, F.lit(gamma * lam), delta, "advantage", reverse=True, block=block).drop("__after")


def controller_factor(kl: Column, target: float, horizon: float, n: int) -> Column:
    """What one step of the adaptive coefficient multiplies it by."""
    return 1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), kl / target - 1)) * (n / horizon)


def controller_path(df: DataFrame, keys: list[str], order: list[str], kl: str, start: float, target: float, horizon: float, n: int, *, block: int | None = None) -> DataFrame:
    """``df`` with ``coefficient``, the adaptive coefficient after each row."""
    return affine_scan(df, keys, order, controller_factor(F.col(kl), target, horizon, n), F.lit(0.0), "coefficient", start=start, block=block)


def controller_end(df: DataFrame, keys: list[str], kl: str, start: float, target: float, horizon: float, n: int) -> DataFrame:
    """keys and ``coefficient`` after all rows: factors multiply in any order, so tasks multiply theirs before the shuffle."""
    return df.groupBy(*keys).agg((start * F.product(controller_factor(F.col(kl), target, horizon, n))).alias("coefficient"))


# greedy cuts

_SENTENCE_END = (".", "?", "!")


class _Clips:
    """A block of a transcript: rows from ``first`` on, times up to where a clip from its last row can reach."""

    def __init__(self, first: int, total: int, times: list[float] | np.ndarray, starts: list[bool] | np.ndarray, most: float, gap: float) -> None:
        self.first, self.end, self.total = first, first + len(starts), total
        t = np.asarray(times)
        n = len(starts)
        # the first row after each whose time is more than ``most`` later, or that comes after a gap, at the latest the last row
        over = np.searchsorted(t, t[:n] + most, side="right")
        gaps = np.append(np.flatnonzero(np.diff(t) > gap) + 1, len(t))
        nxt = np.minimum(np.maximum(over, np.arange(n) + 1), gaps[np.searchsorted(gaps, np.arange(n), side="right")])
        self.next = np.minimum(nxt, max(total - 1 - first, 0)).tolist()
        # the first row from each on at which a clip may start; n if there is none
        able = np.append(np.flatnonzero(starts), n)
        self.start_at = able[np.searchsorted(able, np.arange(n))].tolist()

    def step(self, p: int) -> tuple[int | None, int | None]:
        """(start of the clip that is cut from row p on, or None, and the row at which the next one is looked for)."""
        s = self.start_at[p - self.first]
        if self.first + s == self.end:
            return None, self.end if self.end < self.total else None
        if self.first + s + 1 >= self.total:
            return None, None
        return self.first + s, self.first + self.next[s]

    def whole(self, t: np.ndarray, least: float) -> list[tuple[int, int]]:
        """(first, n) of the clips of at least ``least``, if the block is all of a transcript and ``t`` its times."""
        at, out = 0, []
        while at is not None and at < self.end:
            s, after = self.step(at)
            if s is not None and t[after - 1] - t[s] >= least:
                out.append((s, after - s))
            at = after
        return out

    def exit(self, p: int) -> int | None:
        while p is not None and p < self.end:
            p = self.step(p)[1]
        return p


def _reached(exits: DataFrame, key: str) -> DataFrame:
    """(key, p): all rows that the chain from row 0 enters blocks at, by pointer doubling over ``exits`` (key, p, q)."""
    jump = written(exits.where("q IS NOT NULL"), "jumps")
    reached = written(exits.select(key).distinct().select(key, F.lit(0).cast("long").alias("p")), "reached")
    while not jump.isEmpty():
        further = joined_on(reached, jump, [key, "p"]).select(key, F.col("q").alias("p"))
        reached = written(reached.unionByName(further).distinct(), "reached")
        beyond = jump.select(key, F.col("p").alias("q"), F.col("q").alias("r"))
        jump = written(joined_on(jump, beyond, [key, "q"]).select(key, "p", F.col("r").alias("q")), "jumps")
    return reached


_CLIP = (("first", T.LongType()), ("n", T.LongType()), ("start", T.DoubleType()), ("end", T.DoubleType()))


def cut_clips(words: DataFrame, key: str, *, least: float = 30, most: float = 240, gap: float = 3, by: str = "end", sentences: bool = False, block: int | None = None) -> DataFrame:
    """Greedy clips per key: (key, clip, first, n, start, end).

    words: key, pos, start, end, word. ``by`` is the time that spans and gaps are
    measured in; a time that falls counts as the latest before it in its block. A clip
    ends before a word over the span or the gap; the last word of a transcript that ends
    without either is not part of its clip. With ``sentences`` a clip starts after
    sentence-final punctuation at an upper-case word. ``first`` counts the key's words by pos.
    Keys whose pos stay below ``block`` take one shuffle of their words; others are cut block by block.
    """
    block = block or BLOCK
    rows = words.select(key, F.expr(f"floor(pos / {block})").alias("part"), "pos", F.col(by).cast("double").alias("t"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), *(["word"] if sentences else []))
    schema = T.StructType([rows.schema[key], *[T.StructField(n, t) for n, t in _CLIP]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            name, part = table.column(0)[0].as_py(), table.column(1)[0].as_py()
            if part != 0:  # a key of more blocks: cut below
                return pa.RecordBatch.from_arrays([pa.array([name], schema_arrow), *[pa.array([None], k) for k in kinds]], names=schema.fieldNames())
            t = np.maximum.accumulate(table.column(3).to_numpy())
            said = [None, *table.column(6).to_pylist()] if sentences else []
            starts = [not sentences or i == 0 or bool(said[i] and said[i].endswith(_SENTENCE_END) and said[i + 1] and said[i + 1].isupper()) for i in range(len(t))]
            out = _Clips(0, len(t), t, starts, most, gap).whole(t, least)
            first = np.array([s for s, _ in out], np.int64)
            n = np.array([m for _, m in out], np.int64)
            a, b = table.column(4).to_numpy()[first], table.column(5).to_numpy()[first + n - 1]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(out), schema_arrow), pa.array(first), pa.array(n), pa.array(a), pa.array(b)], names=schema.fieldNames())

        for batch, stretches in _groups(batches, 2):
            schema_arrow = batch.column(0).type
            for new, begin, end in stretches:
                if new and held:
                    yield solved()
                    held.clear()
                held.append(batch.slice(begin, end - begin))
        if held:
            yield solved()

    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    found = written(rows.repartition(key, "part").sortWithinPartitions(key, "part", "pos").mapInArrow(run, schema), "clips")
    large = found.where("first IS NULL").select(key).distinct()
    if not large.isEmpty():
        beside = small(large.select(F.col(key).alias("__key")))
        own = F.col(key).eqNullSafe(F.col("__key"))
        found = found.where("first IS NOT NULL").join(beside, own, "left_anti").unionByName(_cut_blocks(words.join(beside, own, "left_semi"), key, least=least, most=most, gap=gap, by=by, sentences=sentences, block=block))
    number = (F.row_number().over(W.partitionBy(key).orderBy("first")) - 1).cast("long")  # a row per clip
    return found.select(key, number.alias("clip"), "first", "n", "start", "end")


def _cut_blocks(words: DataFrame, key: str, *, least: float, most: float, gap: float, by: str, sentences: bool, block: int) -> DataFrame:
    """(key, first, n, start, end) of the clips of keys of many words, as ``cut_clips``."""
    own = with_ordinal(words.select(key, "pos", "start", "end", "word"), [key], ["pos"], "i").withColumn("t", F.col(by).cast("double"))
    totals = own.groupBy(key).agg(F.count("*").alias("total"))
    own = joined_on(own, small(totals), [key]).withColumn("block", F.floor(F.col("i") / block))
    edges = own.where("total > " + str(block)).groupBy(key, "block").agg(F.max("t").alias("reach"))
    large = not edges.isEmpty()
    fields = [key, "block", "role", "i", "total", "t", "start", "end", "word"]
    rows = own.withColumn("role", F.lit(0)).select(*fields)
    schema = T.StructType([rows.schema[key], *[T.StructField(n, t) for n, t in (("p", T.LongType()), ("q", T.LongType()))]])
    if large:
        edges = written(edges, "edges")
        several = own.where(f"total > {block}")
        before = several.where((F.pmod("i", F.lit(block)) == block - 1) & (F.col("i") + 1 < F.col("total"))).withColumns({"block": F.col("block") + 1, "role": F.lit(-1)}).select(*fields)
        # rows that a clip from an earlier block can reach: the time before them is within ``most`` of that block's last
        back = edges.select(key, F.col("block").alias("b"), "reach")
        looked = written(following(several.withColumn("__down", -F.col("i")), [key], ["__down"], "t", "t_before", block=block).drop("__down"), "looked")
        halo, distance = None, 1
        while True:
            near = joined_on(looked.withColumn("b", F.col("block") - distance), small(back), [key, "b"])
            near = near.where((F.col("t_before") <= F.col("reach") + most) | (F.lit(distance == 1) & (F.col("i") == F.col("block") * block)))
            if near.isEmpty():  # then no block is reached from farther off either
                break
            halo, distance = near if halo is None else halo.unionByName(near), distance + 1
        after = halo.withColumns({"block": F.col("b"), "role": F.lit(1)}).select(*fields)
        rows = written(rows.unionByName(before).unionByName(after), "clip-rows")
    sorted_rows = lambda d: d.repartition(key, "block").sortWithinPartitions(key, "block", "role", "i")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple]]]:
        """Rows of each (key, block); role order puts the row before first and those after last."""
        held, name = [], None
        for batch, stretches in _groups(batches, 2):
            columns = [batch.column(i).to_pylist() for i in range(2, batch.num_columns)]
            for new, begin, end in stretches:
                if new and held:
                    yield name, held
                    held = []
                name = batch.column(0).slice(begin, 1) if new else name
                held += zip(*[c[begin:end] for c in columns], strict=True)
        if held:
            yield name, held

    def clips_of(held: list[tuple]) -> tuple[_Clips, list[tuple]]:
        mine = [r for r in held if r[0] == 0]
        prior = next((r[6] for r in held if r[0] < 0), None)
        texts = [prior, *[r[6] for r in mine]]
        starts = [not sentences or mine[k][1] == 0 or bool(texts[k] and texts[k].endswith(_SENTENCE_END) and texts[k + 1] and texts[k + 1].isupper()) for k in range(len(mine))]
        times = np.maximum.accumulate([r[3] for r in held if r[0] >= 0]).tolist()
        return _Clips(mine[0][1], mine[0][2], times, starts, most, gap), mine

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held in blocks(batches):
            clips, mine = clips_of(held)
            p = [r[1] for r in mine if r[7]]
            yield pa.RecordBatch.from_arrays([pa.array(name.to_pylist() * len(p), name.type), pa.array(p, pa.int64()), pa.array([clips.exit(x) for x in p], pa.int64())], names=schema.fieldNames())

    out_schema = T.StructType([rows.schema[key], *[T.StructField(n, t) for n, t in _CLIP]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held in blocks(batches):
            clips, mine = clips_of(held)
            every = {r[1]: r for r in held if r[0] >= 0}
            entry = mine[0][7]
            found, p = [], entry
            while p is not None and p < clips.end:
                s, q = clips.step(p)
                if s is not None and every[q - 1][3] - every[s][3] >= least:
                    found.append((s, q - s, every[s][4], every[q - 1][5]))
                p = q
            if found:
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(name.to_pylist() * len(found), name.type), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=out_schema.fieldNames())

    entries = None
    if large:
        # a chain can enter a block at its first row or at rows that an earlier block reaches
        reachable = rows.where("role = 1").select(key, "i").distinct().withColumn("__in", F.lit(True))
        reachable = small(reachable.select(F.col(key).alias("__key"), F.col("i").alias("__i"), "__in"))
        marked = rows.where(f"total > {block}").join(reachable, F.col(key).eqNullSafe(F.col("__key")) & (F.col("i") == F.col("__i")), "left")
        marked = marked.withColumn("__in", (F.col("role") == 0) & (F.coalesce("__in", F.lit(False)) | (F.col("i") == F.col("block") * block)))
        exits = sorted_rows(marked.select(*fields, "__in")).mapInArrow(lambda it: leave(it), schema)
        entries = _reached(exits, key).withColumn("block", F.floor(F.col("p") / block)).groupBy(key, "block").agg(F.min("p").alias("entry"))
    if entries is None:
        placed = rows.withColumn("entry", F.lit(0).cast("long"))
    else:
        found = small(entries.select(F.col(key).alias("__key"), F.col("block").alias("__block"), "entry"))
        placed = rows.join(found, F.col(key).eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__block")), "left").withColumn("entry", F.when(F.col("total") <= block, F.lit(0).cast("long")).otherwise(F.col("entry")))
    found = sorted_rows(placed.select(*fields, "entry")).mapInArrow(lambda it: walk(it), out_schema)
    return found


def cut_transcripts(transcripts: DataFrame, *, key: str, n: Column, least: float = 30, most: float = 240, gap: float = 3, by: str = "end", sentences: bool = False, block: int | None = None) -> DataFrame:
    """``cut_clips`` where each transcript is one row: its other columns with clip, first, n, start, end, a row per clip.

    transcripts: key, arrays start, end and, with ``sentences``, word, in the order of the
    words. Clips are cut inside the row, so no word is shuffled; rows of more than ``block``
    words are cut block by block, and there the key must be unique. ``n`` is the number of words of
    a row; 0 will do where it is at most ``block``.
    """
    block = block or BLOCK
    arrays = ["start", "end", *(["word"] if sentences else [])]

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(c, t) for c, t in _CLIP])))
    def cut(start: pa.Array, end: pa.Array, said: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(start), 0).to_numpy()
        bounds = np.append(0, np.cumsum(lengths)).tolist()
        a, b = (x.flatten().to_numpy(zero_copy_only=False) for x in (start, end))
        times = a if by == "start" else b
        able = np.full(len(a), not sentences)
        if sentences:
            words = said.flatten()
            after = np.flatnonzero(pc.fill_null(pc.match_substring_regex(words, f"[{''.join(_SENTENCE_END)}]\\z"), False).to_numpy(zero_copy_only=False)) + 1
            after = after[after < len(words)]
            able[after] = [bool(w) and w.isupper() for w in words.take(pa.array(after)).to_pylist()]
            able[[x for x in bounds[:-1] if x < len(a)]] = True
        first, size, offsets = [], [], [0]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if high > low:
                t = np.maximum.accumulate(times[low:high])
                out = _Clips(0, high - low, t, able[low:high], most, gap).whole(t, least)
                first += [low + s for s, _ in out]
                size += [m for _, m in out]
            offsets.append(len(first))
        first, size, offsets = np.array(first, np.int64), np.array(size, np.int64), np.array(offsets, np.int32)
        own = first - np.repeat(np.array(bounds[:-1], np.int64), np.diff(offsets))
        clips = pa.StructArray.from_arrays([pa.array(own), pa.array(size), pa.array(a[first], pa.float64()), pa.array(b[first + size - 1], pa.float64())], names=[c for c, _ in _CLIP])
        return pa.ListArray.from_arrays(pa.array(offsets), clips)

    kept = [c for c in transcripts.columns if c not in ("start", "end", "word")]
    long = F.coalesce(n > block, F.lit(False))
    once = cut.asNondeterministic()  # else the filter on empty arrays that Spark puts below the explode cuts a second time
    clips = once(*[F.col(c) for c in arrays], *([] if sentences else [F.lit(None).cast("array<string>")]))
    found = transcripts.where(~long).select(*kept, clips.alias("__clips")).select(*kept, F.posexplode("__clips").alias("clip", "__c"))
    found = found.select(*kept, F.col("clip").cast("long").alias("clip"), "__c.*")
    large = transcripts.where(long)
    if large.isEmpty():
        return found
    words = large.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "__w")).select(key, F.col("pos").cast("long").alias("pos"), "__w.*")
    words = words if sentences else words.withColumn("word", F.lit(None).cast("string"))
    return found.unionByName(joined_on(large.select(*kept), cut_clips(words, key, least=least, most=most, gap=gap, by=by, sentences=sentences, block=block), [key]))


def words_before(text: str, first: str) -> Column:
    """The words of ``text`` (words between single spaces) before its ``first``-th, which it must have: what stands left of that many spaces."""
    return F.expr(f"substring_index({text}, ' ', cast({first} as int))")
