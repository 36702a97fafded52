"""Runs of periodically repeated words, from longest previous factors and their blocks.

Method, for the words x of a text: tables of ranks of all stretches of 2**l words give
the suffix array, the common lengths of its neighbours and those of any two places; by
removing suffixes from the last to the first, each place gets its longest previous
factor (LPF) and an earlier place where that occurs. Blocks follow: one starts where
the last ended and is as long as its LPF, a word at least. A run [s, e) of period q,
with e - s >= 3 q, either touches or crosses the start b of a block, or lies strictly
inside one.

* Let b be the last start that it crosses, u the block there and t the one before. If
  the run began q words or more before t, then what follows t's start would occur q
  words earlier, to beyond b, and t would not end there. So b - s < |t| + q, and with
  e - b <= |u| follows 2 q < |t| + |u|. One of the stretches of q words before and after
  b is in the run, so the common lengths to both sides of (b - q, b) and (b, b + q), for
  all q <= (|t| + |u|) / 2, show all such runs: as many pairs as there are words.
* A run strictly inside a block is a copy of one of the block's earlier occurrence.
  Blocks are taken in order, known runs are kept by start, and each block copies them.

A run of at least ``least`` >= 24 words and three periods repeats 16 words or more, so
texts in which no stretch of that length occurs twice have none and skip the tables.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_bytes

#: A run has at least so many words, and so many of its periods.
LEAST, PERIODS = 24, 3
#: Words whose tables are held at once (about 150 bytes each); a longer text is taken alone.
GROUP = 200_000
#: Texts are looked at together up to so many words.
_SLICE = 500_000
#: Pairs of places compared at once.
_PAIRS = 500_000

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))

Run = tuple[int, int, int]


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _repeating(ids: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Which texts may hold a stretch of ``width`` words twice: equal hashes in one text."""
    n, owner = len(ids), np.repeat(np.arange(len(sizes)), sizes)
    if n < width:
        return np.zeros(len(sizes), bool)
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        base, total, done = np.uint64(0xBF58476D1CE4E5B9), np.zeros(n, np.uint64), 0
        for bit in range(width.bit_length()):  # total covers ``done`` words, h 2**bit
            step = 1 << bit
            if width & step:
                shifted = np.zeros(n, np.uint64)
                shifted[: n - done] = h[done:]
                total, done = total * base + shifted, done + step
            tail = np.zeros(n, np.uint64)
            tail[: max(n - step, 0)] = h[step:]
            h, base = h * base + tail, base * base
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    places = np.flatnonzero(np.arange(n) + width <= np.repeat(np.cumsum(sizes), sizes))
    by = places[np.argsort(total[places], kind="stable")]
    same = total[by][1:] == total[by][:-1]
    out = np.zeros(len(sizes), bool)
    out[owner[by[1:][same]]] = True
    return out


def _rank_tables(symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Table l has for each place the number of places whose next 2**l words come before its own; the last has no ties.

    ``ends`` is where the text of a place ends; symbols of different texts differ. A place
    at the end, n, ties with none.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate(([True], symbols[order][1:] != symbols[order][:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.repeat(first, size)
    tables, tied, step = [rank], order[np.repeat(size, size) > 1], 1
    while len(tied):
        now, after = tables[-1], tied + step
        second = np.where(after < ends[tied], now[np.minimum(after, n)] + 1, 0)
        by = np.lexsort((second, now[tied]))
        tied, second = tied[by], second[by]
        group = now[tied]
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        new = new_group | np.concatenate(([True], second[1:] != second[:-1]))
        at = np.arange(len(tied))
        rank = now.copy()
        rank[tied] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tables.append(rank)
        tied, step = tied[np.repeat(size, size) > 1], 2 * step
    return tables


def _common(tables: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words agree from places i and j (i < j, or in any order if both are below n) on, or with ``back`` before them."""
    i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for level in range(len(tables) - 1, -1, -1):
        table, width = tables[level], 1 << level
        if back:
            ok = (i >= width) & (j >= width)
            ok &= table[np.maximum(i - width, 0)] == table[np.maximum(j - width, 0)]
            moved = -width * ok
        else:
            ok = table[i] == table[j]
            moved = width * ok
        i, j, total = i + moved, j + moved, total + width * ok
    return total


def _previous_factors(order: np.ndarray, rank: np.ndarray, common: np.ndarray) -> tuple[list[int], list[int]]:
    """Longest previous factors and where they occur earlier: suffixes leave the sorted list from the last place to the first."""
    n = len(order)
    above, below = list(range(-1, n)), [*range(1, n + 1), 0]
    order, rank, common = order.tolist(), rank.tolist(), [*common.tolist(), 0]
    longest, source = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        up, down = above[r], below[r]
        x, y = common[r], common[down]
        if x >= y:
            if x:
                longest[i], source[i] = x, order[up]
        else:
            longest[i], source[i] = y, order[down]
            common[down] = x
        below[up], above[down] = down, up
    return longest, source


def _at_starts(tables: list[np.ndarray], starts: np.ndarray, most: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """The runs that touch or cross the starts: {(start, end): period}."""
    found: dict[tuple[int, int], int] = {}
    total = np.cumsum(most)
    for begin in range(0, int(total[-1]) if len(total) else 0, _PAIRS):
        at = np.arange(begin, min(begin + _PAIRS, int(total[-1])))
        k = np.searchsorted(total, at, side="right")
        q, b = at - (total[k] - most[k]) + 1, starts[k]
        right, left = b + q <= hi[k], b - q >= lo[k]
        i, q = np.concatenate((b[right], (b - q)[left])), np.concatenate((q[right], q[left]))
        after = _common(tables, i, i + q)
        before = _common(tables, i, i + q, back=True)
        ok = after + before + q >= np.maximum(least, PERIODS * q)
        for s, e, period in zip((i - before)[ok].tolist(), (i + q + after)[ok].tolist(), q[ok].tolist(), strict=True):
            if period < found.get((s, e), e):  # a multiple of the smallest period has the same ends
                found[s, e] = period
    return found


def _copied(found: dict[tuple[int, int], int], blocks: list[tuple[int, int, int]]) -> list[Run]:
    """(start, end, period) of all runs of a text by start: ``found`` and, block by block, those copied from earlier occurrences."""
    runs = sorted((s, e, q) for (s, e), q in found.items())
    for start, length, source in blocks:
        at = bisect.bisect_right(runs, (source + 1,))
        while at < len(runs) and runs[at][0] < source + length:
            s, e, q = runs[at]
            if e < source + length:
                copy = (s + start - source, e + start - source, q)
                place = bisect.bisect_left(runs, copy)
                if runs[place : place + 1] != [copy]:
                    runs.insert(place, copy)
            at += 1
    return runs


def _runs_of_group(texts: list[np.ndarray], least: int) -> list[list[Run]]:
    """(start, length, period) of the runs of each text, given as word numbers."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    words = np.concatenate(texts).astype(np.int64)
    tables = _rank_tables(owner * (int(words.max()) + 1) + words, ends[owner])
    rank = tables[-1][:-1]
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    neighbours = np.concatenate(([0], _common(tables, order[:-1], order[1:])))
    longest, source = _previous_factors(order, rank, neighbours)
    starts, most, long_blocks = [], [], [[] for _ in texts]
    for t, end in enumerate(ends.tolist()):
        at, before = end - len(texts[t]), 0
        while at < end:
            length = longest[at] or 1
            starts.append(at)
            most.append((before + length) // 2)
            if length > least + 1:
                long_blocks[t].append((at, length, source[at]))
            at, before = at + length, length
        starts.append(end)
        most.append(before // 2)
    starts, most = np.array(starts), np.array(most)
    text_of = np.cumsum(np.concatenate(([0], starts[1:] == starts[:-1])))  # a text's end is the next one's start
    found = _at_starts(tables, starts, most, (ends - sizes)[text_of], ends[text_of], least)
    by_text: list[dict] = [{} for _ in texts]
    for (s, e), q in found.items():
        by_text[int(owner[s])][s, e] = q
    out = []
    for t, first in enumerate((ends - sizes).tolist()):
        out.append([(s - first, e - s, q) for s, e, q in _copied(by_text[t], long_blocks[t])])
    return out


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[list[Run]]:
    """(start, length, period) of all runs of each text, by start, then period; texts are arrays of word numbers."""
    out: list[list[Run]] = [[] for _ in texts]
    if not texts:
        return out
    sizes = np.array([len(t) for t in texts])
    width = least - least // PERIODS  # a run's words but for its first period occur earlier: two thirds or more
    group, held = [], 0
    for k in np.flatnonzero(_repeating(np.concatenate(texts), sizes, width)).tolist():
        if group and held + len(texts[k]) > GROUP:
            for g, runs in zip(group, _runs_of_group([texts[g] for g in group], least), strict=True):
                out[g] = runs
            group, held = [], 0
        group.append(k)
        held += len(texts[k])
    if group:
        for g, runs in zip(group, _runs_of_group([texts[g] for g in group], least), strict=True):
            out[g] = runs
    return out


def _without_repeats(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by a space, without those of any run after its first period."""
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, period in runs:
            gone[start + period : start + length] = True
        words = [words[i] for i in np.flatnonzero(~gone).tolist()]
    return b" ".join(words)


Edit = Callable[[int | None, list[bytes]], list[bytes]]


def _annotate(least: int, edit: Edit | None) -> Callable[[], Callable[..., list]]:
    def make():
        ids = _Ids()

        def slices(docs: Iterator) -> Iterator[list[list[bytes]]]:
            held, n = [], 0
            for doc_id, text in docs:
                words = (text or b"").split()  # of bytes: at \x20 and \x09-\x0D only
                held.append(edit(doc_id, words) if edit and words else words)
                n += len(words)
                if n >= _SLICE:
                    yield held
                    held, n = [], 0
            yield held

        def work(text: pa.Array, doc_id: pa.Array | None = None) -> list[pa.Array]:
            known = doc_id.to_pylist() if doc_id is not None else [None] * len(text)
            rows, collapsed, counts = [], [], []
            for held in slices(zip(known, as_bytes(text), strict=True)):
                if len(ids) > 1_000_000:
                    ids.clear()
                numbers = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in held]
                for words, runs in zip(held, runs_of(numbers, least), strict=True):
                    counts.append(len(runs))
                    rows += runs
                    collapsed.append(_without_repeats(words, runs))
            columns = np.array(rows, np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(3)], ["start", "length", "period"])
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            return [pa.ListArray.from_arrays(offsets, structs), pa.array(collapsed, pa.binary()).cast(pa.string())]

        return work

    return make


def collapse_runs(docs: DataFrame, text_col: str = "text", *, least: int = LEAST, edit: Edit | None = None, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period by start, then period) and ``collapsed``, the text without repeats.

    Words are the stretches between white space (x20, x09 to x0D). A run is a stretch of
    at least max(``least``, 3 periods) words, as far as its smallest period reaches;
    ``collapsed`` joins the words by a space that are in no run after that run's first
    period. ``edit(id, words)`` may change the words of a text first.

    Null, empty and blank texts have no words: an empty array and an empty string. Rows
    are independent, so repeated rows get equal results and an empty table gives an empty
    one. Columns named ``runs`` or ``collapsed`` are replaced, others pass through. A text
    is one row in one task, with about 150 bytes a word if a stretch of 16 words repeats.
    """
    if least < 2 * PERIODS:
        raise ValueError("least must be 6 or more")
    fields = [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    return append_columns(docs, [text_col] + ([id_col] if edit else []), fields, _annotate(least, edit))


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The report's words: of one id in ten (by crc32) the words from a place on repeat a period; a null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def runs_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_runs, the run of greatest exponent and digests of all runs and of the collapsed text.

    Edge cases are those of ``collapse_runs``; without a run ``start``, ``length``,
    ``period`` and ``exponent_milli`` are null. A null doc_id's text is taken as it is.
    """
    found = collapse_runs(docs.select("doc_id", "text"), edit=periodic_tail)
    higher = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast(RUNS.elementType), lambda best, r: F.when(higher(r, best), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def brute_force(words: list, least: int = LEAST) -> list[Run]:
    """All runs by trying each period at each place; for tests."""
    n, out = len(words), {}
    for q in range(1, n // PERIODS + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - i >= max(least, PERIODS * q):
                out.setdefault((i, e + q), q)  # smaller periods come first
            i = e + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())
