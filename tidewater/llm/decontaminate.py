"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items is built once (its size is checked)
and sent to the tasks; training texts stream through it word by word while it
tracks the longest suffix that occurs in some item. A match of ``min_words``
words, or of a whole shorter item, marks its words as hit.

Items beyond the size of one automaton are dealt to parts. One scan of the documents
looks the hashes of their windows up among those of all items, which tells the parts that
a document may hit; only such documents go to the tasks of these parts, each of which
builds its automaton from the part's items and decides.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WRITTEN, append_columns, as_bytes, discard, materialize, numbered, release_memory, word_list

#: Most bytes of test items in one automaton (a longer item has one of its own); larger benchmarks are dealt to parts. Two MiB of items of 30,000 different
#: words make about 345,000 states, 205 MB in the driver and in each Python worker.
MAX_AUTOMATON_BYTES = 2 << 20

#: Bytes of items whose window hashes one scan of the documents holds: about 13 bytes for each of their words.
MAX_FILTER_BYTES = 64 << 20
#: Documents that one task of a part scans, on average.
PART_DOCUMENTS = 20_000

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class ItemAutomaton:
    """Generalised suffix automaton over the words of many items."""

    def __init__(self, items: Iterable[tuple[str, bytes]], min_words: int = 13):
        self.min_words = min_words
        self.vocabulary: dict[bytes, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        runs = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in word_list(text)]
            if not ids:
                continue
            runs.append((item_id, ids))
            state = 0
            for t in ids:
                state = self._extend(state, t)
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.window_state = [0] * len(order)
        for v in order:
            if self.length[v] >= min_words:
                up = self.link[v]
                self.window_state[v] = v if self.length[up] < min_words else self.window_state[up]
        self.window_items: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for item_id, ids in runs:
            state = 0
            for k, t in enumerate(ids):
                state = self.moves[state][t]
                if k + 1 < min_words:
                    continue
                # the state of the item's prefix; its ancestor holds the last window
                self.window_items.setdefault(self.window_state[state], set()).add(item_id)
            if len(ids) < min_words:
                whole.setdefault(state, []).append((len(ids), item_id))
        self.short: list[tuple] = [()] * len(order)
        self.need = [min_words] * len(order)
        for v in order[1:]:
            self.short[v] = self.short[self.link[v]] + tuple(whole.get(v, ()))
            if self.short[v]:
                self.need[v] = min(min_words, min(n for n, _ in self.short[v]))

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.moves.append(moves)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, t: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.moves[q]))
        self.link[q] = copy
        while p >= 0 and self.moves[p].get(t) == q:
            self.moves[p][t] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, t: int) -> int:
        q = self.moves[last].get(t)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, t)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and t not in self.moves[p]:
            self.moves[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.moves[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, t)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (word positions, end exclusive, disjoint, ascending) and the items whose windows occur."""
        moves, link, length, need = self.moves, self.link, self.length, self.need
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        seen: set[int] = set()
        v = n = 0
        for i, t in enumerate(map(self.vocabulary.get, words)):
            if t is None:
                v = n = 0
                continue
            to = moves[v].get(t)
            if to is None:
                while to is None:  # the root has a move for every word of the vocabulary
                    v = link[v]
                    to = moves[v].get(t)
                n = length[v]
            v = to
            n += 1
            if n >= need[v]:
                start = -1
                if n >= self.min_words:
                    start = i - n + 1
                    seen.add(self.window_state[v])
                for k, item in self.short[v]:
                    if k <= n:
                        items.add(item)
                        if start < 0 or i - k + 1 < start:
                            start = i - k + 1
                if start >= 0:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        for state in seen:
            items |= self.window_items.get(state, set())
        return spans, items


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class _Hashes(dict):
    """64-bit hashes of words, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _windows(words: list[bytes], known: _Hashes, size: int) -> np.ndarray:
    """Hashes of all stretches of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
        return out ^ (out >> np.uint64(32)) ^ np.uint64(size)


def _window_parts(items: DataFrame, min_words: int) -> pa.Table:
    """(hash, part, size) of the windows of items (part, body)."""

    def run(batches):
        known = _Hashes()
        for batch in batches:
            hashes, parts, sizes = [np.zeros(0, np.uint64)], [], []
            for part, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = word_list(text)
                if words:
                    size = min(len(words), min_words)
                    hashes.append(_windows(words, known, size))
                    parts += [part] * len(hashes[-1])
                    sizes += [size] * len(hashes[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(parts, pa.int32()), pa.array(sizes, pa.int32())], names=["hash", "part", "size"])

    return items.select("part", "body").mapInArrow(run, "hash long, part int, size int").distinct().toArrow()


def _may_hit(docs: DataFrame, text_col: str, table: pa.Table, name: str) -> DataFrame:
    """``docs`` with ``name``, the parts that have a window whose hash one of the text's has."""
    hashes, parts, sizes = (table.column(c).to_numpy() for c in ("hash", "part", "size"))
    by = np.argsort(hashes.view(np.uint64), kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((hashes.view(np.uint64)[by], parts[by], sorted(set(sizes.tolist()))))

    def make():
        sorted_hashes, of, used = shared.value
        known = _Hashes()

        def work(texts):
            out = []
            for text in as_bytes(texts):
                words = word_list(text) if text else []
                found: set[int] = set()
                for size in used:
                    own = np.unique(_windows(words, known, size))
                    a, b = np.searchsorted(sorted_hashes, own, "left"), np.searchsorted(sorted_hashes, own, "right")
                    for x, y in zip(a[b > a].tolist(), b[b > a].tolist(), strict=True):
                        found.update(of[x:y].tolist())
                out.append(sorted(found))
                if len(known) > 1_000_000:
                    known.clear()
            return [pa.array(out, pa.list_(pa.int32()))]

        return work

    return append_columns(docs, [text_col], [T.StructField(name, T.ArrayType(T.IntegerType()))], make)


def _scan_parts(items: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """(id, hit_spans, hit_items) of texts (part, id, body) against the items (part, item, body) of their part.

    A part of many texts is dealt to several tasks; each gets the part's items first.
    """
    tasks = texts.groupBy("part").agg(F.ceil(F.count("*") / PART_DOCUMENTS).cast("int").alias("tasks"))  # a row per part
    dealt = texts.join(F.broadcast(tasks), "part").select("part", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("kind"), "id", F.lit(None).cast("string").alias("item"), "body")
    known = items.join(F.broadcast(tasks), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "item", "body")
    rows = known.unionByName(dealt).repartition("part", "task").sortWithinPartitions("part", "task", "kind", "item", "body")

    def run(batches):
        at, own, automaton = None, [], None
        for batch in batches:
            ids, spans, found = [], [], []
            for part, task, kind, key, item, body in zip(*[c.to_pylist() for c in batch.columns[:5]], as_bytes(batch.column(5)), strict=True):
                if (part, task) != at:
                    at, own, automaton = (part, task), [], None
                if kind == 0:
                    own.append((item, body))
                    continue
                automaton = automaton or ItemAutomaton(own, min_words)
                s, hits = automaton.scan(word_list(body))
                if s:
                    ids.append(key)
                    spans.append([{"start": a, "end": b} for a, b in s])
                    found.append(sorted(hits))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, _SPANS_ARROW), pa.array(found, pa.list_(pa.string()))], names=["id", "hit_spans", "hit_items"])
        release_memory()

    return rows.mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), *_FIELDS[1:]]))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", _SPANS),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_words: int = 13,
    max_automaton_bytes: int = MAX_AUTOMATON_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word positions) and ``hit_items`` (ids as sorted strings).

    Null or empty texts have no words and no hits; a null item id counts as the
    id ``null``; items without words match nothing; repeated rows are judged
    alike; input columns named like the new ones are replaced.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("body")
    ).where("body is not null")
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    if total <= max_automaton_bytes:
        rows = sorted((r.item, r.body.encode("utf-8", "surrogatepass")) for r in items.toLocalIterator())
        shared = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(rows, min_words))

        def one():
            automaton = shared.value

            def work(texts):
                n_words, spans, found = [], [], []
                for text in as_bytes(texts):
                    words = word_list(text) if text else []
                    s, hits = automaton.scan(words)
                    n_words.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    found.append(sorted(hits))
                return [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS_ARROW), pa.array(found, pa.list_(pa.string()))]

            return work

        return append_columns(docs, [text_col], _FIELDS, one)

    before, n_parts = len(WRITTEN), -(-total // max_automaton_bytes)
    items = items.withColumn("part", F.pmod(F.xxhash64("item", "body"), F.lit(n_parts)).cast("int"))
    scans = -(-total // MAX_FILTER_BYTES)
    inner, text, _ = numbered(docs, text_col)
    marked = inner
    for k in range(scans):
        table = _window_parts(items.where(F.pmod("part", F.lit(scans)) == k), min_words)
        marked = _may_hit(marked, text, table, f"parts{k}")
    every = F.array_distinct(F.concat(*[F.col(f"parts{k}") for k in range(scans)]))
    # numbers are those of the written table, which the rest reads
    written = materialize(marked.withColumn("__parts", every).drop(*[f"parts{k}" for k in range(scans)]).withColumn("__id", F.monotonically_increasing_id()), "candidates")
    hits = _scan_parts(items, written.select(F.explode("__parts").alias("part"), F.col("__id").alias("id"), F.col(text).alias("body")), min_words)
    by_text = hits.groupBy("id").agg(F.flatten(F.collect_list("hit_spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("__items"))
    joined = materialize(written.join(by_text, written["__id"] == by_text["id"], "left").drop("__id", "__parts", "id"), "hits")
    discard(docs.sparkSession, before, joined)

    def merged():
        def work(texts, spans, found):
            n_words = [len(word_list(t)) if t else 0 for t in as_bytes(texts)]
            own = [[{"start": a, "end": b} for a, b in _merge([(x["start"], x["end"]) for x in s or []], [])] for s in spans.to_pylist()]
            return [pa.array(n_words, pa.int64()), pa.array(own, _SPANS_ARROW), pa.array([f or [] for f in found.to_pylist()], pa.list_(pa.string()))]

        return work

    out = append_columns(joined, [text, "__spans", "__items"], _FIELDS, merged).drop("__spans", "__items")
    new = {f.name for f in _FIELDS}
    return out.select(*[out[f"c{i}"].alias(n) for i, n in enumerate(docs.columns) if n not in new], *[f.name for f in _FIELDS])


def hit_words() -> Column:
    return F.aggregate(
        "hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long")
    )


def is_contaminated(coverage: float = 0.05) -> Column:
    """Some word is hit and hits make up at least ``coverage`` of the words."""
    return (hit_words() > 0) & (hit_words() * F.lit(round(1 / coverage)) >= F.col("n_words"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    coverage: float = 0.05,
    max_span: int | None = None,
    **options,
) -> DataFrame:
    """Drop documents over the coverage limit; with ``max_span`` also cut longer hit spans out of the others.

    Columns of ``docs`` are kept as they are, whatever their names. Rows without hits,
    null and empty texts among them, are unchanged; repeated rows are judged alike;
    an empty benchmark drops nothing, an empty table gives no rows.
    """
    inner, text, restored = numbered(docs, text_col)
    found = find_hits(inner, benchmark, text_col=text, **options).where(~is_contaminated(coverage))
    if max_span is None:
        return restored(found)

    def make():
        def work(texts, spans):
            out = []
            for text, own in zip(as_bytes(texts), spans.to_pylist(), strict=True):
                cut = [(s["start"], s["end"]) for s in own or [] if s["end"] - s["start"] > max_span]
                if cut:
                    at = [m.span() for m in _WORD.finditer(text)]
                    for a, b in reversed(cut):
                        text = text[: at[a][0]] + text[at[b - 1][1] :]
                out.append(text)
            return [pa.array(out, pa.binary()).cast(pa.string())]

        return work

    # the new text takes the place of the old one
    return restored(append_columns(found, [text, "hit_spans"], [T.StructField(text, T.StringType())], make))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: what the contract of op3 asks for.

    Null and empty texts have no words and no hits; repeated rows get a row each;
    texts may be of any length; other columns do not pass; no documents give no rows.
    """
    found = find_hits(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def brute_force(texts: list[bytes | None], items: list[tuple[str, bytes]], min_words: int = 13):
    """Plain re-statement for tests: (n_words, n_hit, item ids) of each text."""
    windows: dict[tuple, set[str]] = {}
    for item, body in items:
        w = word_list(body)
        k = min(len(w), min_words)
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        w = word_list(text or b"")
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if own := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


def sha_of_items(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
