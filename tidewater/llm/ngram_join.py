"""N-gram Jaccard self-join by chosen paths.

A document is the set of its word 5-grams; documents with equal sets form a class.
Each run samples tokens of a set by a hash that all sets share, so that a set of n
tokens keeps each with probability 1 / (threshold * n); sets that keep the same
token meet in a bucket. Buckets are counted first: those of one set are dropped,
those over ``limit`` are split again on further sampled tokens of their members,
and the others are brute-forced on bit sketches. What is still over the limit
after the last split is brute-forced in blocks. Runs repeat until a pair at the
threshold is found with probability ``recall``.

What the sketches connect is gathered by connected component. Components of up to
``BLOCK`` sets are counted exactly, all pairs in one task. Larger ones are held as
differences to a common reference set: sizes of differences alone decide the pairs
that lie close to it, so those are counted by rank, and only pairs with a set far
from it are compared, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WRITTEN, bound_batches, discard, materialize, release_memory, word_list

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.995
#: Sets of a bucket that are compared with each other; larger buckets are split.
LIMIT = 2000
#: Sets of a component, or on either side of a comparison, that one task holds.
BLOCK = 1536
#: Sets, about, from which the reference set of a larger component is made; any reference gives exact results.
REFERENCE = 48
#: Rows of a counted table up to which it is broadcast; beyond, joins shuffle and only keys of over ``HOT`` rows are broadcast.
MAX_BROADCAST_MEMBERS = 500_000
HOT = 1000
#: Standard errors that a sketch may fall short by; a pair at the threshold is missed with a probability below 1e-6.
ERRORS = 5
_DEPTH, _BINS = 3, 256
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser (public domain constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def runs_for(recall: float, depth: int = _DEPTH) -> int:
    """Runs after which a pair at the threshold has shared a bucket at each of ``depth`` levels with that probability."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)  # the pair keeps one common token on average
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int = WORDS):
        self.n, self.hashes = n, _Words()
        self.odd = _mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """A text of fewer words is one n-gram; without words the text itself is; null and empty texts have none."""
        words = word_list(text) if text else []
        if not words:
            return np.array([xxhash.xxh3_64_intdigest(text, 1)] if text else [], dtype=np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(words))
        total = h[: len(h) - k + 1] * self.odd[0]
        for i in range(1, k):
            total = total + h[i : len(h) - k + 1 + i] * self.odd[i]
        return np.unique(_mix(total + _U(k)))


def _sketch(s: np.ndarray) -> bytes:
    """256 one-bit minima (one permutation in 256 bins) and which bins have one."""
    h = _mix(s ^ _U(0x2545F4914F6CDD1D))
    h.sort()  # by bin, then by value
    first = np.concatenate(([True], (h[1:] >> _U(56)) != (h[:-1] >> _U(56))))
    low = h[first]
    bins = (low >> _U(56)).astype(int)
    bits, there = np.zeros(_BINS, bool), np.zeros(_BINS, bool)
    there[bins] = True
    bits[bins] = (low & _U(1)).astype(bool)
    return np.packbits(bits).tobytes() + np.packbits(there).tobytes()


def _chosen(s: np.ndarray, odds, threshold: float) -> list[np.ndarray]:
    """The buckets of a set for each of ``odds``: its sampled tokens, hashed with the odd number that sampled them."""
    keep = _U(min(2**64 - 1, int(2**64 / (threshold * len(s)))))
    return [_mix(s[s * odd < keep] ^ odd) for odd in odds]


def _odds_below(buckets: np.ndarray) -> np.ndarray:
    """The odd numbers that sample the next token of sets that met in these buckets."""
    return _mix(buckets + _U(0x632BE59BD9B4E019)) | _U(1)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


_SETS_SCHEMA = "doc_id long, key long, h1 long, h2 long, n int, sketch binary, buckets array<long>"


def describe(docs: DataFrame, *, id_col: str, text_col: str, threshold: float, recall: float, words: int) -> DataFrame:
    """Per document a hash of its text, digest of its set (null without one), size, sketch and buckets; not the set."""
    seeds = _mix(np.arange(1, runs_for(recall) + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
    none = np.zeros(0, np.uint64)

    def run(batches):
        shingles = Shingler(words)
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for start in range(0, len(texts), 500):
                rows = [shingles(t) for t in texts[start : start + 500].to_pylist()]
                digests = [_digest(s) if len(s) else (None, None) for s in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[start : start + 500],
                        batch.column(1)[start : start + 500],
                        pa.array([a for a, _ in digests], pa.int64()),
                        pa.array([b for _, b in digests], pa.int64()),
                        pa.array([len(s) for s in rows], pa.int32()),
                        pa.array([_sketch(s) if len(s) else None for s in rows], pa.binary()),
                        _lists([np.concatenate(_chosen(s, seeds, threshold)) if len(s) else none for s in rows]),
                    ],
                    names=[c.split()[0] for c in _SETS_SCHEMA.split(", ")],
                )
        del shingles
        release_memory()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("key"), docs[text_col].alias("text")).mapInArrow(run, _SETS_SCHEMA)


def _with_sets(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, keep: str, make, out: str) -> DataFrame:
    """Rows made from the full sets of classes, whose texts are read again from one document each.

    ``members`` has first (id and text hash of that document), h1, h2 and the columns ``keep``;
    ``make(columns of keep, sets)`` returns the arrays of the columns ``out``.
    """
    kept, names = keep.split(), [c.split()[0] for c in out.split(", ")]

    def run(batches):
        shingles = Shingler(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                sets = [shingles(t) for t in part.column(0).cast(pa.large_binary()).to_pylist()]
                own = zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                same = np.array([len(s) > 0 and _digest(s) == h for s, h in zip(sets, own, strict=True)], bool)
                at = pa.array(np.flatnonzero(same))
                yield pa.RecordBatch.from_arrays(make([c.take(at) for c in part.columns[3:]], [sets[i] for i in at.to_pylist()]), names=names)
        del shingles
        release_memory()

    rows = docs.select(docs[id_col].cast("long").alias("__id"), F.xxhash64(docs[text_col]).alias("__key"), docs[text_col].alias("__text"))
    own = members.select(F.col("first.doc_id").alias("__first"), F.col("first.key").alias("__of"), "h1", "h2", *kept)
    few = members.count() <= MAX_BROADCAST_MEMBERS
    joined = rows.join(F.broadcast(own) if few else own, (rows["__key"] == own["__of"]) & rows["__id"].eqNullSafe(own["__first"]))
    return joined.select("__text", "h1", "h2", *kept).mapInArrow(run, out)


def _lookup(rows: DataFrame, table: DataFrame, on: list[str], n_table: int) -> DataFrame:
    """``rows`` inner-joined with ``table``, which has one row a key and the number of its rows in column ``n``.

    A counted small table is broadcast. Otherwise the rows shuffle, but for keys of
    over ``HOT`` rows, of which there are so few that they are broadcast.
    """
    if n_table <= MAX_BROADCAST_MEMBERS:
        return rows.join(F.broadcast(table.drop("n")), on)
    hot = table.where(F.col("n") > HOT).drop("n")
    if hot.count() > MAX_BROADCAST_MEMBERS:
        return rows.join(table.drop("n"), on)
    cold = table.where(F.col("n") <= HOT).drop("n")
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


class _Sketches:
    def __init__(self, data: list[bytes], n: np.ndarray, threshold: float):
        both = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), 64).view(np.uint64)
        self.bits, self.there, self.n = both[:, :4], both[:, 4:], n
        self.threshold = threshold

    def similar(self, i, j, other: _Sketches | None = None) -> np.ndarray:
        """Whether sets i and j (of ``other``) may reach the threshold, by sizes, common bins and agreeing bits.

        The common tokens that the threshold asks for occupy so many bins in both; in
        common bins bits agree with probability (1 + threshold) / 2. Both counts may
        fall short by ``ERRORS`` standard errors.
        """
        o, t = other or self, self.threshold
        x, y = self.n[i], o.n[j]
        ok = np.minimum(x, y) >= t * np.maximum(x, y)
        both = self.there[i] & o.there[j]
        total = np.bitwise_count(both).sum(-1).astype(float)
        load = np.ceil((x + y) * (t / (1 + t)) - 1e-9) / _BINS
        free = np.exp(-load)
        least = _BINS * (1 - free) - ERRORS * np.sqrt(_BINS * free * np.maximum(1 - (1 + load) * free, 0)) - 1
        ok &= total >= np.maximum(least, 1)
        same = np.bitwise_count(~(self.bits[i] ^ o.bits[j]) & both).sum(-1)
        agree = (1 + t) / 2
        return ok & (same >= total * agree - ERRORS * np.sqrt(total * agree * (1 - agree)))


def _connect(sk: _Sketches) -> list[tuple[int, int]]:
    """A spanning forest of the similarity graph: breadth first, each set compared with those not reached yet."""
    left, edges, queue = np.arange(len(sk.n)), [], []
    while len(left) or queue:
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        x = queue.pop()
        if not len(left):
            break
        near = sk.similar(x, left)
        for y in left[near]:
            edges.append((x, int(y)))
            queue.append(int(y))
        left = left[~near]
    return edges


_EDGES = "a long, b long"


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _bucket_edges(threshold: float):
    """Arrow function over rows (bucket, cls, n, sketch) sorted by bucket, each of bounded size: candidate edges."""

    def solve(bucket, classes, sizes, sketches):
        out = []
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        end = np.append(at[1:], len(bucket))
        size = end - at
        sk = _Sketches(sketches, sizes, threshold)
        two = at[size == 2]
        if len(two):
            hit = two[sk.similar(two, two + 1)]
            out += [(classes[i], classes[i + 1]) for i in hit]
        for a, b in zip(at[size > 2], end[size > 2], strict=True):
            own = _Sketches(sketches[a:b], sizes[a:b], threshold)
            out += [(classes[a + x], classes[a + y]) for x, y in _connect(own)]
        return _edge_batch(out)

    def run(batches):
        held = ([], [], [], [])
        for batch in batches:
            held = tuple(a + c.to_pylist() for a, c in zip(held, batch.columns, strict=True))
            last = held[0][-1] if held[0] else None
            cut = len(held[0])
            while cut and held[0][cut - 1] == last:
                cut -= 1
            if cut:
                yield solve(np.array(held[0][:cut], np.int64), held[1][:cut], np.array(held[2][:cut]), held[3][:cut])
                held = tuple(x[cut:] for x in held)
        if held[0]:
            yield solve(np.array(held[0], np.int64), held[1], np.array(held[2]), held[3])
        held = None
        release_memory()

    return run


def _deal(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (key, cls, far, …) dealt to tasks (key, i, j) that hold far rows of block i (role 0) and all of block j (role 1).

    Every pair with a far row meets in some task, and no task holds more than about two blocks.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("far").cast("long")).alias("n_far")).where("n_far > 0")
    sizes = materialize(sizes.select(key, "n", F.ceil(F.col("n_far") / block).cast("int").alias("lo"), F.ceil(F.col("n") / block).cast("int").alias("hi")), "blocks")
    sized = _lookup(rows, sizes, [key], sizes.count())
    place = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "cls"), F.col(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    as_far = sized.where("far").withColumn("i", place(1, "lo")).withColumn("j", spread("hi")).withColumn("role", F.lit(0))
    as_any = sized.withColumn("j", place(2, "hi")).withColumn("i", spread("lo")).withColumn("role", F.lit(1))
    dealt = as_far.unionByName(as_any).drop("lo", "hi")
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "role")


def _by_group(keys: int, solve, empty):
    """Arrow function that hands ``solve`` the rows of each run of equal first ``keys`` columns, as lists of the others."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != row[:keys]:
                    if held:
                        yield solve(*zip(*held, strict=True))
                    now, held = row[:keys], []
                held.append(row[keys:])
        yield solve(*zip(*held, strict=True)) if held else empty
        held = None
        release_memory()

    return run


def _block_edges(threshold: float):
    """Solver of (role, cls, n, sketch) rows of one task of ``_deal``: edges between far rows and any."""

    def solve(role, cls, n, sketch):
        m = sum(r == 0 for r in role)
        far = _Sketches(sketch[:m], np.array(n[:m]), threshold)
        rest = _Sketches(sketch[m:], np.array(n[m:]), threshold)
        out, every = [], np.arange(len(cls) - m)
        for i in range(m):
            out += [(cls[i], cls[m + int(j)]) for j in every[far.similar(i, every, rest)] if cls[m + int(j)] != cls[i]]
        return _edge_batch(out)

    return solve


def _crowded_edges(rows: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Edges of buckets (bucket, cls, n, sketch) too large for a task that no token is left to split.

    Members similar to the bucket's pivot (its member of least hash) are linked to it;
    the others are compared with all members, in blocks.
    """
    pivots = materialize(
        rows.groupBy("bucket").agg(F.min_by(F.struct("cls", "n", "sketch"), F.struct(F.xxhash64("cls"), "cls")).alias("pivot"), F.count("*").alias("n")), "pivots"
    )
    beside = _lookup(rows.withColumnRenamed("n", "size"), pivots, ["bucket"], pivots.count())

    def mark(batches):
        for batch in batches:
            bucket, cls, n, sketch, pivot = batch.columns
            p = pivot.flatten()
            both = _Sketches(sketch.to_pylist() + p[2].to_pylist(), np.array(n.to_pylist() + p[1].to_pylist()), threshold)
            at = np.arange(len(cls))
            far = ~both.similar(at, at + len(cls))
            yield pa.RecordBatch.from_arrays([bucket, cls, n, sketch, p[0], pa.array(far)], names=["bucket", "cls", "n", "sketch", "pivot", "far"])

    marked = materialize(
        beside.select("bucket", "cls", F.col("size").alias("n"), "sketch", "pivot").mapInArrow(mark, "bucket long, cls long, n int, sketch binary, pivot long, far boolean"), "marked"
    )
    near = marked.where("not far").select(F.col("cls").alias("a"), F.col("pivot").alias("b"))
    blocks = _deal(marked.drop("pivot"), "bucket", limit).select("bucket", "i", "j", "role", "cls", "n", "sketch")
    return near.unionByName(blocks.mapInArrow(_by_group(3, _block_edges(threshold), _edge_batch([])), _EDGES))


def candidate_edges(classes: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, words: int, threshold: float, limit: int) -> DataFrame:
    """Edges (a, b) between classes that meet in some bucket and may be similar; a forest of each bucket."""
    level = classes.select(F.explode(F.array_distinct("buckets")).alias("bucket"), "cls")
    sketches = classes.select("cls", "n", "sketch")
    edges = None
    for depth in range(1, _DEPTH + 1):
        # buckets of one set make up most; they drop out before sketches are shuffled
        counts = materialize(level.groupBy("bucket").agg(F.count("*").alias("n_sets")).where("n_sets > 1"), "counts")
        full = counts.where(F.col("n_sets") > limit).select("bucket")
        n_full = full.count()
        full = F.broadcast(full) if n_full <= MAX_BROADCAST_MEMBERS else full
        rows = level.join(full, "bucket", "left_anti") if n_full else level
        rows = rows.join(counts.where(F.col("n_sets") <= limit), "bucket", "left_semi").join(sketches, "cls").select("bucket", "cls", "n", "sketch")
        own = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_edges(threshold), _EDGES)
        edges = own if edges is None else edges.unionByName(own)
        if not n_full:
            break
        crowded = level.join(full, "bucket", "left_semi")
        if depth == _DEPTH:
            edges = edges.unionByName(_crowded_edges(materialize(crowded.join(sketches, "cls").select("bucket", "cls", "n", "sketch"), "crowded"), threshold, limit))
            break
        above = crowded.groupBy("cls").agg(F.collect_list("bucket").alias("above"))  # a set has few buckets

        def split(columns, sets):
            cls, above = columns
            found = []
            for s, own in zip(sets, above.to_pylist(), strict=True):
                found.append(np.concatenate(_chosen(s, _odds_below(np.array(own, np.int64).view(np.uint64)), threshold)))
            return [cls, _lists(found)]

        members = materialize(above.join(classes.select("cls", "h1", "h2", "first"), "cls"), "crowded")
        found = materialize(_with_sets(members, docs, id_col, text_col, words, "cls above", split, "cls long, buckets array<long>"), "split")
        level = found.select(F.explode("buckets").alias("bucket"), "cls").distinct()
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the least node of its component.

    Alternating large-star and small-star steps, each cut at written files. Least
    neighbours are aggregated before they shuffle and looked up without dealing the
    edges of a hub to one task.
    """
    spark, before = edges.sparkSession, len(WRITTEN)
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    facts = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    mark = facts(now)
    while mark[0]:
        small = 2 * mark[0] <= MAX_BROADCAST_MEMBERS
        least = lambda df: df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))

        def beside(df):
            table = least(df)
            if small:
                return df.join(F.broadcast(table.drop("n")), "a")
            return _lookup(df, materialize(table, "least"), ["a"], 2 * mark[0])  # noqa: B023

        # large star: neighbours above a node go to the least of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = beside(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = large if small else materialize(large, "cc")
        # small star: a node and its lesser neighbours go to the least of them
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = materialize(beside(large).select(F.explode(ends).alias("x")).select("x.a", "x.b").where("a <> b").distinct(), "cc")
        last, mark = mark, facts(now)
        discard(spark, before, now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common tokens of each set of ``left`` with each of ``right``, by products of strips of the incidence matrix."""
    m, sets = len(left), [*left, *right]
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    out = np.zeros((m, len(right)), np.float32)
    if not len(tokens):
        return out
    col = np.cumsum(np.concatenate(([False], tokens[1:] != tokens[:-1])))
    many = np.bincount(col)[col] > 1  # a token of one set is in no intersection
    owner, col = owner[many], np.unique(col[many], return_inverse=True)[1]
    width, some, last = 1024, 256, int(col[-1]) + 1 if len(col) else 0
    for c in range(0, last, width):
        a, b = np.searchsorted(col, [c, c + width])
        part = np.zeros((len(sets), min(width, last - c)), np.float32)
        part[owner[a:b], col[a:b] - c] = 1
        for r in range(0, m, some):
            out[r : min(r + some, m)] += part[r : min(r + some, m)] @ part[m:].T
    return out


def _forest(linked: np.ndarray, rows: list[int], columns: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links between classes ``rows`` and ``columns`` (a class may be in both)."""
    at = {c: j for j, c in enumerate(columns)}
    up = {c: i for i, c in enumerate(rows)}
    seen_row, seen_col, out = np.zeros(len(rows), bool), np.zeros(len(columns), bool), []
    for seed in np.flatnonzero(linked.any(1)).tolist():
        queue = [] if seen_row[seed] else [rows[seed]]
        while queue:
            x = queue.pop()
            i, j = up.get(x, -1), at.get(x, -1)
            if j >= 0:
                seen_col[j] = True
            if i >= 0 and not seen_row[i]:
                seen_row[i] = True
                near = np.flatnonzero(linked[i] & ~seen_col)
                seen_col[near] = True
                out += [(x, columns[k]) for k in near]
                queue += [columns[k] for k in near]
            if j >= 0:
                near = np.flatnonzero(linked[:, j] & ~seen_row)
                fresh = [rows[k] for k in near]
                out += [(x, c) for c in fresh]
                queue += fresh
    return out


_LINKS = "a long, b long, w long"


def _link_batch(counts: list[tuple[int, int]], forest: list[tuple[int, int]]) -> pa.RecordBatch:
    """Link counts as (a, null, w) and edges of a forest of the links as (a, b, 0)."""
    a = [c for c, _ in counts] + [x for x, _ in forest]
    b = [None] * len(counts) + [y for _, y in forest]
    w = [n for _, n in counts] + [0] * len(forest)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.int64())], names=["a", "b", "w"])


def _whole(threshold: float):
    """Solver of the (cls, weight, tokens) rows of one component."""

    def solve(cls, weight, tokens):
        pick = list({c: i for i, c in reversed(list(enumerate(cls)))}.values())[::-1]
        cls, w, sets = [cls[i] for i in pick], np.array([weight[i] for i in pick], np.int64), [np.frombuffer(tokens[i], np.uint64) for i in pick]
        n = np.array([len(s) for s in sets])
        common = _common(sets, sets)
        linked = np.zeros(common.shape, bool)
        for r in range(0, len(sets), 256):  # whole-matrix temporaries would take several times its memory
            linked[r : r + 256] = common[r : r + 256] >= (n[r : r + 256, None] + n[None, :]) * (threshold / (1 + threshold)) - 1e-3
        del common
        np.fill_diagonal(linked, False)
        counts = [(cls[i], int(w[row].sum())) for i, row in enumerate(linked)]
        return _link_batch([c for c in counts if c[1]], _forest(linked, cls, cls))

    return solve


def _reference(tokens):
    """Solver of the token sets sampled from a component: the tokens of more than half of them."""
    sets = [np.frombuffer(t, np.uint64) for t in tokens]
    found, n = np.unique(np.concatenate(sets), return_counts=True)
    return found[2 * n > len(sets)]


def _far_pairs(share: float):
    """Solver of (role, cls, weight, n, slack, diff) rows of one task of ``_deal``: links that slacks leave open."""

    def solve(role, cls, weight, n, slack, diff):
        m = sum(r == 0 for r in role)
        sets = [np.frombuffer(d, np.uint64) for d in diff]
        size, n, slack, cls_of, w = np.array([len(s) for s in sets]), np.array(n), np.array(slack), np.array(cls), np.array(weight, np.int64)
        apart = size[:m, None] + size[None, m:] - 2 * _common(sets[:m], sets[m:])
        linked = (apart <= (n[:m, None] + n[None, m:]) * share + 1e-6) & (slack[:m, None] + slack[None, m:] < 0)
        # a pair of two far sets meets twice
        linked &= (slack[None, m:] >= 0) | (cls_of[:m, None] < cls_of[None, m:])
        linked &= cls_of[:m, None] != cls_of[None, m:]
        counts = [(cls[i], int(w[m:][row].sum())) for i, row in enumerate(linked)]
        counts += [(cls[m + j], int(w[:m][row].sum())) for j, row in enumerate(linked.T)]
        return _link_batch([c for c in counts if c[1]], _forest(linked, list(cls[:m]), list(cls[m:])))

    return solve


def _large_components(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """Link counts and a forest of links of the components that are too large for one task, without comparing all pairs.

    With D(x) the symmetric difference of x and the component's reference R, and c =
    (1 - t) / (1 + t), x and y link if |x ^ y| <= c (|x| + |y|). As |x ^ y| <= |D(x)| +
    |D(y)|, they surely do if their slacks c |x| - |D(x)| add up to 0 or more; such
    partners are counted by rank, and all of them link with the set of most slack. For
    other pairs, one of which has a negative slack, |x ^ y| = |D(x) ^ D(y)| is computed.
    """
    share = (1 - threshold) / (1 + threshold)
    tokens = lambda columns, sets: [*columns, pa.array([s.tobytes() for s in sets], pa.binary())]
    schema = "cls long, root long, w long, parts int, tokens binary"
    members = members.withColumn("parts", F.ceil(F.col("n_members") / BLOCK).cast("int")).withColumn("w", F.col("n_docs"))
    sample = members.where(F.pmod(F.xxhash64(F.lit(7), "cls"), F.col("n_members")) < REFERENCE)
    drawn = _with_sets(sample, docs, id_col, text_col, words, "cls root w parts", tokens, schema)

    def refer(root, parts, sets):
        return pa.RecordBatch.from_arrays([pa.array([root[0]], pa.int64()), pa.array([parts[0]], pa.int32()), pa.array([_reference(sets).tobytes()], pa.binary())], names=["root", "parts", "tokens"])

    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["root", "parts", "tokens"])
    sorted_sample = drawn.select(F.col("root").alias("key"), "root", "parts", "tokens").repartition("key").sortWithinPartitions("key")
    reference = materialize(sorted_sample.mapInArrow(_by_group(1, refer, none), "root long, parts int, tokens binary"), "reference")

    full = _with_sets(members, docs, id_col, text_col, words, "cls root w parts", tokens, schema)
    part = F.pmod(F.xxhash64(F.lit(8), "cls"), F.col("parts")).cast("int")
    copies = reference.select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("cls"), F.lit(0).cast("long").alias("w"), "tokens")
    dealt = full.withColumn("part", part).select("root", "part", "cls", "w", "tokens").unionByName(copies).repartition("root", "part").sortWithinPartitions("root", "part", F.col("cls").asc_nulls_first())

    def differ(batches):
        of, ref = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for root, cls, w, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if of != root:
                    of, ref = root, np.zeros(0, np.uint64)
                own = np.frombuffer(t, np.uint64)
                if cls is None:
                    ref = own
                    continue
                d = np.setxor1d(own, ref, assume_unique=True)
                rows.append((root, cls, w, len(own), round(share * len(own) - len(d), 6), d.tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["root", "cls", "w", "n", "slack", "diff"])

    diffs = dealt.select("root", "cls", "w", "tokens").mapInArrow(differ, "root long, cls long, w long, n int, slack double, diff binary")
    # a repeated row of a class's document gives its set twice
    diffs = materialize(diffs.groupBy("root", "cls").agg(*[F.first(c).alias(c) for c in ("w", "n", "slack", "diff")]), "diffs")

    # partners whose slack is at least minus a set's own: running sums over the few distinct slacks of a component
    sums = diffs.groupBy("root", "slack").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    points = sums.select("root", F.col("slack").alias("at"), F.lit(0).alias("asks"), "w", "slack", "n").unionByName(
        sums.select("root", (-F.col("slack")).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("w"), "slack", "n")
    )
    running = F.sum("w").over(W.partitionBy("root").orderBy(F.col("at").desc(), "asks").rowsBetween(W.unboundedPreceding, W.currentRow))
    best = diffs.groupBy("root").agg(F.max_by("cls", F.struct("slack", "cls")).alias("best"), F.max("slack").alias("top"), F.min("slack").alias("bottom"))
    ranks = materialize(points.withColumn("sure", running).where("asks = 1").select("root", "slack", "sure", "n").join(best, "root"), "ranks")
    placed = _lookup(diffs.withColumnRenamed("n", "size"), ranks, ["root", "slack"], ranks.count())
    own = F.when(F.col("slack") >= 0, F.col("w")).otherwise(0)
    null = F.lit(None).cast("long")
    counted = placed.select(F.col("cls").alias("a"), null.alias("b"), (F.col("sure") - own).alias("w")).where("w > 0")
    star = placed.where("slack + top >= 0 and cls <> best").select(F.col("cls").alias("a"), F.col("best").alias("b"), F.lit(0).cast("long").alias("w"))
    open_ = placed.where("slack + bottom < 0").withColumn("far", F.col("slack") < 0)
    apart = _deal(open_.select("root", "cls", "far", "w", F.col("size").alias("n_tokens"), "slack", "diff"), "root", BLOCK)
    pairs = apart.select("root", "i", "j", "role", "cls", "w", "n_tokens", "slack", "diff").mapInArrow(_by_group(3, _far_pairs(share), _link_batch([], [])), _LINKS)
    return counted.unionByName(star).unionByName(pairs)


def _classed(docs: DataFrame, *, id_col: str, text_col: str, threshold: float, recall: float, words: int, limit: int) -> DataFrame:
    """(doc_id, key, n, keeper, n_links) per document: hash of its text, tokens, (id, key) of the document that stands for its component."""
    spark, before = docs.sparkSession, len(WRITTEN)
    bound_batches(spark)
    sets = materialize(describe(docs, id_col=id_col, text_col=text_col, threshold=threshold, recall=recall, words=words), "sets")
    firsts = [F.first(c).alias(c) for c in ("n", "sketch", "buckets")]
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")  # ids first, by size
    classes = sets.where("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min(rank).alias("first"), *firsts)
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    about = dict(id_col=id_col, text_col=text_col, words=words, threshold=threshold)
    candidate = materialize(components(candidate_edges(classes, docs, limit=limit, **about)), "candidates")
    sizes = materialize(candidate.groupBy("root").agg(F.count("*").alias("n_members"), F.count("*").alias("n")), "sizes")
    members = _lookup(candidate.withColumnRenamed("node", "cls"), sizes, ["root"], sizes.count())
    members = materialize(members.join(classes.select("cls", "h1", "h2", "n_docs", "first"), "cls"), "members")

    small = members.where(F.col("n_members") <= BLOCK)
    tokens = lambda columns, sets: [*columns, pa.array([s.tobytes() for s in sets], pa.binary())]
    full = _with_sets(small, docs, id_col, text_col, words, "root cls n_docs", tokens, "root long, cls long, n_docs long, tokens binary")
    links = full.repartition("root").sortWithinPartitions("root").mapInArrow(_by_group(1, _whole(threshold), _link_batch([], [])), _LINKS)
    large = members.where(F.col("n_members") > BLOCK)
    if not large.isEmpty():
        links = links.unionByName(_large_components(large, docs, id_col, text_col, words, threshold))
    links = materialize(links, "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("others"))
    roots = components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "cls")

    own = materialize(members.select("cls", "first").join(roots, "cls").join(counts, "cls"), "linked")
    least = materialize(own.groupBy("root").agg(F.min("first").alias("keeper"), F.count("*").alias("n")), "roots")
    linked = _lookup(own, least, ["root"], least.count()).select("cls", "keeper", "others")
    # classes of one document without links need no row: the document stands for itself
    table = classes.select("h1", "h2", "cls", "n_docs", "first").join(linked, "cls", "left").where("n_docs > 1 or keeper is not null")
    table = materialize(
        table.select("h1", "h2", F.coalesce("keeper", "first").alias("keeper"), (F.coalesce("others", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"), F.col("n_docs").alias("n")), "table"
    )
    discard(spark, before, sets, table)
    found = _lookup(sets.select("doc_id", "key", "h1", "h2", F.col("n").alias("n_tokens")), table, ["h1", "h2"], table.count())
    alone = sets.select("doc_id", "key", "h1", "h2", F.col("n").alias("n_tokens"))
    few = table.count() <= MAX_BROADCAST_MEMBERS
    keys = table.select("h1", "h2")
    alone = alone.join(F.broadcast(keys) if few else keys, ["h1", "h2"], "left_anti")
    return found.unionByName(alone.withColumn("keeper", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).withColumn("n_links", F.lit(0).cast("long"))).drop("h1", "h2")


def near_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    words: int = WORDS,
    limit: int = LIMIT,
) -> DataFrame:
    """A row per document: doc_id, class_id (least id of its component of links), n_links, n_tokens.

    Documents link if the Jaccard similarity of their word n-gram sets reaches the
    threshold; ``n_links`` counts linked documents, copies included. A text of
    fewer words is one n-gram; a text without words links only with its copies;
    null and empty texts link with nothing and are their own class. Ids are
    integers; null ids come after all others, and a component of null ids only has
    a null class id. Repeated rows are documents of their own. Other columns do
    not pass; an empty table gives no rows.
    """
    found = _classed(docs, id_col=id_col, text_col=text_col, threshold=threshold, recall=recall, words=words, limit=limit)
    return found.select("doc_id", F.col("keeper.doc_id").alias("class_id"), "n_links", F.col("n_tokens").cast("long").alias("n_tokens"))


def keep_one(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    words: int = WORDS,
    limit: int = LIMIT,
) -> DataFrame:
    """``docs``, all columns, with one row of each component of links: that of the least id, null ids last.

    Rows are told apart by id and text, so that an id with two texts can lose one of
    them; of rows of equal id and text in a component one stays (that of the least
    hash over all columns). Null and empty texts all stay.
    """
    found = _classed(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, threshold=threshold, recall=recall, words=words, limit=limit)
    stays = F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.key") == F.col("key"))
    marked = materialize(found.where("n_tokens > 0").select("doc_id", "key", stays.alias("stays")), "marked")
    rows = marked.groupBy("doc_id", "key").agg(F.first("stays").alias("stays"), F.count("*").alias("times"))
    gone = materialize(rows.where("not stays or times > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "stays"), "gone")
    few = gone.count() <= 4 * MAX_BROADCAST_MEMBERS

    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    keyed = inner.withColumns({"__id": F.col(at[id_col]).cast("long"), "__key": F.xxhash64(at[text_col])})
    listed = lambda t: F.broadcast(t) if few else t
    same = lambda t: (keyed["__key"] == t["__key"]) & keyed["__id"].eqNullSafe(t["__id"])
    kept = keyed.join(listed(gone), same(gone), "left_anti").select(inner.columns)
    repeated = gone.where("stays")
    if not repeated.isEmpty():
        again = keyed.join(listed(repeated), same(repeated), "left_semi")
        whole = F.struct(*inner.columns)
        again = again.groupBy("__id", "__key").agg(F.min_by(whole, F.xxhash64(*inner.columns)).alias("row")).select("row.*")
        kept = kept.unionByName(again)
    return kept.toDF(*docs.columns)


def brute_force(rows: list[tuple[int, bytes | None]], threshold: float = THRESHOLD, n: int = WORDS) -> dict[int, tuple[int, int]]:
    """Plain re-statement for tests: id -> (class id, links)."""
    def grams(text):
        w = word_list(text or b"")
        if not w:
            return {text} if text else set()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}

    sets = [(k, grams(t)) for k, t in rows]
    root = {k: k for k, _ in sets}
    links = {k: 0 for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (find(k), links[k]) for k, _ in sets}
