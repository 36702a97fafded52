"""Pairs of embeddings within a cosine threshold, by cover trees and their dual traversal.

Cosine c is a distance d of unit vectors with d**2 = 2 - 2 c, so links are pairs within
t = sqrt(2 - 2 threshold). Equal vectors are one class with a weight.

Upper levels: ``SAMPLE`` classes (by hash) go to the driver, where each label gets nested
nets of halving radii. A node of the net at t in which several sampled classes lie gives a
dense cell: all within t of their mean. All other classes of the label go to the nearest of
a few wide cells, about one for ``BLOCK`` classes. Classes within t / 2 of a dense cell's
centre are its core: any two of them link, so they are counted and joined without looking
at pairs. Other pairs of different cells are looked at in one of the two, to which a class
is sent if the covering radius, or for wide cells the bisectors, leave a link possible.

Lower levels: a cell's classes meet in tasks of at most ``BLOCK`` a side. A task builds a
cover tree of each side, nested levels with halving radii, and traverses both at once: a
pair of nodes is dropped if their distance exceeds t by more than their covering radii, is
counted whole if it and the radii stay within t, and is replaced by the pairs of their
children otherwise; pairs of single classes are decided by their cosine. Nothing is capped:
sampling and cells decide where pairs meet, never whether they do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WRITTEN, discard, materialize, release_memory
from .ngram_join import components

THRESHOLD = 0.98
#: Classes whose nets are built on the driver.
SAMPLE = 2000
#: Sampled classes that make a dense cell.
DENSE = 4
#: Classes of each side of a task.
BLOCK = 8192
#: Rows of equal vectors from which a class is joined back by a broadcast; there are few of them.
HOT_CLASSES = 4096
#: Classes below which a node is a leaf.
_LEAF = 8
#: Children compared at once.
_STRIP = 512
#: Slack of bounds against rounding; pairs so near the threshold are decided by their cosine.
_EPS = 1e-7


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, without overflow."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(points: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """Members dealt to centres (each group's first) farther than ``radius`` apart, each to the nearest within ``radius``; the first member is the first centre."""
    groups: list[list[np.ndarray]] = []
    left = members
    while len(left):
        tried = left[:64]
        close = _distance(points[tried], points[left]) <= radius
        chosen: list[int] = []
        for i in range(len(tried)):
            if not close[chosen, i].any():
                chosen.append(i)
        near = np.where(close[chosen], _distance(points[tried[chosen]], points[left]), np.inf)
        near[np.arange(len(chosen)), chosen] = -1.0  # a centre is its own
        owner, covered = near.argmin(axis=0), np.isfinite(near).any(axis=0)
        for k, i in enumerate(chosen):
            own = left[covered & (owner == k)]
            groups.append([np.concatenate((left[i : i + 1], own[own != left[i]]))])
        left = left[~covered]
    return [g[0] for g in groups]


class CoverTree:
    """Nested levels with halving radii over unit vectors; node k's classes are ``order[begin[k]:end[k]]``, the first its centre."""

    def __init__(self, points: np.ndarray, weight: np.ndarray) -> None:
        self.points, self.weight = points, weight
        self.order = np.empty(len(points), np.int64)
        self._nodes: list[tuple[int, int, float]] = []
        self.children: list[np.ndarray] = []
        if len(points):
            self._add(np.arange(len(points)), 0, 1.0)
        begin, end, reach = zip(*self._nodes, strict=True) if self._nodes else ((), (), ())
        self.begin, self.end, self.reach = np.array(begin, np.int64), np.array(end, np.int64), np.array(reach, np.float64)
        self.centre, self.single = self.order[self.begin], self.end - self.begin == 1
        sums = np.concatenate(([0], np.cumsum(weight[self.order])))
        self.total = sums[self.end] - sums[self.begin]

    def _add(self, members: np.ndarray, at: int, radius: float) -> int:
        k, reach = len(self._nodes), 0.0
        self.order[at : at + len(members)] = members
        if len(members) > 1:
            reach = float(_distance(self.points[members[:1]], self.points[members]).max())
        self._nodes.append((at, at + len(members), reach))
        self.children.append(np.zeros(0, np.int64))
        if len(members) > 1:
            while radius >= 2 * reach > 0:
                radius /= 2
            groups = net(self.points, members, radius) if len(members) > _LEAF and radius > 1e-3 else [members[i : i + 1] for i in range(len(members))]
            kids = []
            for g in groups:
                kids.append(self._add(g, at, radius / 2))
                at += len(g)
            self.children[k] = np.array(kids)
        return k


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; the least member stays the root."""

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            x = up

    while len(a):
        a, b = roots(a), roots(b)
        differ = a != b
        a, b = a[differ], b[differ]
        if len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


class Traversal:
    """Links between the classes of two trees: ``counts`` (weights of linked classes of the other side) and ``parent`` (a forest over both)."""

    def __init__(self, left: CoverTree, right: CoverTree, same: np.ndarray, threshold: float) -> None:
        """``same[i]`` is the left class that right class i is, or -1: a class is no partner of itself."""
        self.left, self.right, self.same, self.threshold = left, right, same, threshold
        self.t = float(np.sqrt(2 - 2 * threshold))
        n, m = len(left.points), len(right.points)
        self.parent = np.arange(n + m)
        self.counts = [np.zeros(n, np.int64), np.zeros(m, np.int64)]
        self.added = [np.zeros(n + 1, np.int64), np.zeros(m + 1, np.int64)]  # by place in a tree's order: from here on
        if n and m:
            self._run()
        for side, tree in enumerate((left, right)):
            self.counts[side][tree.order] += np.cumsum(self.added[side])[:-1]
        twin = np.flatnonzero(same >= 0)  # each counted itself: its distance is 0
        np.subtract.at(self.counts[0], same[twin], right.weight[twin])
        self.counts[1][twin] -= left.weight[same[twin]]

    def _whole(self, a: int, b: int) -> None:
        for side, tree, k, other in ((0, self.left, a, self.right.total[b]), (1, self.right, b, self.left.total[a])):
            self.added[side][tree.begin[k]] += other
            self.added[side][tree.end[k]] -= other
        mine = self.left.order[self.left.begin[a] : self.left.end[a]]
        theirs = self.right.order[self.right.begin[b] : self.right.end[b]] + len(self.left.points)
        _unite(self.parent, np.concatenate((mine, theirs)), np.full(len(mine) + len(theirs), mine[0]))

    def _run(self) -> None:
        left, right = self.left, self.right
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            mine = left.children[a] if len(left.children[a]) else np.array([a])
            theirs = right.children[b] if len(right.children[b]) else np.array([b])
            for at in range(0, len(mine), _STRIP):
                rows = mine[at : at + _STRIP]
                u, v = left.centre[rows], right.centre[theirs]
                cosine = left.points[u] @ right.points[v].T
                gap = np.sqrt(np.maximum(2 - 2 * cosine, 0))
                reach = left.reach[rows][:, None] + right.reach[theirs][None, :]
                i, j = np.nonzero(gap <= self.t + reach + _EPS)
                gap, reach, cosine = gap[i, j], reach[i, j], cosine[i, j]
                single = left.single[rows[i]] & right.single[theirs[j]]
                linked = single & (cosine >= self.threshold)
                p, q = u[i[linked]], v[j[linked]]
                np.add.at(self.counts[0], p, right.weight[q])
                np.add.at(self.counts[1], q, left.weight[p])
                _unite(self.parent, p, q + len(left.points))
                for x, y, whole in zip(rows[i[~single]].tolist(), theirs[j[~single]].tolist(), (gap + reach <= self.t - _EPS)[~single].tolist(), strict=True):
                    if whole:
                        self._whole(x, y)
                    else:
                        stack.append((x, y))


#: A class in a cell: R at home, C in its core, V sent there for its partners.
_ROLES = "RCV"


class Cells:
    """Cells of a label: dense ones first, then wide ones."""

    def __init__(self, sample: np.ndarray, n_classes: int, t: float, block: int) -> None:
        radius, level = 2.0, [np.arange(len(sample))]
        while radius > t:  # nested nets: each node of a level is dealt anew at half its radius
            radius = max(radius / 2, t)
            level = [g for node in level for g in net(sample, node, radius)]
        dense = [sample[g].mean(axis=0) for g in level if len(g) >= DENSE]
        dense = [c / np.linalg.norm(c) for c in dense if np.linalg.norm(c) > 0]
        single = [g[0] for g in level if len(g) < DENSE] or [level[0][0]]
        wide = sample[single[: max(1, -(-n_classes // block))]]
        self.t, self.n_dense = t, len(dense)
        self.centres = np.concatenate((np.array(dense).reshape(-1, sample.shape[1]), wide))
        self.apart = _distance(wide, wide)
        self.reach = np.full(len(self.centres), np.inf)

    def home(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each point, whether it is in the core, and its distance to the centre."""
        d = _distance(points, self.centres)
        near = np.where(d[:, : self.n_dense] <= self.t, d[:, : self.n_dense], np.inf)
        cell = d[:, self.n_dense :].argmin(axis=1) + self.n_dense
        if self.n_dense:
            cell = np.where(np.isfinite(near.min(axis=1)), near.argmin(axis=1), cell)
        own = d[np.arange(len(points)), cell]
        return cell, (cell < self.n_dense) & (own <= self.t / 2 - _EPS), own

    def visits(self, points: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, later cell) wherever a link to one of the cell's own classes is possible."""
        d = _distance(points, self.centres)
        may = d <= self.reach[None, :] + self.t + _EPS
        wide = d[:, self.n_dense :]
        nearest = wide.argmin(axis=1)
        # q of cell b lies on b's side of the bisector of b and the point's nearest wide centre; within t of it
        slack = 2 * self.t * self.apart[nearest] + _EPS
        may[:, self.n_dense :] &= wide**2 - wide[np.arange(len(points)), nearest][:, None] ** 2 <= slack
        may &= np.arange(len(self.centres))[None, :] > cell[:, None]
        return np.nonzero(may)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as unit rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1)) if len(column) else flat.reshape(0, 0)


def _by_space(batch: pa.RecordBatch, label: int, dim: int) -> Iterator[tuple[tuple, np.ndarray]]:
    keys: dict[tuple, list[int]] = {}
    for at, key in enumerate(zip(batch.column(label).to_pylist(), batch.column(dim).to_pylist(), strict=True)):
        keys.setdefault(key, []).append(at)
    for key, rows in keys.items():
        yield key, np.array(rows)


def _classes(rows: DataFrame) -> DataFrame:
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)
    return valid.groupBy("label", "v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("w")).withColumn("dim", F.size("v"))


def _renumbered(classes: DataFrame) -> DataFrame:
    """``classes`` with ``least``, their least id, and ``cls`` as a key: that id, or a number where an id has several vectors."""
    if classes.groupBy("cls").count().where("count > 1").isEmpty():
        return classes.withColumn("least", F.col("cls"))
    return materialize(classes.withColumn("least", F.col("cls")).withColumn("cls", F.monotonically_increasing_id()), "classes-numbered")


def _of(rows: DataFrame, spaces: list[tuple]) -> DataFrame:
    """``rows`` of some labels and lengths, no more than there are sampled classes."""
    kinds = T.StructType([rows.schema["label"], rows.schema["dim"]])
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(spaces, kinds)), ["label", "dim"], "left_semi")


def _cells(classes: DataFrame, t: float, sample: int, block: int) -> dict[tuple, Cells]:
    drawn = classes.orderBy(F.xxhash64(F.lit(13), "cls"), "cls").limit(sample).select("label", "dim", "v").toArrow()
    if not drawn.num_rows:
        return {}
    drawn = drawn.combine_chunks().to_batches()[0]
    spaces = {key: rows for key, rows in _by_space(drawn, 0, 1)}
    in_sample = _of(classes, list(spaces)).groupBy("label", "dim").agg(F.count("*").alias("n"))  # at most a row per sampled class
    sizes = {(r.label, r.dim): r.n for r in in_sample.collect()}
    return {key: Cells(_matrix(drawn.column(2).take(pa.array(rows))), sizes[key], t, block) for key, rows in spaces.items()}


def _placed(classes: DataFrame, cells: dict[tuple, Cells], name: str) -> DataFrame:
    """Classes in their cells: role R or C at home, V where they are sent."""
    spark, kind = classes.sparkSession, classes.schema["label"].dataType
    element = classes.schema["v"].dataType
    shared = spark.sparkContext.broadcast(cells)
    home_schema = T.StructType([T.StructField("label", kind), T.StructField("dim", T.IntegerType()), T.StructField("cls", T.LongType()), T.StructField("w", T.LongType()), T.StructField("v", element), T.StructField("cell", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("far", T.DoubleType())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for key, rows in _by_space(batch, 0, 1):
                own = batch.take(pa.array(rows))
                cell, core, far = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), np.full(len(rows), 2.0)
                if key in known:
                    cell, core, far = known[key].home(_matrix(own.column(4)))
                role = pa.array(np.where(core, "C", "R").tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell, pa.int32()), role, pa.array(far)], names=home_schema.fieldNames())

    at_home = materialize(classes.select("label", "dim", "cls", "w", "v").mapInArrow(settle, home_schema), name)
    asked = [key for key, c in cells.items() if len(c.centres) > 1]
    if not asked:
        return at_home.drop("far")
    for r in _of(at_home, asked).groupBy("label", "dim", "cell").agg(F.max("far").alias("far")).collect():  # a row per cell
        cells[r.label, r.dim].reach[r.cell] = r.far
    for c in cells.values():
        c.reach[np.isinf(c.reach)] = -np.inf  # no class lives there
    bounds = spark.sparkContext.broadcast(cells)
    schema = T.StructType(home_schema.fields[:-1])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bounds.value
        for batch in batches:
            for key, rows in _by_space(batch, 0, 1):
                if key in known and len(known[key].centres) > 1:
                    own = batch.take(pa.array(rows))
                    who, where = known[key].visits(_matrix(own.column(4)), own.column(5).to_numpy())
                    sent = own.take(pa.array(who))
                    columns = [*[sent.column(i) for i in range(5)], pa.array(where, pa.int32()), pa.array(["V"] * len(who), pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    home = at_home.drop("far")
    return home.unionByName(materialize(home.mapInArrow(send, schema), name + "-sent"))


_LINKS = "a long, b long, w long"


def _solve(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        left, right = (table.filter(pc.equal(table.column("side"), s)) for s in (0, 1))
        trees, ids, roles = [], [], []
        for side in (left, right):
            side = side.combine_chunks()
            v = side.column("v").combine_chunks() if side.num_rows else None
            points = _matrix(v) if side.num_rows else np.zeros((0, 1))
            trees.append((points, side.column("w").to_numpy()))
            ids.append(side.column("cls").to_numpy())
            roles.append(np.array(side.column("role").to_pylist(), dtype=object))
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # left: R and V; right: R and C. A pair of two R meets twice, once each way; V with R and C, and R with C, once
        for part, kind in ((("R", "V"), "R"), (("R", "V"), "C")):
            mine = {p: np.flatnonzero(roles[0] == p) for p in part}
            theirs = np.flatnonzero(roles[1] == kind)
            for p, own in mine.items():
                if not len(own) or not len(theirs):
                    continue
                (x, wx), (y, wy) = trees
                place = {c: i for i, c in enumerate(ids[0][own].tolist())}
                same = np.array([place.get(c, -1) for c in ids[1][theirs].tolist()])
                got = Traversal(CoverTree(x[own], wx[own]), CoverTree(y[theirs], wy[theirs]), same, threshold)
                names = np.concatenate((ids[0][own], ids[1][theirs]))
                root = names.copy()
                np.minimum.at(root, _roots(got.parent), names)
                root = root[_roots(got.parent)]
                sides = ((own, ids[0], 0),) if p == kind == "R" else ((own, ids[0], 0), (theirs, ids[1], 1))
                for some, known, s in sides:
                    hit = got.counts[s] > 0
                    rows.append((known[some][hit], known[some][hit], got.counts[s][hit]))
                moved = names != root
                rows.append((names[moved], root[moved], np.zeros(int(moved.sum()), np.int64)))
        a, b, w = (np.concatenate(c) if rows else np.zeros(0, np.int64) for c in (zip(*rows, strict=True) if rows else [(), (), ()]))
        release_memory()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "w": pa.array(w, pa.int64())})

    return run


def _roots(parent: np.ndarray) -> np.ndarray:
    out = parent
    while True:
        up = out[out]
        if (up == out).all():
            return out
        out = up


def class_links(classes: DataFrame, threshold: float = THRESHOLD, *, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(cls, n, root) of each class of ``classes`` (label, v, cls, w, dim) that links with another class: partners' weights, least class reached."""
    t = float(np.sqrt(2 - 2 * threshold))
    placed = _placed(classes, _cells(classes, t, sample, block), "cells")
    key = ["label", "dim", "cell"]
    is_in = lambda roles: F.count(F.when(F.col("role").isin(*roles), 1))
    stats = materialize(
        placed.groupBy(*key).agg(
            F.ceil(is_in("RV") / block).cast("int").alias("n_left"),
            F.ceil(is_in("RC") / block).cast("int").alias("n_right"),
            F.sum(F.when(F.col("role") == "C", F.col("w")).otherwise(0)).alias("core_w"),
            F.min(F.when(F.col("role") == "C", F.col("cls"))).alias("core"),
        ),
        "cell-stats",
    )
    small = stats.count() <= 100_000
    sized = placed.join(F.broadcast(stats) if small else stats, key)
    part = lambda n: F.pmod(F.xxhash64(F.lit(17), "cls"), F.col(n)).cast("int")
    blocks = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    busy = sized.where("n_left > 0 AND n_right > 0")
    left = busy.where("role <> 'C'").select(*key, "cls", "w", "v", "role", F.lit(0).alias("side"), part("n_left").alias("i"), F.explode(blocks("n_right")).alias("j"))
    right = busy.where("role <> 'V'").select(*key, "cls", "w", "v", "role", F.lit(1).alias("side"), F.explode(blocks("n_left")).alias("i"), part("n_right").alias("j"))
    found = left.unionByName(right.select(*left.columns)).groupBy(*key, "i", "j").applyInArrow(_solve(threshold), _LINKS)
    core = sized.where("role = 'C'").select(F.col("cls").alias("a"), F.col("core").alias("b"), (F.col("core_w") - F.col("w")).alias("w"))
    links = materialize(found.unionByName(core), "links")
    counts = links.groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("n"))
    roots = components(links.where("a <> b").select("a", "b")).withColumnRenamed("node", "cls")
    return counts.join(roots, "cls", "left").select("cls", "n", F.coalesce("root", "cls").alias("root"))


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links (other rows of its label with cosine >= ``threshold``), component_id, kept.

    ``component_id`` is the least id that links lead to, the row's own included; ``kept``
    marks the rows whose id that is. Rows link with nothing and are their own component
    if the label, the id or the vector is null, or the vector is empty, zero or holds a
    null or a non-finite component; a null id gives a null component that is not kept.
    Vectors of different lengths do not link. Equal vectors of a label link with each other
    and are compared once; a repeated id counts as another row. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark, before = rows.sparkSession, len(WRITTEN)
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    classes = _renumbered(materialize(_classes(own), "classes"))
    linked = class_links(classes, threshold, sample=sample, block=block)
    ids = classes.select("cls", "least")
    lowest = linked.join(ids, "cls").groupBy("root").agg(F.min("least").alias("component_id"))
    facts = ["label", "v", "least", "w", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")]
    result = materialize(classes.join(linked.join(lowest, "root"), "cls", "left").select(*facts), "classes-linked")
    out = _spread(own, result)
    discard(spark, before, result)
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _spread(own: DataFrame, result: DataFrame) -> DataFrame:
    """What holds for a class for each of its rows."""
    n_rows, most, n_classes, n_ids = result.agg(F.sum("w"), F.max("w"), F.count("*"), F.countDistinct("least")).first()
    facts = ["n_links", "component_id"]
    if n_classes == n_ids and (most or 1) == 1:  # ids name vectors, so vectors need not move again
        return own.select("vec_id").join(result.select(F.col("least").alias("vec_id"), *facts), "vec_id", "left")
    hot = F.col("w") > max(1000, n_rows // HOT_CLASSES)  # so fewer than HOT_CLASSES of them; their rows stay where they are
    valid = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    large = result.where(hot).select("label", "v", F.struct(*facts).alias("found"))
    tried = own.where(valid).join(F.broadcast(large), ["label", "v"], "left")
    of_large = tried.where("found IS NOT NULL").select("vec_id", "found.*")
    of_rest = tried.where("found IS NULL").drop("found").join(result.where(~hot).select("label", "v", *facts), ["label", "v"], "left").select("vec_id", *facts)
    none = own.where(~valid).select("vec_id", *[F.lit(None).cast("long").alias(c) for c in facts])
    return of_large.unionByName(of_rest).unionByName(none)


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
l AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN l USING (vec_id)
"""


def brute_force(rows: list[tuple], threshold: float = THRESHOLD) -> list[tuple]:
    """(vec_id, n_links, component_id, kept) of (vec_id, vector, label) rows by all pairs; for tests."""
    good = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) and i is not None and label is not None for i, v, label in rows]
    parent, counts = list(range(len(rows))), [0] * len(rows)

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (_, v, label), (_, w, other) = rows[a], rows[b]
            if good[a] and good[b] and label == other and len(v) == len(w):
                v, w = np.array(v, float), np.array(w, float)
                if v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= threshold:
                    counts[a] += 1
                    counts[b] += 1
                    parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for a, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return [(i, counts[a], least[root(a)] if i is not None else None, i is not None and least[root(a)] == i) for a, (i, *_) in enumerate(rows)]
