"""Toxicity by a classifier chain of linear models.

Categories are predicted in order; each model sees the words of the text and the
probabilities of the categories before it. For training, those probabilities are
out-of-fold predictions, so a later model learns from what an earlier one says
about texts it has not seen.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_bytes, materialize, numbered, word_list

#: Most labelled rows that the models are fitted on (a sample by the hash of the id); scoring covers all rows.
MAX_TRAIN_ROWS = 10_000
FOLDS = 5


@dataclass(frozen=True)
class Settings:
    """What a model may use of a text, and from when a document is rejected.

    ``max_words`` words and stems a category, each in at least ``least_docs`` training texts and with
    shares in the two classes that differ by ``least_z`` standard errors. Words of more bytes than a
    number in ``stems`` also count by so many first bytes, so that a stem with many endings is one
    feature. Beside whether a text holds a word counts how often per 1000 words, at most ``most_rate``.
    A document is rejected from a probability of ``limit`` on: held-out probabilities of clean documents
    lie close to 0, those of toxic ones with rare words between this and 0.5.
    """

    max_words: int = 120
    least_z: float = 4.5
    least_docs: int = 6
    stems: tuple[int, ...] = (4, 5, 6, 7, 8)
    most_rate: float = 20.0
    limit: float = 0.3


PRODUCTION = Settings()


def features(text: bytes, among: frozenset | None = None, stems: tuple[int, ...] = PRODUCTION.stems) -> tuple[dict[bytes, int], int]:
    """Occurrences of words and stems (marked by ``*``), only those of ``among`` if given, and the number of words."""
    words = word_list(text)
    counts = Counter(words)
    found: dict[bytes, int] = {}
    shortest = min(stems, default=1 << 30)
    for w, n in counts.items():
        for f in (w, *[w[:k] + b"*" for k in stems if len(w) > k]) if len(w) > shortest else (w,):
            if among is None or f in among:
                found[f] = found.get(f, 0) + n
    return found, len(words)


def _values(rows: list[tuple[dict[bytes, int], int]], words: list[bytes], most_rate: float = PRODUCTION.most_rate) -> np.ndarray:
    """For each word whether a text holds it, then how often per 1000 words (``most_rate`` at most, as tenths)."""
    out = np.zeros((len(rows), 2 * len(words)))
    column = {w: k for k, w in enumerate(words)}
    for i, (own, n) in enumerate(rows):
        for w in own.keys() & column.keys():
            out[i, column[w]] = 1.0
            out[i, len(words) + column[w]] = min(most_rate, 1000.0 * own[w] / n) / 10
    return out


@dataclass
class LinearModel:
    category: str
    words: list[bytes]
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, present: np.ndarray, before: np.ndarray) -> np.ndarray:
        return present @ self.weights + (before @ self.earlier if before.size else 0.0) + self.bias


@dataclass
class Chain:
    models: list[LinearModel] = field(default_factory=list)
    settings: Settings = PRODUCTION


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def spread_out(ranked: list[tuple[bytes, float]], most: int = PRODUCTION.max_words, stems: tuple[int, ...] = PRODUCTION.stems) -> list[bytes]:
    """At most ``most`` words and stems of (word, standard errors), best first: those that no shorter stem of theirs equals, then others.

    Else the endings of the commonest stems would leave no place for rarer stems.
    """
    errors = dict(ranked)
    alone, implied = [], []
    for w, z in ranked:
        body = w.rstrip(b"*")
        shorter = [errors.get(body[:k] + b"*", 0.0) for k in stems if k < len(body)]
        (implied if max(shorter, default=0.0) >= z else alone).append(w)
    return (alone + implied)[:most]


def _choose_words(labelled: DataFrame, n_categories: int, settings: Settings) -> list[list[bytes]]:
    """For each category the words whose document share differs most between its classes.

    labelled: __text binary, __y0, __y1, …; tasks count before the shuffle, the best 20 * ``max_words`` words reach the driver.
    """
    ys = [f"__y{i}" for i in range(n_categories)]

    def run(batches):
        counts: dict[bytes, np.ndarray] = {}

        def rows():
            table = np.array(list(counts.values()), dtype=np.int64).reshape(len(counts), n_categories + 1)
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), *[pa.array(table[:, k]) for k in range(n_categories + 1)]], names=["word", "n", *ys])

        for batch in batches:
            labels = np.array([c.to_pylist() for c in batch.columns[1:]]).T
            for text, y in zip(batch.column(0), labels, strict=True):
                one = np.concatenate(([1], y))
                for f in features(text.as_py(), None, settings.stems)[0]:
                    before = counts.get(f)
                    counts[f] = one if before is None else before + one
                if len(counts) > 100_000:
                    yield rows()
                    counts.clear()
        yield rows()

    by_word = labelled.select("__text", *ys).mapInArrow(run, "word binary, n long, " + ", ".join(f"{y} long" for y in ys))
    counts = materialize(by_word.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *ys)]).where(F.col("n") >= settings.least_docs), "counts")
    total = labelled.agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    out = []
    for y in ys:
        n1, n = max(1.0, total[y] or 0), float(total["n"])
        n0 = max(1.0, n - (total[y] or 0))
        share = F.col("n") / n
        spread = F.sqrt(F.greatest(F.lit(1e-12), share * (1 - share) * (1 / n1 + 1 / n0)))
        z = F.abs(F.col(y) / n1 - (F.col("n") - F.col(y)) / n0) / spread
        best = counts.select("word", z.alias("z")).where(F.col("z") >= settings.least_z).orderBy(F.desc("z"), "word").limit(20 * settings.max_words)
        out.append(spread_out([(bytes(r.word), r.z) for r in best.collect()], settings.max_words, settings.stems))
    return out


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def fit_chain(values: list[np.ndarray], words: list[list[bytes]], labels: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """Fit a model per category, in the order of ``labels`` (0/1 arrays), on the values of its words."""
    chain, before = Chain(), np.zeros((len(folds), 0))
    for x, own_words, (category, y) in zip(values, words, labels.items(), strict=True):
        y = y.astype(float)
        k, both = x.shape[1], np.hstack([x, before])
        w, bias = _fit(both, y)
        chain.models.append(LinearModel(category, own_words, w[:k], w[k:], bias))
        held_out = np.full(len(y), y.mean())
        for f in range(FOLDS):
            train, test = folds != f, folds == f
            if test.any() and train.any():
                own, b = _fit(both[train], y[train])
                held_out[test] = _sigmoid(both[test] @ own + b)
        before = np.hstack([before, held_out[:, None]])
    return chain


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__text, __y0, __y1, … and fold of at most ``max_rows`` labelled documents, in a written table.

    Label rows are drawn by the hash of the id before they meet the documents, and once more by their place in
    the written table if repeated ids make more of them.
    """
    marks = labels.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), *[F.expr(p).cast("int").alias(f"__y{i}") for i, p in enumerate(categories.values())]
    ).dropna()
    ys = [f"__y{i}" for i in range(len(categories))]
    marks = materialize(marks.orderBy(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)), "__id", *ys).limit(max_rows), "marks")
    own = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))
    fold = F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(FOLDS)).alias("fold")
    if marks.select("__id").distinct().count() < marks.count():  # equal rows of an id that is repeated on both sides would multiply
        marks = materialize(marks.groupBy("__id", *ys).agg(F.count("*").alias("__times")), "marks")
    else:
        marks = marks.withColumn("__times", F.lit(1).cast("long"))
    met = materialize(own.join(F.broadcast(marks), "__id").select("__text", *ys, fold, "__times"), "met")  # at most max_rows marks
    total = met.agg(F.sum("__times")).first()[0] or 0
    if total > max_rows:
        place = F.monotonically_increasing_id()  # of a written table
        met = met.withColumn("__place", place).where(F.pmod(F.xxhash64("__place"), F.lit(total)) < max_rows).limit(max_rows).withColumn("__times", F.lit(1).cast("long"))
    return materialize(met.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__times"))).select("__text", *ys, "fold"), "labelled")


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    categories: dict[str, str],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_TRAIN_ROWS,
    settings: Settings = PRODUCTION,
) -> Chain:
    """Fit a chain on labelled documents.

    ``categories`` maps each category, in chain order, to a SQL predicate over
    ``labels``. At most ``max_rows`` rows are taken, by the hash of the id, and of all
    labels if they are fewer; rows with null ids or null labels are left out, null
    texts have no words. Of repeated label rows all count.
    """
    ys = [f"__y{i}" for i in range(len(categories))]
    labelled = training_rows(docs, labels, categories, max_rows, id_col, text_col)
    words = _choose_words(labelled, len(categories), settings)
    vocabulary = frozenset(w for own in words for w in own)

    def run(batches):
        for batch in batches:
            rows = [features(t.as_py(), vocabulary, settings.stems) for t in batch.column(0)]
            cells = [pa.array([v.astype(np.float32).tobytes() for v in _values(rows, own, settings.most_rate)], pa.binary()) for own in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cells], names=[*batch.schema.names[1:], *[f"x{i}" for i in range(len(words))]])

    # at most max_rows rows of 2 * max_words numbers for each category reach the driver
    table = labelled.mapInArrow(run, ", ".join([*[f"{y} int" for y in ys], "fold long", *[f"x{i} binary" for i in range(len(words))]])).toArrow()
    n = len(table)
    if not n:
        return Chain([LinearModel(c, [], np.zeros(0), np.zeros(i), -35.0) for i, c in enumerate(categories)], settings)
    values = [np.frombuffer(b"".join(table[f"x{i}"].to_pylist()), np.float32).reshape(n, -1).astype(float) for i in range(len(words))]
    order = np.lexsort([*[v[:, k] for v in values for k in range(v.shape[1])][:50], *[table[y].to_numpy() for y in ys], table["fold"].to_numpy()])  # rows arrive in any order
    labels_ = {c: table[y].to_numpy()[order] for c, y in zip(categories, ys, strict=True)}
    chain = fit_chain([v[order] for v in values], words, labels_, table["fold"].to_numpy()[order])
    chain.settings = settings
    return chain


def score(docs: DataFrame, chain: Chain, *, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability per category; null and empty texts have no words. Columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def make():
        models, settings = shared.value.models, shared.value.settings
        vocabulary = frozenset(w for m in models for w in m.words)

        def work(texts):
            rows = [features(t, vocabulary, settings.stems) if t else ({}, 0) for t in as_bytes(texts)]
            before = np.zeros((len(texts), 0))
            for m in models:
                before = np.hstack([before, _sigmoid(m.logits(_values(rows, m.words, settings.most_rate), before))[:, None]])
            return [pa.array(before[:, i], pa.float64()) for i in range(len(models))]

        return work

    return append_columns(docs, [text_col], [T.StructField(prefix + m.category, T.DoubleType()) for m in chain.models], make)


#: Categories of the registered query, in chain order.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def toxicity_report(docs: DataFrame, labels: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic (probability of at least the limit) of every document.

    Null, empty and wordless texts have no words and are judged by the bias alone;
    repeated rows are judged alike and get a row each; words that tie are chosen in
    byte order; without labels nothing is toxic; other columns do not pass.
    """
    chain = train(docs, labels, categories=CATEGORIES, settings=settings)
    return score(docs.select("doc_id", "text"), chain).select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= settings.limit).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """``docs``, all columns whatever their names, without the documents judged toxic (see ``toxicity_report``)."""
    chain = train(docs, labels, categories=CATEGORIES, settings=settings)
    inner, text, restored = numbered(docs, "text")
    return restored(score(inner, chain, text_col=text).where(F.col("p_toxic") < settings.limit))
