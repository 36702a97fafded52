"""Ranked lexical search by Fagin's threshold algorithm, shard by shard.

A forward index (document, its length, the items' terms in it with their counts) is
written once; document frequencies and lengths come from it. Each task then takes its
documents in shards of bounded size. A shard has one list of (impact, document) per
term, by falling impact, and the forward index by document. For each item the lists of
its terms are read in turn, one stride each; a document met for the first time has its
whole score looked up in the forward index; with the impacts read last as threshold,
which no unseen document can exceed, the item stops when that falls strictly below the
task's k-th best score so far, which later shards start from. The best of all tasks are
merged, so neither a term that a third of all documents hold nor one item is one task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bound_batches, materialize, release_memory, word_list

TOP = 10
#: Bytes of items' text whose terms and lists one pass over the documents holds.
PART_BYTES = 16 << 20
#: Documents and postings of a shard.
SHARD_DOCUMENTS, SHARD_POSTINGS = 20_000, 1_500_000
#: Places of each list that are read before the threshold is looked at for the first time; it doubles.
STRIDE = 8


class _Items:
    """Terms of a part of the items: ``terms`` numbers them, ``of`` has (numbers, repeats) of each item."""

    def __init__(self, texts: list[bytes | None]) -> None:
        self.terms: dict[bytes, int] = {}
        self.of: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            counts = Counter(word_list(text or b""))
            numbers = [self.terms.setdefault(w, len(self.terms)) for w in counts]
            self.of.append((np.array(numbers, np.int64), np.array(list(counts.values()), np.int64)))


def _index_schema(docs: DataFrame, id_col: str) -> T.StructType:
    field = lambda n, t: T.StructField(n, t)
    return T.StructType([field("id", docs.schema[id_col].dataType), field("n", T.LongType()), field("terms", T.BinaryType()), field("counts", T.BinaryType())])


def forward_index(docs: DataFrame, terms, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms with repeats), the numbers of those in ``terms`` (int32, ascending) and their counts (int64); texts without a term are left out."""
    bound_batches(docs.sparkSession)
    schema = _index_schema(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in batches:
            at, n, numbers, counts = [], [], [], []
            for row, text in enumerate(as_bytes(batch.column(1))):
                words = word_list(text) if text else []
                if words:
                    found = Counter(filter(known.__contains__, words))
                    own = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
                    by = np.argsort(own)
                    at.append(row)
                    n.append(len(words))
                    numbers.append(own[by].tobytes())
                    counts.append(np.fromiter(found.values(), np.int64, len(found))[by].tobytes())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
        release_memory()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; tasks count, at most ``n_terms`` rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            numbers = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            total += np.bincount(numbers, minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    table = index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[table.column("term").to_numpy()] = table.column("df").to_numpy()
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class _Shard:
    """Documents as rows of (term, impact), and by term the rows' places by falling impact."""

    def __init__(self, n: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, weight: np.ndarray, n_docs: int, n_words: int) -> None:
        m = 25 + (75 * n * n_docs) // n_words
        self.starts, self.sizes, self.terms = np.cumsum(sizes) - sizes, sizes, terms
        owner = np.repeat(np.arange(len(n)), sizes)
        self.impact = weight[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[owner]))
        by = np.lexsort((-self.impact, terms))
        self.list_docs, self.list_impact = owner[by], self.impact[by]
        self.offsets = np.searchsorted(terms[by], np.arange(len(weight) + 1))

    def scores(self, rows: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Whole scores of documents, from their rows of the forward index; ``repeats`` has the item's count of each term."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        part = np.concatenate(([0], np.cumsum(self.impact[at] * repeats[self.terms[at]])))
        return part[ends] - part[ends - sizes]


Best = tuple[np.ndarray, np.ndarray, np.ndarray]  # scores, whether the id is null, ids; best first
_NONE: Best = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))


def _top(parts: list[Best], k: int) -> Best:
    score, null, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
    by = np.lexsort((ids, null, -score))[:k]
    return score[by], null[by], ids[by]


def threshold_search(shard: _Shard, numbers: np.ndarray, times: np.ndarray, repeats: np.ndarray, null: np.ndarray, ids: np.ndarray, best: Best, k: int) -> Best:
    """``best`` with the shard's documents; stops when the threshold falls strictly below the k-th score."""
    begin, end = shard.offsets[numbers], shard.offsets[numbers + 1]
    depth, stride, seen = 0, STRIDE, np.zeros(len(ids), bool)
    while True:
        live = begin + depth < end
        threshold = int((shard.list_impact[begin[live] + depth] * times[live]).sum())  # what comes next bounds all that is unseen
        if not threshold or (len(best[0]) == k and threshold < best[0][-1]):
            return best
        stretch = np.minimum(end[live], begin[live] + depth + stride)
        met = np.concatenate([shard.list_docs[a:b] for a, b in zip((begin[live] + depth).tolist(), stretch.tolist(), strict=True)])
        met = np.unique(met[~seen[met]])
        seen[met] = True
        score = shard.scores(met, repeats)
        good = score > 0
        if len(best[0]) == k:
            good &= score >= best[0][-1]
        if good.any():
            rows = met[good]
            best = _top([best, (score[good], null[rows], ids[rows])], k)
        depth, stride = depth + stride, 2 * stride


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, docs, postings = [], 0, 0
    for batch in batches:
        held.append(batch)
        docs, postings = docs + batch.num_rows, postings + batch.column(2).nbytes // 4
        if docs >= SHARD_DOCUMENTS or postings >= SHARD_POSTINGS:
            yield held
            held, docs, postings = [], 0, 0
    if docs:
        yield held


def _search_part(spark: SparkSession, docs: DataFrame, part: pa.Table, id_col: str, text_col: str, out: T.StructType, k: int) -> DataFrame:
    items = _Items([t.encode() if t is not None else None for t in part.column(1).to_pylist()])
    n_terms = len(items.terms)
    index = materialize(forward_index(docs, spark.sparkContext.broadcast(items.terms), id_col, text_col), "forward")
    n_docs, n_words = index.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return spark.createDataFrame([], out)
    weight = weights(_frequencies(index, n_terms), n_docs)
    shared = spark.sparkContext.broadcast((items.of, weight, part.column(0).combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, weight, names = shared.value
        best = [_NONE] * len(of)
        repeats = np.zeros(len(weight), np.int64)
        for held in _shards(batches):
            id_column, n, terms, counts = (pa.concat_arrays([b.column(c) for b in held]) for c in range(4))
            null = id_column.is_null().to_numpy(zero_copy_only=False)
            ids = id_column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([len(t) // 4 for t in terms.to_pylist()], np.int64)
            flat = np.frombuffer(b"".join(terms.to_pylist()), np.int32).astype(np.int64)
            shard = _Shard(n.to_numpy(), flat, np.frombuffer(b"".join(counts.to_pylist()), np.int64), sizes, weight, n_docs, n_words)
            for i, (numbers, times) in enumerate(of):
                if len(numbers):
                    repeats[numbers] = times
                    best[i] = threshold_search(shard, numbers, times, repeats, null, ids, best[i], k)
                    repeats[numbers] = 0
        item = np.repeat(np.arange(len(of)), [len(b[0]) for b in best])
        score, null, ids = (np.concatenate(c) for c in zip(*best, strict=True))
        columns = [names.take(pa.array(item)), pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "__item", "doc_id", "score"])
        release_memory()

    found = index.mapInArrow(run, T.StructType([out["item_id"], T.StructField("__item", T.LongType()), out["doc_id"], out["score"]]))
    order = W.partitionBy("__item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*out.fieldNames())


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = TOP) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` for each item: item_id, rank from 1, doc_id, score; equal scores by id.

    Terms are stretches of letters and digits and all characters beyond ASCII, A-Z
    lower-cased. Statistics are those of all rows of ``docs``, each row a document, also if
    its id is repeated or null (null ids come last among equal scores). ``id_col`` is a
    long. Null, empty and blank texts have no terms: such documents count nowhere and such
    items get no rows, nor do items without a document of positive score. Equal item rows
    are one item; an id with several texts gets a ranking for each. Other columns of both
    tables are ignored; an empty table gives an empty result. Items beyond 16 MiB of text
    (or a longer single item) take a pass over the documents for each such part.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where(F.length("text") > 0)
    out = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // PART_BYTES)
    result = spark.createDataFrame([], out)
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).distinct().toArrow()
        if own.num_rows:
            found = _search_part(spark, docs, own, "doc_id", "text", out, k)
            result = found if parts == 1 else result.unionByName(found)
    return result


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size),
m AS (SELECT doc_id, 25 + (75 * n * docs) // words AS m FROM size, total),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
score AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def brute_force(docs: list[tuple[int | None, bytes | None]], items: list[tuple], k: int = TOP) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document; for tests."""
    counted = [(i, Counter(word_list(t or b""))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_words = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, n in counted:
            m = 25 + 75 * n * n_docs // n_words
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in Counter(word_list(text or b"")).items() if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(found, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1)]
    return out
