"""Retrieval for a table of questions, each among the blocks of its own stream.

Questions and blocks meet as a blocked matrix product: the blocks of a stream are dealt
to parts of ``BLOCK_ROWS``, its questions to chunks of ``QUESTION_ROWS``, and a task
multiplies one chunk with one part and returns the k best of each question. Those are
merged by question. So a stream of any share of the rows spreads over parts times chunks,
a task holds two bounded tables, and no vector goes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import vectors as V

from .retrieval import small

BLOCK_ROWS, QUESTION_ROWS = 16_384, 2_048
#: Products held at once; questions and blocks of late interaction that are compared at once.
_CELLS, _ROWS, _COLUMNS = 4_000_000, 16, 1024


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _products(asked: np.ndarray, own: np.ndarray, score: str, width: int) -> np.ndarray:
    """Scores of each question (row) with each block: dot product, or late interaction over tokens of ``width`` numbers."""
    if score == "dot":
        return asked @ own.T
    q, b = asked.reshape(-1, width), own.reshape(len(own), -1, width)
    out = np.empty((len(asked), len(own)))
    for at in range(0, len(own), _COLUMNS):  # so that what is compared stays in the cache
        best = q @ b[at : at + _COLUMNS, 0].T
        for token in range(1, b.shape[1]):
            np.maximum(best, q @ b[at : at + _COLUMNS, token].T, out=best)
        best = best.reshape(len(asked), -1, best.shape[1])
        out[:, at : at + _COLUMNS] = best.max(axis=1) if score == "max" else best.mean(axis=1)
    return out


def _k_best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row; equal ones by column; -inf is none."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    by = np.lexsort((col, -scores[row, col], row))
    row, col = row[by], col[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _multiply(n_keys: int, k: int, score: str, width: int, digits: int, names: list[str]):
    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not asked.num_rows or not own.num_rows:
            asked, own = asked.slice(0, 0), own.slice(0, 0)
        own = own.sort_by("__b")
        q, b = _matrix(asked.column("__q")), _matrix(own.column("__v"))
        strip = max(1, _CELLS // max(1, own.num_rows)) if score == "dot" else _ROWS
        rows, cols, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        at = own.column("__at").to_numpy()
        until = asked.column("__until").to_numpy(zero_copy_only=False).astype(np.float64)
        for start in range(0, asked.num_rows, strip):
            found = _products(q[start : start + strip], b, score, width)
            np.round(found, digits, out=found)  # in place: a strip is the largest thing that a task holds
            limit = until[start : start + strip]
            for i in np.flatnonzero(~np.isnan(limit)):
                found[i, ~(at < limit[i])] = -np.inf
            row, col = _k_best(found, k)
            rows.append(row + start)
            cols.append(col)
            values.append(found[row, col])
        row, col = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        columns = [asked.column(f"__k{i}").take(row) for i in range(n_keys)]
        return pa.Table.from_arrays([*columns, own.column("__b").take(col), pa.array(np.concatenate(values))], names=names)

    return run


def retrieve(
    questions: DataFrame, blocks: DataFrame, keys: list[str], k: int, *, stream: str = "stream", vector: str = "q", block: str = "vec_id", block_vector: str = "embedding",
    score: str = "dot", width: int = 8, digits: int = 6, until: str | None = None, at: str | None = None, block_rows: int = BLOCK_ROWS, question_rows: int = QUESTION_ROWS,
) -> DataFrame:
    """The ``k`` best blocks of each question: keys, block, score, rank from 1; equal scores by block; all if there are fewer.

    questions: ``keys`` (unique), ``stream``, ``vector``; blocks: ``stream``, ``block``,
    ``block_vector``. ``score`` is dot, or max or mean of the best block token of each
    question token (late interaction). With ``until`` only blocks whose ``at`` is below it
    count; a null sets no limit. Scores are rounded to ``digits``. Null streams, vectors
    and blocks find nothing. All vectors have one length.
    """
    asked = questions.where(F.col(stream).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(stream).alias("__s"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col(vector).cast("array<double>").alias("__q"),
        (F.col(until) if until else F.lit(None)).cast("double").alias("__until"),
    )
    own = blocks.where(F.col(stream).isNotNull() & F.col(block_vector).isNotNull() & F.col(block).isNotNull()).select(
        F.col(stream).alias("__s"), F.col(block).alias("__b"), F.col(block_vector).cast("array<double>").alias("__v"), (F.col(at) if at else F.lit(0)).cast("double").alias("__at")
    )
    parts = own.groupBy("__s").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("__parts"))
    chunks = asked.groupBy("__s").agg(F.ceil(F.count("*") / question_rows).cast("int").alias("__chunks"))
    sizes = small(parts.join(chunks, "__s"))
    deal = lambda c, n: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "__s").withColumn("__c", deal([f"__k{i}" for i in range(len(keys))], "__chunks")).withColumn("__p", every("__parts")).drop("__parts", "__chunks")
    right = own.join(sizes, "__s").withColumn("__p", deal(["__b"], "__parts")).withColumn("__c", every("__chunks")).drop("__parts", "__chunks")
    schema = T.StructType([*[T.StructField(c, questions.schema[c].dataType) for c in keys], T.StructField(block, blocks.schema[block].dataType), T.StructField("score", T.DoubleType())])
    group = ["__s", "__p", "__c"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_multiply(len(keys), k, score, width, digits, schema.fieldNames()), schema)
    order = W.partitionBy(*keys).orderBy(F.desc("score"), block)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve_chunks(questions: DataFrame, blocks: DataFrame, keys: list[str], k: int, chunk: int, *, place: str, stream: str = "stream", block: str = "vec_id", block_vector: str = "embedding", **more) -> DataFrame:
    """The best k / chunk groups of ``chunk`` consecutive places by mean score, as the blocks in them: keys, grp, block, score (the mean), rank of the group.

    The mean of dot products is the product with the mean vector, so groups are averaged
    first and the product is ``chunk`` times smaller. A part at the end counts.
    """
    grouped = blocks.withColumn("grp", F.floor(F.col(place) / chunk))
    n = F.size(block_vector)
    numbers = grouped.select(stream, "grp", n.alias("__n"), F.posexplode(F.col(block_vector).cast("array<double>")).alias("__i", "__x"))
    means = numbers.groupBy(stream, "grp", "__i").agg(F.avg("__x").alias("__x")).groupBy(stream, "grp").agg(F.sort_array(F.collect_list(F.struct("__i", "__x"))).alias("__v"))  # a vector's length
    means = means.select(stream, "grp", F.col("__v.__x").alias("__mean"))
    best = retrieve(questions, means, keys, k // chunk, stream=stream, block="grp", block_vector="__mean", **more)
    own = questions.select(*keys, stream).join(best, keys)
    return own.join(grouped.select(stream, "grp", block), [stream, "grp"]).select(*keys, "grp", block, "score", "rank")


def retrieve_hybrid(questions: DataFrame, blocks: DataFrame, keys: list[str], k: int, *, stream: str = "stream", vector: str = "q", block: str = "vec_id", block_vector: str = "embedding", width: int = 8, digits: int = 6) -> DataFrame:
    """Dot products choose 3 k blocks, which late interaction scores again; of these and the k next the k best: keys, block, score, rank."""
    rough = retrieve(questions, blocks, keys, 4 * k, stream=stream, vector=vector, block=block, block_vector=block_vector, digits=digits)
    again = rough.where(F.col("rank") <= 3 * k).join(blocks.select(block, block_vector), block).join(questions.select(*keys, vector), keys)
    own, asked = V.tokens(V.doubles(F.col(block_vector)), width), V.tokens(V.doubles(F.col(vector)), width)
    fine = F.array_max(F.transform(asked, lambda q: F.array_max(F.transform(own, lambda t: V.dot(t, q)))))
    both = again.select(*keys, block, F.round(fine, digits).alias("score")).unionByName(rough.where(F.col("rank") > 3 * k).select(*keys, block, "score"))
    order = W.partitionBy(*keys).orderBy(F.desc("score"), block)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pooled_similarity(questions: DataFrame, blocks: DataFrame, keys: list[str], *, stream: str = "stream", vector: str = "q", block_vector: str = "embedding") -> DataFrame:
    """keys and ``score``: the question's vector with the mean of all blocks of its stream."""
    numbers = blocks.select(stream, F.posexplode(F.col(block_vector).cast("array<double>")).alias("__i", "__x"))
    means = numbers.groupBy(stream, "__i").agg(F.avg("__x").alias("__x")).groupBy(stream).agg(F.sort_array(F.collect_list(F.struct("__i", "__x"))).alias("__v"))  # a vector's length
    return questions.join(small(means), stream).select(*keys, V.dot(F.col(vector), F.col("__v.__x")).alias("score"))


def in_order(hits: DataFrame, keys: list[str], block: str = "vec_id") -> DataFrame:
    """keys and ``blocks``, the hits of each question by time (at most k)."""
    return hits.groupBy(*keys).agg(F.sort_array(F.collect_list(block)).alias("blocks"))


def forced(questions: DataFrame, wanted: DataFrame, blocks: DataFrame, keys: list[str], *, stream: str = "stream", vector: str = "q", block: str = "vec_id", block_vector: str = "embedding") -> DataFrame:
    """Scores of the blocks that ``wanted`` (keys, block) names for each question, whatever they score; others than of its stream are left out."""
    return (
        wanted.join(questions.select(*keys, stream, vector), keys)
        .join(blocks.select(stream, block, block_vector), [stream, block])
        .select(*keys, block, V.dot(F.col(vector), F.col(block_vector)).alias("score"))
    )
