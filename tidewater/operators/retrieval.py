"""Similarity retrieval over blocks of vectors.

A query side is one row per query; it is broadcast only after ``plain_or_broadcast``
has counted it. Top-k uses TakeOrderedAndProject or WindowGroupLimit, never a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import vectors as V

MAX_BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the table has at most ``most`` rows; Spark chooses otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def query_vector(blocks: DataFrame, vec_id: int) -> list[float]:
    """One query's vector, read once by key and used as a literal."""
    return [float(x) for x in blocks.where(F.col("vec_id") == vec_id).first().embedding]


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(x) for x in vector])


def score_blocks(blocks: DataFrame, vector: list[float]) -> DataFrame:
    return blocks.withColumn("score", V.dot(F.col("embedding"), literal(vector)))


def top_k(scored: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """The k best by score, ties by id; all if there are fewer."""
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def top_k_per(scored: DataFrame, keys: list[str], k: int, id_col: str = "vec_id") -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def chunked_top_k(scored: DataFrame, k: int, chunk: int) -> DataFrame:
    """Mean score per ``chunk`` consecutive ids (a part at the end counts), the best k / chunk groups, expanded to ids that exist."""
    groups = scored.groupBy(F.floor(F.col("vec_id") / chunk).alias("grp")).agg(F.avg("score").alias("mean_score"), F.max("vec_id").alias("last_id"))
    best = groups.orderBy(F.desc(F.round("mean_score", 9)), "grp").limit(k // chunk)
    ids = F.explode(F.sequence(F.col("grp") * chunk, F.least(F.col("grp") * chunk + chunk - 1, F.col("last_id"))))
    return best.select(ids.alias("vec_id"), "mean_score")


def max_sim(blocks: DataFrame, vector: list[float], *, then: str = "max", width: int = 8) -> DataFrame:
    """Late interaction: per query token the best block token, then the max or mean over query tokens."""
    own = V.tokens(V.doubles(F.col("embedding")), width)
    asked = V.tokens(literal(vector), width)
    best = F.transform(asked, lambda q: F.array_max(F.transform(own, lambda t: V.dot(t, q))))
    score = F.array_max(best) if then == "max" else F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)
    return blocks.withColumn("score", score)


def hybrid_top_k(blocks: DataFrame, vector: list[float], k: int) -> DataFrame:
    """Dot scores keep the best 3k, which late interaction scores again; the others keep their dot score."""
    avg = score_blocks(blocks.select("vec_id", "embedding"), vector)
    kept = top_k(avg, 3 * k)
    again = max_sim(kept.drop("score"), vector).select("vec_id", F.col("score").alias("fine"))
    merged = avg.select("vec_id", "score").join(small(again), "vec_id", "left")
    return top_k(merged.withColumn("score", F.coalesce("fine", "score")), k)


def layer_votes(hits: DataFrame, first_layer: int) -> DataFrame:
    """(layer, vec_id, weight) to votes per block, layers before ``first_layer`` ignored."""
    return hits.where(F.col("layer") >= first_layer).groupBy("vec_id").agg(F.sum("weight").alias("votes"))


def recent_and_best(votes: DataFrame, total: int, recent: int, best: int) -> DataFrame:
    """Ids of the last ``recent`` blocks and of the ``best`` voted ones, each once."""
    top = votes.orderBy(F.desc("votes"), "vec_id").limit(best).select("vec_id")
    last = votes.sparkSession.range(max(0, total - recent), total).select(F.col("id").alias("vec_id"))
    return top.union(last).distinct()


def latest_and_best(votes: DataFrame, blocks: DataFrame, recent: int, best: int) -> DataFrame:
    """Ids of the ``recent`` latest of all ``blocks`` and of the ``best`` voted ones, each once."""
    top = votes.orderBy(F.desc("votes"), "vec_id").limit(best).select("vec_id")
    return top.union(blocks.select("vec_id").orderBy(F.desc("vec_id")).limit(recent)).distinct()


def window_overlap(windows: DataFrame, seconds: DataFrame, keys: list[str]) -> DataFrame:
    """Recall, precision and F1 of retrieved seconds against ground-truth windows.

    Windows are expanded to the seconds they touch, so the join is an equi-join.
    windows: keys, start, end; seconds: keys, sec (distinct).
    """
    touched = windows.withColumn("sec", F.explode(F.sequence(F.floor("start"), F.ceil("end") - 1)))
    cut = F.least(F.col("end"), F.col("sec") + 1) - F.greatest(F.col("start"), F.col("sec").cast("double"))
    hit = touched.join(seconds, [*keys, "sec"]).groupBy(*keys).agg(F.sum(cut).alias("overlap"))
    truth = windows.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("gt_len"))
    found = seconds.groupBy(*keys).agg(F.count("*").alias("n_sec"))
    out = truth.join(found, keys, "left").join(hit, keys, "left").na.fill(0.0, ["overlap"]).na.fill(0, ["n_sec"])
    recall = F.coalesce(F.try_divide(F.col("overlap"), F.col("gt_len")), F.lit(0.0))
    precision = F.coalesce(F.try_divide(F.col("overlap"), F.col("n_sec").cast("double")), F.lit(0.0))
    return out.withColumns({"recall": recall, "precision": precision}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0))
    )


def recent_quota(p: Column, size: int, least: float = 0.1, most: float = 0.9) -> Column:
    """How many of ``size`` hits are the most recent ones, at probability ``p`` that the present is asked for; rounded half to even."""
    low, high = round(least * size), round(most * size)
    return F.least(F.greatest(F.rint(p * size), F.lit(low)), F.lit(high)).cast("int")


def recent_and_past(ranked: DataFrame, quota: DataFrame, key: str, size: int) -> DataFrame:
    """ranked: key, vec_id, score; quota: key, k_recent. The k_recent latest blocks of each key and, of the others, the size - k_recent best."""
    late = F.row_number().over(W.partitionBy(key).orderBy(F.desc("vec_id")))
    marked = ranked.join(quota, key).withColumn("recent", late <= F.col("k_recent"))
    best = F.row_number().over(W.partitionBy(key, "recent").orderBy(F.desc("score"), "vec_id"))
    return marked.withColumn("best", best).where(F.col("recent") | (F.col("best") <= size - F.col("k_recent"))).select(key, "vec_id")


def backfilled(hits: DataFrame, blocks: DataFrame, key: str, size: int) -> DataFrame:
    """hits: key, pos; blocks: key, pos (from 0). Hits, and where there are fewer than ``size`` the latest size - n positions, each once."""
    n = blocks.groupBy(key).agg(F.count("*").alias("total")).join(hits.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    late = blocks.join(n, key).where(F.col("pos") >= F.col("total") - (size - F.coalesce("n", F.lit(0)))).select(key, "pos")
    return hits.select(key, "pos").union(late).distinct()


def gathered(init: Column, hits: Column, limit: int) -> Column:
    """The first blocks, then the hits among the others in order; more than ``limit`` is an error."""
    both = F.concat(init, F.array_sort(F.array_except(hits, init)))
    return F.when(F.size(both) <= limit, both).otherwise(F.raise_error(F.concat(F.lit("gathered blocks: "), F.size(both).cast("string"))))


def evicted(used: DataFrame, key: str, ident: str, last_used: str, hit: Column, n: int) -> DataFrame:
    """The n least recently used of each key that are no hits of the current query."""
    order = W.partitionBy(key).orderBy(last_used, ident)
    return used.where(~hit).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")
