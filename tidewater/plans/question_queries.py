"""Every user turn as a question among the blocks of its own stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.operators import questions as Q
from tidewater.operators.sequences import with_ordinal

from .registry import query
from .tables import table

_KEYS = ["conv_id", "turn"]


def _probe(n: int) -> Column:
    return F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, F.lit(n))


def _asked(spark, sf):
    """User turns with the vector they ask with, that of a block; its label is the stream."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("stream"), F.col("embedding").alias("q"))
    turns = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn").distinct()
    return turns.withColumn("vec_id", _probe(e.count())).join(e, "vec_id").withColumnRenamed("vec_id", "probe")


def _blocks(spark, sf):
    return table(spark, sf, "embeddings").withColumnRenamed("label", "stream")


_ASKED = """e AS (SELECT vec_id, label AS stream, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
a AS (SELECT t.conv_id, t.turn, e.vec_id AS probe, e.stream, e.v AS q FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user') t JOIN e ON e.vec_id = (t.conv_id * 31 + t.turn * 7) % (SELECT count(*) FROM embeddings))"""
_DOTS = f"{_ASKED}, s AS (SELECT conv_id, turn, probe, vec_id, round(list_dot_product(q, v), 6) AS score FROM a JOIN e USING (stream))"
_RANKED = "row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, vec_id)::INTEGER AS rank"
_TOKENS = f"""{_ASKED}, p AS (SELECT DISTINCT probe, stream, q FROM a),
t AS (SELECT probe, vec_id, i, j, list_dot_product(q[i * 8 + 1:i * 8 + 8], v[j * 8 + 1:j * 8 + 8]) AS x FROM p JOIN e USING (stream), range(8) y(i), range(8) z(j)),
m AS (SELECT probe, vec_id, i, max(x) AS x FROM t GROUP BY ALL), f AS (SELECT probe, vec_id, round(max(x), 6) AS top, round(avg(x), 6) AS mean FROM m GROUP BY ALL)"""


@query("G1 G8 A9", f"WITH {_DOTS} SELECT conv_id, turn, vec_id, score, rank FROM (SELECT *, {_RANKED} FROM s) WHERE rank <= 8")
def questions_topk_dot(spark, sf):
    return Q.retrieve(_asked(spark, sf), _blocks(spark, sf), _KEYS, 8)


@query("G9", f"WITH {_DOTS} SELECT conv_id, turn, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM (SELECT *, {_RANKED} FROM s) WHERE rank <= 8 GROUP BY ALL")
def questions_hits_in_order(spark, sf):
    hits = Q.in_order(Q.retrieve(_asked(spark, sf), _blocks(spark, sf), _KEYS, 8), _KEYS)
    return hits.select(*_KEYS, F.array_join(F.col("blocks").cast("array<string>"), ",").alias("ids"))


@query("G1 L1", f"WITH {_DOTS} SELECT conv_id, turn, vec_id, score, rank FROM (SELECT *, {_RANKED} FROM s WHERE vec_id < probe) WHERE rank <= 8")
def questions_topk_so_far(spark, sf):
    """Only blocks from before the question's own."""
    return Q.retrieve(_asked(spark, sf), _blocks(spark, sf), _KEYS, 8, until="probe", at="vec_id")


@query("G4", f"WITH {_TOKENS}, s AS (SELECT conv_id, turn, vec_id, top AS score FROM a JOIN f USING (probe)) SELECT conv_id, turn, vec_id, score, rank FROM (SELECT *, {_RANKED} FROM s) WHERE rank <= 8")
def questions_topk_maxsim(spark, sf):
    return Q.retrieve(_asked(spark, sf), _blocks(spark, sf), _KEYS, 8, score="max")


@query("G5", f"WITH {_TOKENS}, s AS (SELECT conv_id, turn, vec_id, mean AS score FROM a JOIN f USING (probe)) SELECT conv_id, turn, vec_id, score, rank FROM (SELECT *, {_RANKED} FROM s) WHERE rank <= 8")
def questions_topk_maxsim_mean(spark, sf):
    return Q.retrieve(_asked(spark, sf), _blocks(spark, sf), _KEYS, 8, score="mean")


@query("G6", f"""WITH {_TOKENS}, d AS (SELECT DISTINCT probe, vec_id, round(list_dot_product(q, v), 6) AS rough FROM p JOIN e USING (stream)),
r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY rough DESC, vec_id) AS place FROM d),
s AS (SELECT conv_id, turn, vec_id, CASE WHEN place <= 12 THEN top ELSE rough END AS score FROM a JOIN r USING (probe) JOIN f USING (probe, vec_id))
SELECT conv_id, turn, vec_id, score, rank FROM (SELECT *, {_RANKED} FROM s) WHERE rank <= 4""")
def questions_hybrid_topk(spark, sf):
    return Q.retrieve_hybrid(_asked(spark, sf), _blocks(spark, sf), _KEYS, 4)


@query("G7", f"""WITH {_ASKED}, o AS (SELECT *, (row_number() OVER (PARTITION BY stream ORDER BY vec_id) - 1) // 4 AS grp FROM e), p AS (SELECT DISTINCT probe, stream, q FROM a),
g AS (SELECT probe, stream, grp, round(avg(list_dot_product(q, v)), 6) AS score FROM p JOIN o USING (stream) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, grp)::INTEGER AS rank FROM g)
SELECT conv_id, turn, grp, vec_id, score, rank FROM a JOIN b USING (probe, stream) JOIN o USING (stream, grp) WHERE rank <= 4""")
def questions_chunked_topk(spark, sf):
    placed = with_ordinal(_blocks(spark, sf), ["stream"], ["vec_id"], "place")
    return Q.retrieve_chunks(_asked(spark, sf), placed, _KEYS, 16, 4, place="place")


@query("G2 G3", f"WITH {_ASKED}, n AS (SELECT stream, i, avg(v[i]) AS x FROM e, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT stream, list(x ORDER BY i) AS v FROM n GROUP BY stream) SELECT conv_id, turn, round(list_dot_product(q, v), 6) AS score FROM a JOIN c USING (stream)")
def questions_pooled_similarity(spark, sf):
    return Q.pooled_similarity(_asked(spark, sf), _blocks(spark, sf), _KEYS).withColumn("score", F.round("score", 6))


@query("G10", f"WITH {_DOTS} SELECT conv_id, turn, vec_id, score FROM s WHERE abs(vec_id - probe) <= 20")
def questions_forced_blocks(spark, sf):
    """Blocks named from outside: those within 20 ids of the question's own, as far as they are of its stream."""
    asked = _asked(spark, sf)
    wanted = asked.select(*_KEYS, F.explode(F.sequence(F.col("probe") - 20, F.col("probe") + 20)).alias("vec_id"))
    return Q.forced(asked, wanted, _blocks(spark, sf), _KEYS).withColumn("score", F.round("score", 6))
