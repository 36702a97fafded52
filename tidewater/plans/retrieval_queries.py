"""Retrieval, voting and join queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import vectors as V
from tidewater.operators import joins as J
from tidewater.operators import retrieval as R
from tidewater.operators.sequences import counts_until, first_at_or_after

from .registry import query
from .tables import FRAMES, RESULTS, TURNS, frames, results, table, turns

_DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
_SCORED = f"s AS (SELECT a.vec_id, a.label, round({_DOT}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b)"


def _scored(spark, sf):
    e = table(spark, sf, "embeddings")
    return R.score_blocks(e, R.query_vector(e, 0)).withColumn("score", F.round("score", 6))


@query("G1 G8 G9 A9 J16", f"WITH {_SCORED} SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 8")
def retrieve_topk_dot(spark, sf):
    return R.top_k(_scored(spark, sf).select("vec_id", "score"), 8)


@query("G9", f"WITH {_SCORED} SELECT string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM (SELECT vec_id FROM s ORDER BY score DESC, vec_id LIMIT 8)")
def retrieve_in_order(spark, sf):
    hits = R.top_k(_scored(spark, sf), 8)
    return hits.agg(F.array_join(F.array_sort(F.collect_list("vec_id")), ",").alias("ids"))


@query("G1 J13", f"WITH {_SCORED} SELECT label, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 3")
def retrieve_topk_per_label(spark, sf):
    return R.top_k_per(_scored(spark, sf).select("label", "vec_id", "score"), ["label"], 3)


@query("G2 G3", "WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY ALL) SELECT label, round(sum(v * q.embedding[i]::DOUBLE), 6) AS score FROM p, (SELECT embedding FROM embeddings WHERE vec_id = 0) q GROUP BY label")
def mean_pool_similarity(spark, sf):
    e = table(spark, sf, "embeddings")
    q = R.literal(R.query_vector(e, 0))
    pooled = e.groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]).alias("embedding"))
    return pooled.select("label", F.round(V.dot(F.col("embedding"), q), 6).alias("score"))


_TOKENS = "t AS (SELECT a.vec_id, i, j, list_sum(list_transform(range(1, 9), lambda k: a.embedding[i * 8 + k]::DOUBLE * b.embedding[j * 8 + k]::DOUBLE)) AS s FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b, range(8) x(i), range(8) y(j))"


@query("G4", f"WITH {_TOKENS} SELECT vec_id, round(max(s), 6) AS score FROM t GROUP BY vec_id")
def maxsim(spark, sf):
    e = table(spark, sf, "embeddings")
    return R.max_sim(e, R.query_vector(e, 0)).select("vec_id", F.round("score", 6).alias("score"))


@query("G5", f"WITH {_TOKENS} SELECT vec_id, round(avg(m), 6) AS score FROM (SELECT vec_id, j, max(s) AS m FROM t GROUP BY ALL) GROUP BY vec_id")
def maxsim_mean(spark, sf):
    e = table(spark, sf, "embeddings")
    return R.max_sim(e, R.query_vector(e, 0), then="mean").select("vec_id", F.round("score", 6).alias("score"))


@query("G6", f"WITH s AS (SELECT a.vec_id, {_DOT} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b), {_TOKENS}, k AS (SELECT vec_id FROM s ORDER BY score DESC, vec_id LIMIT 24), m AS (SELECT vec_id, max(s) AS fine FROM t GROUP BY vec_id) SELECT s.vec_id, round(coalesce(fine, score), 6) AS score FROM s LEFT JOIN (SELECT m.* FROM m JOIN k ON m.vec_id = k.vec_id) x ON s.vec_id = x.vec_id ORDER BY coalesce(fine, score) DESC, s.vec_id LIMIT 8")
def hybrid_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return R.hybrid_top_k(e, R.query_vector(e, 0), 8).select("vec_id", F.round("score", 6).alias("score"))


@query("G7", f"WITH {_SCORED}, g AS (SELECT vec_id // 4 AS grp, avg(score) AS m, max(vec_id) AS last FROM s GROUP BY ALL), b AS (SELECT * FROM g ORDER BY round(m, 9) DESC, grp LIMIT 4) SELECT unnest(range(grp * 4, least(grp * 4 + 3, last) + 1)) AS vec_id, round(m, 6) AS mean_score FROM b")
def chunked_topk(spark, sf):
    return R.chunked_top_k(_scored(spark, sf), 16, 4).withColumn("mean_score", F.round("mean_score", 6))


@query("G10", f"WITH {_SCORED} SELECT vec_id, score FROM s WHERE vec_id IN (3, 5, 8, 13, 21)")
def forced_retrieval(spark, sf):
    wanted = spark.createDataFrame([(i,) for i in (3, 5, 8, 13, 21)], "vec_id long")
    return _scored(spark, sf).join(F.broadcast(wanted), "vec_id", "left_semi").select("vec_id", "score")


_LAYERS = "h AS (SELECT label AS layer, vec_id, 1.0 + label % 2 AS weight, rn FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 5)"


def _votes(spark, sf):
    top = R.top_k_per(_scored(spark, sf).select("label", "vec_id", "score"), ["label"], 5)
    return R.layer_votes(top.select(F.col("label").alias("layer"), "vec_id", (1.0 + F.pmod("label", F.lit(2))).cast("double").alias("weight")), 2)


@query("G12", f"WITH {_SCORED}, {_LAYERS} SELECT vec_id, sum(weight)::DOUBLE AS votes FROM h WHERE layer >= 2 GROUP BY ALL")
def layer_vote(spark, sf):
    return _votes(spark, sf)


@query("G12", """WITH l AS (SELECT a.vec_id, layer, round(list_sum(list_transform(range(1, 9), lambda k: a.embedding[layer * 8 + k]::DOUBLE * b.embedding[layer * 8 + k]::DOUBLE)), 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b, range(8) t(layer)),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY score DESC, vec_id) AS rn FROM l) WHERE rn <= 5) SELECT vec_id, sum(1.0 + layer % 2)::DOUBLE AS votes FROM h WHERE layer >= 2 GROUP BY ALL""")
def layer_vote_all_blocks(spark, sf):
    """Each vector as the keys of eight layers; every layer ranks all blocks, so votes of layers meet in a block."""
    e = table(spark, sf, "embeddings")
    asked = V.tokens(R.literal(R.query_vector(e, 0)), 8)
    scores = e.select("vec_id", F.posexplode(F.zip_with(V.tokens(V.doubles(F.col("embedding")), 8), asked, V.dot)).alias("layer", "score"))
    top = R.top_k_per(scores.withColumn("score", F.round("score", 6)), ["layer"], 5)
    return R.layer_votes(top.select("layer", "vec_id", (1.0 + F.pmod("layer", F.lit(2))).cast("double").alias("weight")), 2)


@query("G13 G14 G15 J18", f"WITH {_SCORED}, {_LAYERS}, v AS (SELECT vec_id, sum(weight) AS votes FROM h WHERE layer >= 2 GROUP BY ALL), b AS (SELECT vec_id FROM v ORDER BY votes DESC, vec_id LIMIT 6) SELECT vec_id FROM b UNION SELECT vec_id FROM (SELECT vec_id FROM embeddings ORDER BY vec_id DESC LIMIT 5)")
def recent_union_topk(spark, sf):
    return R.latest_and_best(_votes(spark, sf), table(spark, sf, "embeddings"), 5, 6)


@query("G16 G17 G18", f"""WITH {_SCORED}, k AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY score DESC) AS rn, max(score) OVER (PARTITION BY label) AS top FROM s),
e AS (SELECT label, exp(score - top) AS x, sum(exp(score - top)) OVER (PARTITION BY label) AS z FROM k WHERE rn <= 10), h AS (SELECT label, -sum(x / z * ln(x / z + 1e-10)) / ln(10) AS h FROM e GROUP BY label),
a AS (SELECT label, h, avg(h) OVER (ORDER BY label ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3 FROM h)
SELECT label, round(h, 6) AS entropy, CASE WHEN last3 >= 0.6 THEN 'retrieval' ELSE 'cache_only' END AS strategy, greatest(16, least(32, round_even(16 + 16 * exp(-2 * greatest(0, least(1, h))), 0)))::INTEGER AS k FROM a""")
def entropy_gate(spark, sf):
    ten = R.top_k_per(_scored(spark, sf).select("label", "vec_id", "score"), ["label"], 10)
    per = ten.groupBy("label").agg(F.collect_list("score").alias("scores"))
    h = per.select("label", V.softmax_entropy(F.col("scores")).alias("h"))
    last = F.avg("h").over(W.orderBy("label").rowsBetween(-2, 0))  # one row per layer
    return h.select("label", F.round("h", 6).alias("entropy"), F.when(last >= 0.6, "retrieval").otherwise("cache_only").alias("strategy"), V.dynamic_k(64, F.col("h"), 64).alias("k"))


@query("G19", f"SELECT a.vec_id, round(1 / (1 + exp(-10 * ({_DOT} / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) - 0.3))), 6) AS p FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def past_probability(spark, sf):
    e = table(spark, sf, "embeddings")
    q = R.literal(R.query_vector(e, 0))
    return e.select("vec_id", F.round(V.gated(V.cosine(F.col("embedding"), q)), 6).alias("p"))


@query("G20 K14", "SELECT vec_id, round(list_sum(list_transform(range(1, 17), lambda i: (embedding[i]::DOUBLE + embedding[i + 16]::DOUBLE + embedding[i + 32]::DOUBLE + embedding[i + 48]::DOUBLE) / 4)), 6) AS head_sum, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def grouped_heads(spark, sf):
    v = V.doubles(F.col("embedding"))
    parts = [F.slice(v, 16 * k + 1, 16) for k in range(4)]
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda x, y: x + y)
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(total, F.lit(0.0), lambda a, x: a + x / 4), 6).alias("head_sum"), F.round(V.l2_norm(v), 6).alias("norm"))


@query("G22", f"WITH {FRAMES}, l AS (SELECT event_type, user_id, max(t) AS last_used FROM f GROUP BY ALL) SELECT event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY last_used, user_id) AS rn FROM l) WHERE rn <= 3")
def lru_eviction(spark, sf):
    used = frames(spark, sf).groupBy("event_type", "user_id").agg(F.max("t").alias("last_used"))
    order = W.partitionBy("event_type").orderBy("last_used", "user_id")
    return used.withColumn("rn", F.row_number().over(order)).where("rn <= 3").select("event_type", "user_id")


_WINDOWS = f"WITH {FRAMES}, p AS (SELECT user_id, t / 3600 AS start, t / 3600 + 2.5 AS \"end\" FROM f WHERE event_type = 'purchase'), s AS (SELECT DISTINCT user_id, floor(t / 3600)::BIGINT AS sec FROM f)"


@query("G23 H9 J20", _WINDOWS + """, o AS (SELECT p.user_id, sum(least("end", sec + 1) - greatest(start, sec)) AS overlap FROM p JOIN s ON p.user_id = s.user_id AND sec >= floor(start) AND sec < ceil("end") GROUP BY ALL),
g AS (SELECT user_id, sum("end" - start) AS gt FROM p GROUP BY ALL), c AS (SELECT user_id, count(*) AS n FROM s GROUP BY ALL)
SELECT g.user_id, round(coalesce(overlap, 0) / gt, 6) AS recall, round(coalesce(overlap, 0) / n, 6) AS "precision", round(coalesce(2 * (overlap / gt) * (overlap / n) / nullif(overlap / gt + overlap / n, 0), 0), 6) AS f1 FROM g LEFT JOIN o ON g.user_id = o.user_id LEFT JOIN c ON g.user_id = c.user_id""")
def window_prf(spark, sf):
    f = frames(spark, sf).withColumn("h", F.col("t") / 3600)
    windows = f.where("event_type = 'purchase'").select("user_id", F.col("h").alias("start"), (F.col("h") + 2.5).alias("end"))
    seconds = f.select("user_id", F.floor("h").alias("sec")).distinct()
    out = R.window_overlap(windows, seconds, ["user_id"])
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query("G24 K15", f"WITH {_SCORED} SELECT label, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS least, max(score) AS most, round(median(score), 6) AS median FROM s GROUP BY label")
def retrieval_stats(spark, sf):
    return _scored(spark, sf).groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.median("score"), 6).alias("median")
    )


@query("G25", f"WITH {_SCORED} SELECT label, vec_id, score FROM s WHERE label = (SELECT min(label) FROM embeddings)")
def timeline_lookup(spark, sf):
    s = _scored(spark, sf)
    first = s.agg(F.min("label").alias("first"))
    return s.join(F.broadcast(first), F.col("label") == F.col("first")).select("label", "vec_id", "score")


# joins


@query("H1 D10 D12", r"""WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS n FROM documents), r AS (SELECT d.text, max(l.quality)::VARCHAR AS quality FROM d JOIN labels l USING (doc_id) GROUP BY d.text),
o AS (SELECT regexp_extract(text, '^entire_([0-9]{3,18})_', 1)::BIGINT AS n, regexp_replace(text, '^entire_[0-9]+_', '') AS rest, quality FROM r WHERE regexp_matches(text, '^entire_[0-9]{3,18}_'))
SELECT d.doc_id, coalesce(a.quality, b.quality, c.quality, max(o.quality), '') AS quality FROM d LEFT JOIN r a ON d.text = a.text LEFT JOIN r b ON lower(d.text) = b.text LEFT JOIN r c ON regexp_replace(d.text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') = c.text
LEFT JOIN o ON o.n = d.n AND o.rest = d.text GROUP BY d.doc_id, a.quality, b.quality, c.quality""")
def priority_match_texts(spark, sf):
    from tidewater.operators.sequences import with_rank

    # digests stand for whole texts, so that texts are not shuffled; 'entire_007_x' matches x of the seventh document
    key = lambda c: F.sha2(c.cast("binary"), 256)
    n = F.regexp_extract("text", r"(?s)^entire_(\d{3,18})_", 1).try_cast("long")
    rest = F.when(F.col("text").startswith(F.format_string("entire_%03d_", n)), F.regexp_replace("text", r"(?s)^entire_\d+_", ""))
    tried = [F.col("text"), F.lower("text"), F.regexp_replace("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")]
    d = table(spark, sf, "documents").select("doc_id", *[key(c).alias(f"q{i}") for i, c in enumerate(tried)], n.alias("n"), key(rest).alias("rest"))
    right = d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id")
    right = right.select("quality", F.col("q0").alias("rk"), F.concat(F.col("n").cast("string"), F.lit("_"), F.col("rest")).alias("ro"))
    left = with_rank(d.drop("n", "rest"), "doc_id").withColumn("q3", F.concat((F.col("rank") + 1).cast("string"), F.lit("_"), F.col("q0")))
    tries = [(F.col(f"q{i}"), F.col("rk")) for i in range(3)] + [(F.col("q3"), F.col("ro"))]
    return J.priority_lookup(left, right, tries, "quality").select("doc_id", "quality")


@query("H2", """WITH o AS (SELECT DISTINCT substr(text, 1, strpos(text, '. ') + 1) AS p FROM documents WHERE strpos(text, '. ') > 0)
SELECT doc_id, count(*) AS n, max(length(p))::INTEGER AS longest FROM documents JOIN o ON starts_with(text, p) GROUP BY doc_id""")
def prefix_match_join(spark, sf):
    """Of the first sentences of all documents, each once, those that start a document's text."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    cut = F.instr("text", ". ")
    openings = d.where(cut > 0).select(F.substr("text", F.lit(1), cut + 1).alias("p")).distinct()
    return J.prefix_match(d, openings, "text", "p").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("p")).alias("longest"))


@query("H2", "WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) SELECT u.conv_id, u.turn AS a, r.turn AS b FROM n u JOIN n r ON u.conv_id = r.conv_id AND u.n = r.n WHERE u.role = 'user' AND r.role = 'assistant'")
def consumed_replies(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    a, b = c.where("role = 'user'").select("conv_id", F.col("turn").alias("a")), c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("b"))
    return J.greedy_pairs(a, b, "conv_id", "a", "b")


@query("H3", f"WITH {RESULTS} SELECT a.qid FROM r a JOIN (SELECT qid, CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END AS correct FROM r) b ON a.qid = b.qid WHERE a.correct = 1 AND b.correct = 0")
def run_diff(spark, sf):
    r = results(spark, sf)
    return J.run_diff(r, r.select("qid", (F.col("n_chars") % 2 == 0).cast("long").alias("correct")), "qid")


@query("H4 H11 B5", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_pending(spark, sf):
    return J.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("H5 H10 A13", "SELECT d.doc_id, l.quality, coalesce(b.text, '') AS subtitle FROM documents d JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def lookup_join(spark, sf):
    d, lab, b = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "benchmark")
    return d.join(lab, "doc_id").join(b, d.doc_id == b.item_id, "left").select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("subtitle"))


@query("F6", f"WITH {FRAMES}, g AS (SELECT user_id, unnest(range(0, 700, 50)) * 1.0 AS tick FROM (SELECT DISTINCT user_id FROM f)), p AS (SELECT user_id, t / 3600 AS h FROM f) SELECT g.user_id, g.tick::DOUBLE AS tick, round(min(p.h), 6) AS h FROM g LEFT JOIN p ON p.user_id = g.user_id AND p.h >= g.tick GROUP BY ALL")
def asof_forward(spark, sf):
    p = frames(spark, sf).select("user_id", (F.col("t") / 3600).alias("h"))
    ticks = p.select("user_id").distinct().withColumn("tick", F.explode(F.array(*[F.lit(float(x)) for x in range(0, 700, 50)])))
    return first_at_or_after(ticks, p, ["user_id"], "tick", "h").withColumn("h", F.round("h", 6))


@query("H7", "SELECT a.n, a.doc_id, b.vec_id FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, doc_id FROM documents) a JOIN (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id FROM embeddings) b ON a.n = b.n")
def positional_join(spark, sf):
    from tidewater.operators.sequences import with_rank

    a = with_rank(table(spark, sf, "documents").select("doc_id"), "doc_id").select(F.col("rank").alias("n"), "doc_id")
    b = with_rank(table(spark, sf, "embeddings").select("vec_id"), "vec_id").select(F.col("rank").alias("n"), "vec_id")
    return a.join(b, "n")


@query("H8", f"WITH {FRAMES}, {TURNS} SELECT q.conv_id, q.turn, count(*) AS n_visible FROM q JOIN f ON f.user_id = q.conv_id AND f.t / 3600 <= q.realtime * 50 GROUP BY ALL")
def visible_frames(spark, sf):
    f = frames(spark, sf).select(F.col("user_id").alias("conv_id"), (F.col("t") / 3600).alias("h"))
    q = turns(spark, sf).select("conv_id", "turn", (F.col("realtime") * 50).alias("until"))
    return counts_until(q, f, ["conv_id"], ["turn"], "until", "h").where("n > 0").withColumnRenamed("n", "n_visible")


@query("H14", f"WITH {FRAMES}, i AS (SELECT user_id, event_id AS span, t / 3600 AS start, t / 3600 + 3 AS \"end\" FROM f WHERE event_type = 'purchase') SELECT f.event_id, count(*) AS n FROM f JOIN i ON f.user_id = i.user_id AND f.t / 3600 BETWEEN i.start AND i.\"end\" GROUP BY f.event_id")
def interval_stab(spark, sf):
    f = frames(spark, sf).withColumn("h", F.col("t") / 3600)
    spans = f.where("event_type = 'purchase'").select("user_id", F.col("h").alias("start"), (F.col("h") + 3).alias("end"))
    return J.stab(f.select("user_id", "event_id", "h"), spans, ["user_id"], "h", "start", "end").groupBy("event_id").agg(F.count("*").alias("n"))


@query("H14", f"""WITH {FRAMES}, h AS (SELECT user_id, event_id, event_type, t / 3600 AS h FROM f), i AS (SELECT user_id, event_id AS span, h AS start, h + pow(event_id % 11, 3) AS "end" FROM h WHERE event_type = 'purchase')
SELECT i.span, count(*) AS n FROM h JOIN i ON h.user_id = i.user_id AND h.h BETWEEN i.start AND i."end" GROUP BY i.span""")
def stab_of_any_length(spark, sf):
    """Intervals from no length at all to more than a month."""
    f = frames(spark, sf).select("user_id", "event_id", "event_type", (F.col("t") / 3600).alias("h"))
    spans = f.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span"), F.col("h").alias("start"), (F.col("h") + F.pow(F.pmod("event_id", F.lit(11)), F.lit(3))).alias("end"))
    return J.stab(f.select("user_id", "h"), spans, ["user_id"], "h", "start", "end").groupBy("span").agg(F.count("*").alias("n"))


@query("H9", f"""WITH {FRAMES}, h AS (SELECT user_id, event_id, event_type, t / 3600 AS h FROM f), a AS (SELECT user_id, event_id, h AS start, h + pow(event_id % 9, 3) AS "end" FROM h WHERE event_type = 'purchase'), b AS (SELECT user_id, h AS start, h + event_id % 30 AS "end" FROM h WHERE event_type = 'error')
SELECT a.event_id, count(*) AS n, round(sum(least(a."end", b."end") - greatest(a.start, b.start)), 6) AS shared FROM a JOIN b ON a.user_id = b.user_id AND a.start <= b."end" AND b.start <= a."end" GROUP BY a.event_id""")
def interval_overlap(spark, sf):
    f = frames(spark, sf).select("user_id", "event_id", "event_type", (F.col("t") / 3600).alias("h"))
    a = f.where("event_type = 'purchase'").select("user_id", "event_id", F.col("h").alias("start"), (F.col("h") + F.pow(F.pmod("event_id", F.lit(9)), F.lit(3))).alias("end"))
    b = f.where("event_type = 'error'").select("user_id", F.col("h").alias("start2"), (F.col("h") + F.pmod("event_id", F.lit(30))).alias("end2"))
    both = J.overlapping(a, b, ["user_id"], ("start", "end"), ("start2", "end2"))
    shared = F.least("end", "end2") - F.greatest("start", "start2")
    return both.groupBy("event_id").agg(F.count("*").alias("n"), F.round(F.sum(shared), 6).alias("shared"))


@query("H12")
def track_faces(spark, sf):
    frame = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    x1 = F.coalesce("value", F.lit(0.0))
    b = table(spark, sf, "events").select(F.col("user_id").alias("video"), frame.alias("frame"), x1.alias("x1"), F.lit(0.0).alias("y1"), (x1 + 100).alias("x2"), F.lit(10.0).alias("y2"))
    return J.track_boxes(b, "video")


@query("A21 A22", "SELECT page_id, url FROM pages WHERE page_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND url NOT LIKE '%spam%'")
def existing_not_denied(spark, sf):
    from tidewater.sources.files import existing_only

    listing = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("page_id"))
    return existing_only(table(spark, sf, "pages").select("page_id", "url"), listing, "page_id").where(~F.col("url").contains("spam"))


def event_boxes(spark, sf):
    """Events as scored boxes: the user as picture, the value as place, the event's number as size and score."""
    x1, side = F.coalesce("value", F.lit(0.0)), (F.pmod("event_id", F.lit(7)) + 4).cast("double")
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("picture"), F.col("event_id").alias("id"), x1.alias("x1"), F.lit(0.0).alias("y1"), (x1 + side).alias("x2"), side.alias("y2"), F.pmod(F.col("event_id") * 7919, F.lit(1000)).cast("double").alias("score"))


@query("H13")
def suppressed_boxes(spark, sf):
    return J.suppress_overlaps(event_boxes(spark, sf), "picture")
