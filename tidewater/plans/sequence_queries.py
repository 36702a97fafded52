"""Partitioning, sampling, windowing, packing and numeric queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import timeline as T
from tidewater.functions import vectors as V
from tidewater.operators import numeric as N
from tidewater.operators import scans as Sc
from tidewater.operators import sequences as S

from .registry import query
from .tables import FRAMES, RESULTS, TURNS, frames, results, table, turns

_POS = "p AS (SELECT user_id, event_id, event_type, value, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM f)"
WITH = f"WITH {FRAMES}, {_POS} "


def positions(spark, sf):
    """A user's frames with their position i and number n."""
    w = W.partitionBy("user_id")
    return frames(spark, sf).withColumns({"i": F.row_number().over(w.orderBy("t", "event_id")).cast("long") - 1, "n": F.count("*").over(w)})


@query("C1 C6", "SELECT doc_id, floor(rank / ceil(n / 4.0))::BIGINT AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents)")
def contiguous_split(spark, sf):
    return S.contiguous_parts(table(spark, sf, "documents").select("doc_id"), "doc_id", 4).select("doc_id", "part")


@query("C2 C5", "SELECT doc_id, rank % 8 AS part, rank // 8 AS place, rank % 4 = 3 AS in_subset FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents)")
def round_robin_split(spark, sf):
    r = S.with_rank(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return r.select("doc_id", F.pmod("rank", F.lit(8)).alias("part"), F.floor(F.col("rank") / 8).alias("place"), (F.pmod("rank", F.lit(4)) == 3).alias("in_subset"))


@query("C4 E2", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents")
def inverse_round_robin(spark, sf):
    parts = round_robin_split(spark, sf)
    return parts.select("doc_id", (F.col("part") + 8 * F.col("place")).alias("rank"))


@query("C8", "SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) // 8 AS batch FROM documents")
def length_buckets(spark, sf):
    d = table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    return S.with_ordinal(d, ["lang"], ["n_chars", "doc_id"], "n").select("lang", "doc_id", F.floor(F.col("n") / 8).alias("batch"))


@query("C9", "SELECT doc_id FROM documents WHERE doc_id // 8 NOT IN (3, 4, 5)")
def delete_batches(spark, sf):
    gone = spark.createDataFrame([(3,), (4,), (5,)], "batch long")
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"))
    return d.join(F.broadcast(gone), "batch", "left_anti").select("doc_id")


@query("C10", """WITH d AS (SELECT source, doc_id, n_chars + 1 AS len, coalesce(sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, sum(n_chars + 1) OVER (PARTITION BY source)::BIGINT AS total FROM documents),
x AS (SELECT *, unnest(range(pos // 4096, (pos + len - 1) // 4096 + 1)) AS piece FROM d)
SELECT source, piece, doc_id, greatest(pos, piece * 4096) - pos AS from_token, least(pos + len, (piece + 1) * 4096) - pos AS to_token FROM x WHERE (piece + 1) * 4096 <= total""")
def pack_constant_length(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("stream"), "doc_id", "n_chars")
    return S.pack_constant(d, ["stream"], "doc_id", "n_chars", 4096).select(F.col("stream").alias("source"), "piece", F.col("source").alias("doc_id"), "from_token", "to_token")


@query("F1", WITH + "SELECT event_id FROM p WHERE i % 7 = 0")
def stride_sample(spark, sf):
    return positions(spark, sf).where(F.pmod("i", F.lit(7)) == 0).select("event_id")


_UNIFORM = "u AS (SELECT user_id, n, j, CASE WHEN n <= 16 THEN j ELSE {f}(j * ((n - 1)::DOUBLE / 15)) END::INTEGER AS pos FROM (SELECT DISTINCT user_id, n FROM p), range(16) t(j) WHERE j < n)"


@query("F2", WITH + ", " + _UNIFORM.format(f="floor") + " SELECT user_id, pos FROM u")
def uniform_k(spark, sf):
    n = frames(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.explode(T.uniform_positions(F.col("n"), 16)).alias("pos"))


@query("F3", WITH + ", u AS (SELECT user_id, n, j, CASE WHEN n <= 16 THEN j ELSE round_even(j * ((n - 1)::DOUBLE / 15), 0) END::INTEGER AS pos FROM (SELECT DISTINCT user_id, n FROM p), range(16) t(j) WHERE j < n) SELECT user_id, pos FROM u")
def uniform_k_rounded(spark, sf):
    n = frames(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.explode(T.uniform_positions(F.col("n"), 16, rounded=True)).alias("pos"))


@query("F4", WITH + ", v AS (SELECT user_id, count(*) AS n FROM p WHERE t / 3600 <= 300 GROUP BY user_id) SELECT user_id, CASE WHEN n <= 8 THEN j ELSE floor(j * ((n - 1)::DOUBLE / 7)) END::INTEGER AS pos FROM v, range(8) t(j) WHERE j < n")
def prefix_uniform(spark, sf):
    n = frames(spark, sf).where(F.col("t") / 3600 <= 300).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.explode(T.uniform_positions(F.col("n"), 8)).alias("pos"))


@query("F7 J19", "SELECT DISTINCT doc_id, unnest(list_concat([doc_id % 5, doc_id % 7], [2, 4])) AS pos FROM documents")
def keep_necessary(spark, sf):
    base = F.array(F.pmod("doc_id", F.lit(5)), F.pmod("doc_id", F.lit(7)))
    both = F.array_sort(F.array_union(base, F.array(F.lit(2), F.lit(4)).cast("array<bigint>")))
    return table(spark, sf, "documents").select("doc_id", F.explode(both).alias("pos"))


@query("F10 L11 J21", WITH + "SELECT event_id FROM p WHERE i >= n - 5")
def recent_window(spark, sf):
    return positions(spark, sf).where(F.col("i") >= F.col("n") - 5).select("event_id")


@query("F12", WITH + ", h AS (SELECT user_id, event_id, (((7 * 31 + user_id * 2654435761) % 4294967296) * 31 + event_id * 2654435761) % 4294967296 AS h FROM p) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY h, event_id) - 1 AS new_pos FROM h")
def seeded_shuffle(spark, sf):
    h = positions(spark, sf).withColumn("h", S.seeded_order(7, "user_id", "event_id"))
    return h.select("user_id", "event_id", S.ordinal(["user_id"], ["h", "event_id"]).alias("new_pos"))


@query("F13", WITH + "SELECT event_id FROM p WHERE i < floor(n * 0.35) OR i >= floor(n * 0.65)")
def middle_crop(spark, sf):
    return positions(spark, sf).where((F.col("i") < F.floor(F.col("n") * 0.35)) | (F.col("i") >= F.floor(F.col("n") * 0.65))).select("event_id")


@query("F14 D22 M14", WITH + "SELECT event_id, CASE WHEN i >= 3 AND i < 6 THEN n - 6 + i - 3 ELSE (CASE WHEN (CASE WHEN i >= 6 THEN i - 3 ELSE i END) >= n - 6 THEN (CASE WHEN i >= 6 THEN i - 3 ELSE i END) + 3 ELSE (CASE WHEN i >= 6 THEN i - 3 ELSE i END) END) END AS new_pos FROM p WHERE n >= 12")
def segment_move(spark, sf):
    p = positions(spark, sf).where("n >= 12")
    return p.select("event_id", T.moved_position(F.col("i"), F.lit(3), F.lit(6), F.col("n") - 3).cast("long").alias("new_pos"))


@query("F18", "SELECT doc_id, 1 + doc_id % 5 AS before, ((doc_id % 5) // 4 + 1) * 4 AS after FROM documents")
def pad_to_multiple(spark, sf):
    from tidewater.functions.text import pad_last

    a = F.sequence(F.lit(0).cast("long"), F.pmod("doc_id", F.lit(5)))
    return table(spark, sf, "documents").select("doc_id", F.size(a).cast("long").alias("before"), F.size(pad_last(a, 4)).cast("long").alias("after"))


@query("F20 E13", "SELECT doc_id, 10 + (7 * 31 + doc_id * 2654435761) % 4294967296 % 20 AS length, (7 * 31 + doc_id * 2654435761) % 4294967296 / 4294967296.0 < 0.25 AS passes FROM documents")
def seeded_gate(spark, sf):
    h = S.seeded_order(7, "doc_id")
    return table(spark, sf, "documents").select("doc_id", (10 + F.pmod(h, F.lit(20))).alias("length"), (h / 4294967296.0 < 0.25).alias("passes"))


# windows


@query("I1 I2 J2 J12", f"WITH {TURNS} SELECT conv_id, turn, lag(realtime, 1, 0) OVER (PARTITION BY conv_id ORDER BY realtime, turn) AS start_time, realtime AS end_time FROM q")
def conversation_windows(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", S.previous_end(["conv_id"], ["realtime", "turn"], "realtime").alias("start_time"), F.col("realtime").alias("end_time"))


@query("I3", "SELECT source, min_by(n_chars, doc_id) FILTER (n_chars % 2 = 0) AS duration, count(*) AS n FROM documents GROUP BY source")
def first_known_duration(spark, sf):
    known = F.when(F.col("n_chars") % 2 == 0, F.col("doc_id"))
    return table(spark, sf, "documents").groupBy("source").agg(F.min_by("n_chars", known).alias("duration"), F.count("*").alias("n"))


@query("J1", "SELECT doc_id, source || '_' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS key FROM documents")
def occurrence_ordinal(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    return S.with_ordinal(d, ["source"], ["doc_id"], "n").select("doc_id", F.concat("source", F.lit("_"), F.col("n").cast("string")).alias("key"))


@query("J3 E4 E1", """WITH w AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark WHERE NOT contains(text, '[') AND NOT contains(text, ']')),
x AS (SELECT item_id, list_filter(ws, lambda v, i: i = 1 OR v <> ws[i - 1]) AS k FROM w), y AS (SELECT item_id, k, unnest(range(0, len(k))) AS pos FROM x)
SELECT item_id, pos::INTEGER AS pos, k[pos + 1] AS word, round(10.0 + pos * (30.0 / len(k)), 6) AS word_start, round(10.0 + (pos + 1) * (30.0 / len(k)), 6) AS word_end FROM y""")
def explode_words(spark, sf):
    w = S.explode_words(table(spark, sf, "benchmark"), "text", F.lit(10.0), F.lit(40.0))
    return w.select("item_id", "pos", "word", F.round("word_start", 6).alias("word_start"), F.round("word_end", 6).alias("word_end"))


def _clips(spark, sf, **options):
    """Clips of the documents as transcripts with times from the places of their words, and the words before each."""
    words = F.split("text", " ")
    start = F.transform(words, lambda w, i: F.pmod(i * 7 + F.col("video"), F.lit(5)) * 0.25 + i * 2.0)
    d = table(spark, sf, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("video"), "text", start.alias("start"), words.alias("word"))
    d = d.withColumn("end", F.transform("start", lambda t: t + 0.5))
    n = F.when(F.octet_length("text") < Sc.BLOCK, 0).otherwise(F.size(words))
    clips = Sc.cut_transcripts(d, key="video", n=n, **options)
    return clips.select("video", "clip", "first", "n", "start", "end", Sc.words_before("text", "first").alias("previous"))


@query("J4 Q6")
def clip_cut(spark, sf):
    return _clips(spark, sf, least=30, most=240, gap=2.6)


@query("J5")
def clip_cut_sentences(spark, sf):
    return _clips(spark, sf, least=10, most=240, gap=3.2, by="start", sentences=True)


@query("J4 L12", f"WITH {FRAMES}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 36000 THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(t) AS start, max(t) AS \"end\" FROM s GROUP BY ALL")
def gap_sessionize(spark, sf):
    s = S.gap_sessions(frames(spark, sf), ["user_id"], "t", 36000, "event_id")
    return s.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end"))


@query("J6", "SELECT conv_id, turn, coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS previous FROM conversations")
def context_before(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.running_text(["conv_id"], ["turn"], "text").alias("previous"))


@query("J7 B4 M12", "SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seek FROM documents")
def exclusive_prefix_sum(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return S.with_prefix_sum(d, ["source"], ["doc_id"], "n_chars", "seek").select("source", "doc_id", "seek")


@query("J8 D17", WITH + ", g AS (SELECT user_id, i // 4 AS grp, min(t) AS a FROM p GROUP BY ALL), l AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY grp) AS b FROM g) SELECT user_id, grp, round(a, 3) AS start, round(b, 3) AS next_start FROM l")
def frame_groups(spark, sf):
    g = positions(spark, sf).groupBy("user_id", F.floor(F.col("i") / 4).alias("grp")).agg(F.min("t").alias("a"))
    return g.select("user_id", "grp", F.round("a", 3).alias("start"), F.round(F.lead("a").over(W.partitionBy("user_id").orderBy("grp")), 3).alias("next_start"))


@query("J9 L7", WITH + "SELECT user_id, CASE WHEN i < 6 THEN 0 ELSE 1 + (i - 6) // 2 END AS grp, count(*) AS n FROM p GROUP BY ALL")
def steady_windows(spark, sf):
    return positions(spark, sf).groupBy("user_id", T.steady_group(F.col("i")).alias("grp")).agg(F.count("*").alias("n"))


@query("J10", "WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN '' ELSE text END AS text FROM conversations), m AS (SELECT conv_id, max(turn) AS last FROM c WHERE text <> '' GROUP BY conv_id) SELECT c.conv_id, c.turn FROM c JOIN m ON c.conv_id = m.conv_id WHERE turn <= last")
def trailing_trim(spark, sf):
    c = table(spark, sf, "conversations").withColumn("text", F.when(F.length("text") % 3 == 0, "").otherwise(F.col("text")))
    return S.trailing_trim(c, ["conv_id"], "turn", "text").select("conv_id", "turn")


@query("J11", "SELECT source, doc_id FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents) WHERE s <= 20000")
def cumulative_cap(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return S.with_prefix_sum(d, ["source"], ["doc_id"], "n_chars", "s").where("s + n_chars <= 20000").select("source", "doc_id")


@query("J14", "SELECT vec_id, list_position(list_transform(embedding, lambda x: x::DOUBLE), list_max(list_transform(embedding, lambda x: x::DOUBLE)))::BIGINT - 1 AS choice FROM embeddings")
def constrained_argmax(spark, sf):
    options = V.doubles(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", (F.array_position(options, F.array_max(options)) - 1).alias("choice"))


@query("J17 B2", f"WITH {RESULTS} SELECT qid, 32 AS k FROM r WHERE retrieve_size = 32 UNION ALL SELECT qid, 64 FROM r WHERE retrieve_size = 64")
def union_runs(spark, sf):
    from tidewater.sources.files import merge_shards

    r = results(spark, sf)
    return merge_shards(*[r.where(F.col("retrieve_size") == k).select("qid", F.lit(k).alias("k")) for k in (32, 64)])


@query("J22 L10", WITH + ", g AS (SELECT user_id, floor(t / 86400)::BIGINT AS tick, count(*) AS n FROM f GROUP BY ALL) SELECT user_id, tick, n, lead(tick) OVER (PARTITION BY user_id ORDER BY tick) IS NULL AS gets_query FROM g")
def tick_turns(spark, sf):
    g = frames(spark, sf).groupBy("user_id", F.floor(F.col("t") / 86400).alias("tick")).agg(F.count("*").alias("n"))
    return g.select("user_id", "tick", "n", F.lead("tick").over(W.partitionBy("user_id").orderBy("tick")).isNull().alias("gets_query"))


@query("E10", "SELECT user_id, coalesce(count(DISTINCT event_id // 10) FILTER (value > 50)::DOUBLE / nullif(count(DISTINCT event_id // 10), 0), -1) AS ratio FROM events GROUP BY user_id")
def speaking_ratio(spark, sf):
    e = table(spark, sf, "events").select("user_id", "value", F.floor(F.col("event_id") / 10).alias("frame"))
    seen, spoke = F.count_distinct("frame"), F.count_distinct(F.when(F.col("value") > 50, F.col("frame")))
    return e.groupBy("user_id").agg(F.coalesce(F.try_divide(spoke.cast("double"), seen), F.lit(-1.0)).alias("ratio"))


@query("E1 E11", "SELECT doc_id FROM documents WHERE n_chars > 0 AND len(string_split(text, ' ')) / (n_chars / 10.0) BETWEEN 1 AND 4 AND n_chars > 448")
def rate_band(spark, sf):
    wps = F.size(F.split("text", " ")) / (F.col("n_chars") / 10.0)
    return table(spark, sf, "documents").where("n_chars > 448").where(wps.between(1, 4)).select("doc_id")


@query("E2", "SELECT doc_id, (length(text) * 7919 % 1000) / 1000.0::DOUBLE AS score FROM documents WHERE (length(text) * 7919 % 1000) / 1000.0 BETWEEN 0.15 AND 0.5")
def score_band(spark, sf):
    from tidewater.plans.seams import stub_score

    return stub_score(table(spark, sf, "documents").select("doc_id", "text"), "text").where(F.col("score").between(0.15, 0.5)).select("doc_id", F.col("score").cast("double").alias("score"))


@query("E14", WITH + "SELECT event_id FROM p WHERE i % 4 = 0")
def frame_rate_policy(spark, sf):
    return positions(spark, sf).where(F.pmod("i", F.lit(4)) == 0).select("event_id")


@query("E16", WITH + ", x AS (SELECT user_id, event_id, t, t / 3600 BETWEEN 100 AND 110 AS inside, abs(t / 3600 - 100) AS d FROM f), a AS (SELECT user_id, bool_or(inside) AS has_one FROM x GROUP BY user_id), y AS (SELECT x.*, has_one, row_number() OVER (PARTITION BY x.user_id ORDER BY d, event_id) AS rn FROM x JOIN a ON x.user_id = a.user_id) SELECT user_id, event_id FROM y WHERE inside OR (NOT has_one AND rn = 1)")
def range_or_nearest(spark, sf):
    h = F.col("t") / 3600
    w = W.partitionBy("user_id")
    x = frames(spark, sf).withColumns({"inside": h.between(100, 110), "d": F.abs(h - 100)})
    x = x.withColumns({"some": F.max("inside").over(w), "rn": F.row_number().over(w.orderBy("d", "event_id"))})
    return x.where("inside or (not some and rn = 1)").select("user_id", "event_id")


# numeric


@query("K2", "SELECT user_id, round(avg(value) FILTER (event_type <> 'purchase'), 6) AS mean, round(var_samp(value) FILTER (event_type <> 'purchase'), 5) AS var, count(*) FILTER (event_type <> 'purchase') AS n FROM events GROUP BY user_id")
def masked_stats(spark, sf):
    e = table(spark, sf, "events").withColumn("mask", F.col("event_type") != "purchase")
    return N.masked_stats(e, "user_id", "value", "mask").select("user_id", F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"), "n")


@query("K2", "SELECT event_id, round((value - avg(value) OVER (PARTITION BY user_id)) / sqrt(var_samp(value) OVER (PARTITION BY user_id) + 1e-8), 5) AS z FROM events")
def masked_whiten(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(N.whiten(F.col("value"), ["user_id"]), 5).alias("z"))


@query("K1 K3", "SELECT vec_id, round(x[3] - ln(list_sum(list_transform(x, lambda v: exp(v)))), 6) AS logp, round(ln(list_sum(list_transform(x, lambda v: exp(v)))) - list_sum(list_transform(x, lambda v: exp(v) * v)) / list_sum(list_transform(x, lambda v: exp(v))), 6) AS entropy FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)")
def logits(spark, sf):
    x = V.doubles(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.log_softmax_at(x, F.lit(2)), 6).alias("logp"), F.round(V.entropy_of_logits(x), 6).alias("entropy"))


@query("K4", "WITH p AS (SELECT source, doc_id, n_chars / sum(n_chars) OVER (PARTITION BY source) AS p FROM documents), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY source ORDER BY p DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT source, doc_id FROM c WHERE before < 0.9137")
def nucleus_filter(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    total = d.groupBy("source").agg(F.sum("n_chars").alias("total"))
    p = S.joined_on(d, total, ["source"]).withColumn("p", F.col("n_chars") / F.col("total"))
    return N.nucleus(p, ["source"], "p", "doc_id", 0.9137).select("source", "doc_id")


@query("K5", "WITH x AS (SELECT conv_id, turn, count(*) OVER w AS n, (length(text) % 3)::DOUBLE / 3.0::DOUBLE AS r, (length(text) % 7)::DOUBLE / 7.0::DOUBLE AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WINDOW w AS (PARTITION BY conv_id)), d AS (SELECT *, r + 0.99 * coalesce(lead(v) OVER (PARTITION BY conv_id ORDER BY turn), 0) - v AS delta FROM x) SELECT a.conv_id, a.turn, round(sum(pow(0.99 * 0.95, b.i - a.i) * b.delta), 6) AS adv FROM d a JOIN d b ON a.conv_id = b.conv_id AND b.i >= a.i GROUP BY ALL")
def gae(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", ((F.length("text") % 3) / 3.0).cast("double").alias("r"), ((F.length("text") % 7) / 7.0).cast("double").alias("v"))
    found = Sc.generalized_advantage(c, ["conv_id"], ["turn"], "r", "v", 0.99, 0.95)
    return found.select("conv_id", "turn", F.round("advantage", 6).alias("adv"))


@query("K6", "SELECT conv_id, turn, round(-0.1::DOUBLE * (length(text) % 5 - length(text) % 3), 6) + CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM conversations")
def kl_penalty(spark, sf):
    kl = N.kl_penalty((F.length("text") % 5).cast("double"), (F.length("text") % 3).cast("double"), "kl")
    last = F.col("turn") == F.max("turn").over(W.partitionBy("conv_id"))
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.round(-0.1 * kl, 6) + F.when(last, 1.0).otherwise(0.0)).alias("reward"))


@query("K7", "SELECT source, count(*) AS n, round(avg(n_chars::DOUBLE), 6) AS mean, round(var_samp(n_chars::DOUBLE), 3) AS var FROM documents GROUP BY source")
def running_moments(spark, sf):
    return N.merge_moments(table(spark, sf, "documents"), "source", "n_chars").select("source", "n", F.round("mean", 6).alias("mean"), F.round("var", 3).alias("var"))


@query("K8", "WITH w AS (SELECT event_id, value, avg(value) OVER h AS m, stddev_pop(value) OVER h AS s, count(value) OVER h AS n, avg(value) OVER () AS gm, stddev_pop(value) OVER () AS gs FROM events WINDOW h AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) SELECT event_id, round(CASE WHEN n < 8 THEN (value - gm) / (gs + 1e-6) ELSE (value - m) / (s + 1e-6) END, 4) AS z FROM w")
def zscore_history(spark, sf):
    return N.history_zscore(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 16, 8).select("event_id", F.round("z", 4).alias("z"))


@query("K9", """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) / 100.0::DOUBLE AS kl FROM conversations),
r AS (SELECT conv_id, 0::BIGINT AS n, 0.2::DOUBLE AS c FROM t GROUP BY conv_id UNION ALL SELECT r.conv_id, t.n, r.c * (1 + greatest(-0.2, least(0.2, t.kl / 6 - 1)) * (256 / 10000.0::DOUBLE)) FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)
SELECT conv_id, round(arg_max(c, n), 6) AS coefficient FROM r GROUP BY conv_id""")
def adaptive_controller(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", (F.length("text") / 100.0).cast("double").alias("kl"))
    return Sc.controller_end(c, ["conv_id"], "kl", 0.2, 6.0, 10000.0, 256).withColumn("coefficient", F.round("coefficient", 6))


@query("K9", """WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) / 100.0::DOUBLE AS kl FROM conversations),
r AS (SELECT conv_id, NULL::BIGINT AS turn, 0::BIGINT AS n, 0.2::DOUBLE AS c FROM t GROUP BY conv_id UNION ALL SELECT r.conv_id, t.turn, t.n, r.c * (1 + greatest(-0.2, least(0.2, t.kl / 6 - 1)) * (256 / 10000.0::DOUBLE)) FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)
SELECT conv_id, turn, round(c, 6) AS coefficient FROM r WHERE n > 0""")
def controller_path(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), (F.length("text") / 100.0).cast("double").alias("kl"))
    path = Sc.controller_path(c, ["conv_id"], ["turn"], "kl", 0.2, 6.0, 10000.0, 256)
    return path.select("conv_id", "turn", F.round("coefficient", 6).alias("coefficient"))


@query("K10", "SELECT vec_id, round(ln(1 + exp(-0.1 * d)), 6) AS sigmoid, round(greatest(0, 1 - 0.1 * d), 6) AS hinge, round(pow(d - 5, 2), 6) AS ipo FROM (SELECT vec_id, list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE)) - list_sum(list_transform(embedding[33:64], lambda x: x::DOUBLE)) AS d FROM embeddings)")
def preference_losses(spark, sf):
    # the halves of a vector as log probabilities of the tokens of a chosen and of a rejected answer
    a, b = (F.aggregate(F.slice(F.col("embedding").cast("array<double>"), i, 32), F.lit(0.0), lambda t, x: t + x) for i in (1, 33))
    return table(spark, sf, "embeddings").select("vec_id", *[F.round(N.preference_loss(a, b, 0.1, k), 6).alias(k) for k in ("sigmoid", "hinge", "ipo")])


@query("K12", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 4")
def best_of_n(spark, sf):
    r = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf, "documents").withColumn("r", r).where("r <= 4").select("source", "doc_id")


@query("K13", "WITH g AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)) SELECT vec_id, (i % 8) // 4 AS cx, (i // 8) // 4 AS cy, round(avg(v), 6) AS mean, max(v) AS top FROM g GROUP BY ALL")
def spatial_pool(spark, sf):
    """Each vector as a grid of 8 x 8 values."""
    g = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    g = g.withColumns({"x": F.col("i") % 8, "y": F.floor(F.col("i") / 8)})
    return N.pool_grid(g, ["vec_id"], "x", "y", "v", 4).withColumn("mean", F.round("mean", 6))


@query("I33", """WITH t AS (SELECT vec_id, i, list_transform(embedding[i * 8 + 1:i * 8 + 8], lambda x: x::DOUBLE) AS x, (vec_id * 5 + i * 3) % 9 - 1 AS y FROM embeddings, range(8) r(i)),
l AS (SELECT vec_id, ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) - x[y + 1] AS loss FROM t WHERE y >= 0)
SELECT e.vec_id, round(avg(loss), 6) AS loss FROM embeddings e LEFT JOIN l ON e.vec_id = l.vec_id GROUP BY e.vec_id""")
def row_losses(spark, sf):
    """Each vector as logits of eight tokens over eight words; a ninth of the labels is masked."""
    positions = F.sequence(F.lit(0), F.lit(7))
    labels = F.transform(positions, lambda i: (F.pmod(F.col("vec_id") * 5 + i * 3, F.lit(9)) - 1).cast("int"))
    e = table(spark, sf, "embeddings").select("vec_id", V.tokens(V.doubles(F.col("embedding")), 8).alias("logits"), labels.alias("labels"))
    return N.row_losses(e, "logits", "labels").select("vec_id", F.round("loss", 6).alias("loss"))
