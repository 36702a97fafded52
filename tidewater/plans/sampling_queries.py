"""Samplers, permutations, batches and splits that keep, move or draw rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import timeline as T
from tidewater.functions import vectors as V
from tidewater.operators import sequences as S

from .registry import query
from .sequence_queries import WITH, positions
from .tables import FRAMES, frames, table, turns


def _hash(seed: int, *cols: str) -> str:
    """``seeded_order`` in SQL."""
    out = str(seed)
    for c in cols:
        out = f"(({out} * 31 + {c} * 2654435761) % 4294967296)"
    return out


_RANK = "r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents)"


@query("C3", f"WITH {_RANK} SELECT doc_id, rank % 2 AS node, rank // 2 % 4 AS worker, rank // 8 AS place FROM r")
def two_level_split(spark, sf):
    r = S.with_rank(table(spark, sf, "documents").select("doc_id"), "doc_id")
    inner = F.floor(F.col("rank") / 2)
    return r.select("doc_id", F.pmod("rank", F.lit(2)).alias("node"), F.pmod(inner, F.lit(4)).alias("worker"), F.floor(inner / 4).alias("place"))


@query("C4", f"WITH {_RANK} SELECT doc_id, rank % 8 AS part, CASE WHEN rank % 8 = 7 THEN rank // 8 % 8 END AS sub_part, rank FROM r")
def nested_round_robin(spark, sf):
    r = S.with_rank(table(spark, sf, "documents").select("doc_id"), "doc_id")
    cut = r.select("doc_id", F.pmod("rank", F.lit(8)).alias("part"), F.floor(F.col("rank") / 8).alias("place"))
    # the last part was split once more; its places come back first, then the ranks
    last = F.col("part") == 7
    cut = cut.withColumns({"sub_part": F.when(last, F.pmod("place", F.lit(8))), "sub_place": F.when(last, F.floor(F.col("place") / 8))}).withColumn("place", F.when(~last, F.col("place")))
    place = F.coalesce("place", F.col("sub_part") + 8 * F.col("sub_place"))
    return cut.select("doc_id", "part", "sub_part", (F.col("part") + 8 * place).alias("rank"))


@query("C8", f"""WITH s AS (SELECT doc_id, n_chars // 500 AS stride, row_number() OVER (PARTITION BY n_chars // 500 ORDER BY {_hash(3, 'doc_id')}, doc_id) - 1 AS n FROM documents),
b AS (SELECT stride, n // 8 AS batch, count(*) AS c FROM s GROUP BY ALL), f AS (SELECT * FROM b WHERE c = 8 OR stride < (SELECT max(stride) FROM b))
SELECT f.stride, f.batch, j::INTEGER AS slot, s.doc_id FROM f, range(8) t(j) JOIN s ON s.stride = f.stride AND s.n = f.batch * 8 + j % f.c""")
def strict_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("n_chars") / 500).alias("stride"))
    return S.strict_batches(d, "stride", "doc_id", S.seeded_order(3, "doc_id"), 8)


@query("F8", WITH + f", u AS (SELECT *, ({_hash(7, 'user_id', 'event_id')} + 1) / 4294967297.0::DOUBLE AS u FROM p), s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY i = 0 DESC, ln(u) / exp(3.0::DOUBLE * i / greatest(n - 1, 1)) DESC, event_id) AS r FROM u) SELECT user_id, event_id FROM s WHERE r <= 10")
def recency_weighted(spark, sf):
    p = positions(spark, sf)
    u = (S.seeded_order(7, "user_id", "event_id") + 1) / 4294967297.0
    weight = F.exp(3.0 * F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)))
    kept = p.where("i = 0")  # always kept; the others fill up to ten by weight
    drawn = S.weighted_sample(p.where("i > 0"), ["user_id"], weight, u, 9, "event_id")
    return kept.unionByName(drawn).select("user_id", "event_id")


@query("F9", WITH + ", k AS (SELECT *, i = 0 OR i = n - 1 AS keep FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, keep ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY user_id, keep) AS m FROM k) SELECT user_id, event_id FROM r WHERE keep OR m <= 6 OR list_contains(list_transform(range(6), lambda j: floor(j * ((m - 1)::DOUBLE / 5))::BIGINT), r)")
def cap_guard(spark, sf):
    ends = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    return S.capped(positions(spark, sf), ["user_id"], "i", ends, 8).select("user_id", "event_id")


@query("F11", WITH + f""", h AS (SELECT *, round_even(n * 0.5::DOUBLE, 0) AS k, row_number() OVER (PARTITION BY user_id ORDER BY {_hash(7, 'user_id', 'event_id')}, event_id) AS r FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS a, row_number() OVER (PARTITION BY user_id ORDER BY {_hash(11, 'user_id', 'event_id')}, event_id) AS b0 FROM h WHERE k >= 2 AND r <= k),
q AS (SELECT *, CASE WHEN bool_and(a = b0) OVER (PARTITION BY user_id) THEN (a + k::BIGINT - 2) % k::BIGINT + 1 ELSE b0 END AS b FROM o)
SELECT x.user_id, x.event_id, y.i AS new_place FROM q x JOIN q y ON x.user_id = y.user_id AND x.b = y.a UNION ALL SELECT user_id, event_id, i FROM h WHERE NOT (k >= 2 AND r <= k)""")
def partial_permutation(spark, sf):
    first, second = S.seeded_order(7, "user_id", "event_id"), S.seeded_order(11, "user_id", "event_id")
    return S.partial_permutation(positions(spark, sf), "user_id", "i", "n", 0.5, first, second, "event_id").select("user_id", "event_id", "new_place")


@query("F11", WITH + f""", c AS (SELECT *, i // ceil(n / least(4, n)::DOUBLE)::BIGINT AS clip FROM p), g AS (SELECT user_id, clip, count(*) AS m, min(i) AS lo FROM c GROUP BY ALL),
o AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY user_id ORDER BY {_hash(5, 'user_id', 'clip')}, clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM g) SELECT c.user_id, event_id, (base + i - lo)::BIGINT AS new_place FROM c JOIN o ON c.user_id = o.user_id AND c.clip = o.clip""")
def clip_permutation(spark, sf):
    noise = lambda key, clip: S.seeded_order(5, "user_id", "__clip")
    return S.clip_permutation(positions(spark, sf), "user_id", "i", "n", 4, noise).select("user_id", "event_id", "new_place")


@query("F15", f"SELECT doc_id FROM documents ORDER BY {_hash(42, 'doc_id')}, doc_id LIMIT 50")
def seeded_sample(spark, sf):
    return table(spark, sf, "documents").orderBy(S.seeded_order(42, "doc_id"), "doc_id").limit(50).select("doc_id")  # a sampler of 50 rows


@query("F16", WITH + "SELECT event_id FROM p WHERE i % 50 < 10 AND i // 50 * 50 + 10 <= n")
def interval_windows(spark, sf):
    whole = F.floor(F.col("i") / 50) * 50 + 10 <= F.col("n")
    return positions(spark, sf).where((F.pmod("i", F.lit(50)) < 10) & whole).select("event_id")


@query("F17", WITH + f", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_hash(9, 'user_id', 'event_id')}, event_id) AS r FROM p) SELECT event_id, CASE WHEN r <= floor(n * 0.25) THEN 0 ELSE 1 END::INTEGER AS fixed, CASE WHEN r <= floor(n * (0.25 + 0.5 * ({_hash(9, 'user_id')} / 4294967296.0::DOUBLE))) THEN 0 ELSE 1 END::INTEGER AS ranged, CASE WHEN i = 0 THEN 0 ELSE 1 END::INTEGER AS first_only FROM r")
def token_masks(spark, sf):
    r = F.row_number().over(W.partitionBy("user_id").orderBy(S.seeded_order(9, "user_id", "event_id"), "event_id"))
    share = 0.25 + 0.5 * (S.seeded_order(9, "user_id") / 4294967296.0)
    mask = lambda kept: F.when(kept, 0).otherwise(1)
    marked = positions(spark, sf).withColumn("r", r)
    return marked.select("event_id", mask(F.col("r") <= F.floor(F.col("n") * 0.25)).alias("fixed"), mask(F.col("r") <= F.floor(F.col("n") * share)).alias("ranged"), mask(F.col("i") == 0).alias("first_only"))


@query("F19", f"""WITH {FRAMES}, h AS (SELECT user_id, t / 3600 AS h FROM f), e AS (SELECT user_id, min(h) AS a, max(h) AS b, count(*) AS n FROM h GROUP BY user_id),
w AS (SELECT *, least(greatest(a, 100.0::DOUBLE), b) AS lo, greatest(least(greatest(a, 100.0::DOUBLE), b) + 1, least(greatest(a, 300.5::DOUBLE), b)) AS hi, n / greatest(b - a, 1e-6) AS rate FROM e),
c AS (SELECT w.user_id, rate, count(*) AS total FROM w JOIN h ON h.user_id = w.user_id AND h BETWEEN lo AND hi GROUP BY ALL),
s AS (SELECT user_id, total, CASE WHEN rate < 0.1 THEN floor(total * 0.1 / rate) ELSE greatest(total, 2) END AS seen, greatest(rate, 0.1::DOUBLE) AS r FROM c),
k AS (SELECT *, greatest((floor(least(greatest(seen / r * 0.1::DOUBLE, 4.0), 64.0, seen) / 2) * 2)::INTEGER, 2) AS k FROM s)
SELECT user_id, k, array_to_string(list_transform(range(k), lambda j: round_even(j * ((total - 1)::DOUBLE / (k - 1)), 0)::INTEGER), ',') AS places FROM k""")
def bounded_windows(spark, sf):
    h = frames(spark, sf).select("user_id", (F.col("t") / 3600).alias("h"))
    ends = h.groupBy("user_id").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n"))
    clamp = lambda x: F.least(F.greatest(F.col("a"), F.lit(x)), F.col("b"))
    w = ends.select("user_id", clamp(100.0).alias("lo"), F.greatest(clamp(100.0) + 1, clamp(300.5)).alias("hi"), (F.col("n") / F.greatest(F.col("b") - F.col("a"), F.lit(1e-6))).alias("rate"))
    c = h.join(w, "user_id").where("h between lo and hi").groupBy("user_id", "rate").agg(F.count("*").alias("total"))
    low = F.col("rate") < 0.1
    seen = F.when(low, F.floor(F.col("total") * 0.1 / F.col("rate"))).otherwise(F.greatest("total", F.lit(2)))
    k = F.greatest(T.smart_count(seen, F.greatest(F.col("rate"), F.lit(0.1)), 0.1, 4, 64), F.lit(2))
    return c.withColumn("k", k).select("user_id", "k", F.array_join(T.linear_positions(F.col("total"), F.col("k")), ",").alias("places"))


@query("F5", f"""WITH {FRAMES}, e AS (SELECT user_id, list(t / 3600 ORDER BY t, event_id) AS pts FROM f GROUP BY user_id),
x AS (SELECT user_id, pts, floor((pts[-1] - pts[1] + 1e-6) / 30)::BIGINT + 1 AS m FROM e),
y AS (SELECT user_id, pts, list_transform(CASE WHEN m <= 16 THEN range(m) ELSE list_transform(range(16), lambda j: round_even(j * ((m - 1)::DOUBLE / 15), 0)::BIGINT) END, lambda j: pts[1] + j * 30.0::DOUBLE) AS ticks FROM x),
z AS (SELECT user_id, list_transform(ticks, lambda k: len(list_filter(pts, lambda p: p < k)) % len(pts)) AS idx FROM y)
SELECT user_id, array_to_string(CASE WHEN len(idx) % 2 = 1 THEN list_append(idx, idx[-1]) ELSE idx END, ',') AS places FROM z""")
def strict_fps(spark, sf):
    p = positions(spark, sf).withColumn("h", F.col("t") / 3600)
    span = p.groupBy("user_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    m = F.floor((F.col("b") - F.col("a") + 1e-6) / 30) + 1
    ticks = span.withColumn("m", m).select("user_id", "a", F.posexplode(T.uniform_positions(F.col("m"), 16, rounded=True)).alias("k", "j"))
    ticks = ticks.select("user_id", "k", (F.col("a") + F.col("j") * 30.0).alias("tick"))
    # the first frame at or after a tick has as many frames before it as the tick
    both = ticks.select("user_id", "k", F.col("tick").alias("x"), F.lit(0).alias("one")).unionByName(p.select("user_id", F.lit(None).cast("int").alias("k"), F.col("h").alias("x"), F.lit(1).alias("one")))
    before = F.sum("one").over(W.partitionBy("user_id").orderBy("x", "one").rowsBetween(W.unboundedPreceding, W.currentRow))
    n = F.sum("one").over(W.partitionBy("user_id"))
    found = both.withColumns({"i": before, "n": n}).where("k is not null").withColumn("i", F.pmod("i", "n"))  # a tick after the last frame takes the first
    places = F.transform(F.sort_array(F.collect_list(F.struct("k", "i"))), lambda r: r["i"])
    from tidewater.functions.text import pad_last

    return found.groupBy("user_id").agg(places.alias("p")).select("user_id", F.array_join(pad_last(F.col("p"), 2), ",").alias("places"))


@query("E9", f"""WITH q AS (SELECT conv_id, turn, turn * 2.5 AS a, turn * 2.5 + length(text) % 4 - 1 AS b FROM conversations WHERE role = 'user'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {_hash(2025, 'conv_id', 'turn')}, turn) AS r FROM q),
v AS (SELECT * FROM o WHERE r = 1 AND b > a ORDER BY {_hash(2025, 'conv_id')}, conv_id LIMIT 100) SELECT conv_id, turn FROM v""")
def selected_questions(spark, sf):
    start = F.col("realtime")
    q = turns(spark, sf).withColumns({"a": start, "b": start + F.length("text") % 4 - 1})
    one = F.row_number().over(W.partitionBy("conv_id").orderBy(S.seeded_order(2025, "conv_id", "turn"), "turn"))
    picked = q.withColumn("r", one).where("r = 1 and b > a")
    return picked.orderBy(S.seeded_order(2025, "conv_id"), "conv_id").limit(100).select("conv_id", "turn")  # the driver takes 100 videos


_COS = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))"


@query("E14", f"""WITH RECURSIVE o AS (SELECT label, vec_id, embedding AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
k AS (SELECT label, vec_id, n, e AS last, true AS keep FROM o WHERE n = 1 UNION ALL
SELECT o.label, o.vec_id, o.n, CASE WHEN {_COS.format(a='o.e', b='k.last')} < 0.1 * {_NORM.format(a='o.e')} * {_NORM.format(a='k.last')} THEN o.e ELSE k.last END, {_COS.format(a='o.e', b='k.last')} < 0.1 * {_NORM.format(a='o.e')} * {_NORM.format(a='k.last')} FROM k JOIN o ON o.label = k.label AND o.n = k.n + 1)
SELECT label, vec_id FROM k WHERE keep""")
def similarity_policy(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", V.doubles(F.col("embedding")).alias("embedding"))
    return S.dissimilar(e, "label", "vec_id", "embedding", 0.1).select("label", "vec_id")


@query("E15", "SELECT source, arg_max(path, doc_id) AS latest FROM (SELECT source, doc_id, source || '/run.1/checkpoint-' || doc_id AS path FROM documents WHERE doc_id % 4 <> 0) GROUP BY source")
def latest_checkpoint(spark, sf):
    path = F.concat("source", F.when(F.col("doc_id") % 4 == 0, "/run.1/checkpoint-last").otherwise(F.concat(F.lit("/run.1/checkpoint-"), F.col("doc_id").cast("string"))))
    step = F.regexp_extract("path", r"checkpoint-(\d{1,18})$", 1).try_cast("long")  # other names have no number
    paths = table(spark, sf, "documents").select("source", path.alias("path")).withColumn("step", step)
    return paths.where("step is not null").groupBy("source").agg(F.max_by("path", "step").alias("latest"))
