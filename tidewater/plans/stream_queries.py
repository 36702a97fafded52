"""Batch twins of the stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.streaming import state as St

from .registry import query
from .tables import table


@query("L3 L2 L5 L6", "WITH p AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS block FROM events) SELECT user_id, block, count(*) AS n, round(sum(value), 4) AS total FROM p GROUP BY ALL HAVING count(*) = 8")
def full_blocks(spark, sf):
    return St.blocks_batch(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 8)


@query("L2 J21", "WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, CASE WHEN i <= 4 THEN 'init' WHEN i > n - 10 THEN 'local' ELSE 'global' END AS segment FROM p")
def stream_segments(spark, sf):
    return St.segments(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 4, 10).select("event_id", "segment")


@query("L20 L4", "WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id FROM p WHERE i <= 4 OR i > n - 10")
def sink_and_window(spark, sf):
    return St.sink_and_window(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 4, 10).select("event_id")


@query("L10 L7", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    return St.tumbling(table(spark, sf, "events"), "6 hours", "event_type").withColumn("total", F.round("total", 4))


@query("L11", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - h * INTERVAL 1 HOUR AS start, count(*) AS n FROM events, range(3) t(h) GROUP BY ALL")
def sliding_windows(spark, sf):
    return St.sliding(table(spark, sf, "events"), "3 hours", "1 hour")


@query("L12", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 5 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf):
    return St.sessions(table(spark, sf, "events"), "5 hours", "user_id")


@query("L8", "SELECT event_id, value / 1000.0 <= 0.02 + 0.001 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS suppressed FROM events")
def stepwise_gate(spark, sf):
    from pyspark.sql import Window as W

    # thousandths are added as whole numbers and divided once: sums of 0.001 in doubles miss values that equal the threshold
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf, "events").select("event_id", (F.col("value") / 1000.0 <= (20 + n) / 1000.0).alias("suppressed"))


@query("L17 E3", "SELECT doc_id, (length(text) * 7919 % 1000) / 1000.0::DOUBLE AS score FROM documents")
def model_seam(spark, sf):
    from .seams import apply_model

    def model(frame):
        frame["score"] = frame["text"].str.len() * 7919 % 1000 / 1000.0
        return frame[["doc_id", "score"]]

    return apply_model(table(spark, sf, "documents").select("doc_id", "text"), model, "doc_id long, score double")


_LIVE = """r AS (SELECT user_id, epoch_us(ts) AS us, event_id AS ident, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS what FROM events),
s AS (SELECT *, coalesce(sum((what = 2)::INT) OVER (PARTITION BY user_id ORDER BY us, ident ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS session FROM r),
c AS (SELECT *, count(*) FILTER (what = 0) OVER (PARTITION BY user_id, session ORDER BY us, ident) AS seen FROM s),
f AS (SELECT user_id, session, us, min(ident) AS ident FROM s WHERE what = 0 GROUP BY ALL),
o AS (SELECT user_id, session, min(us) AS origin, max(us) AS last FROM f GROUP BY ALL),
t AS (SELECT user_id, session, origin, unnest(range(0, (last - origin) // 14400000000 + 1)) AS tick FROM o),
p AS (SELECT t.*, f.ident, CASE WHEN tick < 6 THEN 0 ELSE 1 + (tick - 6) // 2 END AS n FROM t ASOF JOIN f ON t.user_id = f.user_id AND t.session = f.session AND t.origin + t.tick * 14400000000 <= f.us),
g AS (SELECT user_id, session, n, min(tick) AS a, max(tick) AS b, arg_min(ident, tick) AS first_frame, arg_max(ident, tick) AS last_frame FROM p GROUP BY ALL)"""


def live_rows(events):
    """Events as rows of a live stream: errors end a session, purchases ask, all others are frames."""
    what = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 2).otherwise(0)
    return events.withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "ident": F.col("event_id"), "what": what})


@query("L7 L9 L5", f"""WITH {_LIVE}
SELECT user_id, session, 'turn' AS kind, n::BIGINT AS n, a * 14400.0::DOUBLE AS start, (b + 1) * 14400.0::DOUBLE AS stop, first_frame, last_frame, b - a + 1 AS n_frames FROM g
UNION ALL SELECT user_id, session, 'answer', ident, NULL, NULL, NULL, NULL, seen - lag(seen, 1, 0) OVER (PARTITION BY user_id, session ORDER BY us, ident) FROM c WHERE what = 1
UNION ALL SELECT x.user_id, x.session, 'end', coalesce(k, 0), NULL, NULL, NULL, NULL, frames FROM (SELECT user_id, session, count(*) FILTER (what = 0) AS frames FROM s GROUP BY ALL) x LEFT JOIN (SELECT user_id, session, count(*) AS k FROM g GROUP BY ALL) y ON x.user_id = y.user_id AND x.session = y.session""")
def live_turns(spark, sf):
    from tidewater.streaming.realtime import turns_batch

    return turns_batch(live_rows(table(spark, sf, "events")), "user_id", step=14_400_000_000, initial=6, steady=2)
