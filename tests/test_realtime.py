"""Real-time turns on a stream against their batch twin."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewater.plans.stream_queries import live_rows
from tidewater.streaming.realtime import turns_batch, turns_stream

SETTING = {"step": 14_400_000_000, "initial": 6, "steady": 2}


def run(spark, rows, files, path, delay, expire):
    """The stream over ``files`` (lists of rows), one micro-batch each, then rows far ahead that let the watermark pass."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    late = rows.agg(F.max("ts")).first()[0]
    for days in (4000, 9000, 20000):
        files.append([(-1, late.replace(year=late.year + days // 365), 0, 0, 0)])
    for n, own in enumerate(files):
        frame = spark.createDataFrame(own, "user_id long, ts timestamp, us long, ident long, what int").coalesce(1)
        frame.write.parquet(f"{path}/in/{n:04d}")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    out = turns_stream(stream, "user_id", at="ts", delay=delay, expire=expire, **SETTING)
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted(map(tuple, spark.read.parquet(f"{path}/out").where("user_id >= 0").collect()), key=repr)


def test_stream_equals_batch_on_shuffled_micro_batches(spark, sf, tmp_path):
    rows = live_rows(spark.read.parquet(f"{sf}/events.parquet")).where("user_id < 6").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts", "us", "ident", "what")
    every = sorted(map(tuple, rows.collect()), key=lambda r: (r[1], r[3]))
    rng, size = random.Random(3), max(1, len(every) // 4)
    placed = sorted((i + rng.random() * size / 2, r) for i, r in enumerate(every))  # out of order by up to half a file
    files = [[r for _, r in placed[a : a + size]] for a in range(0, len(placed), size)]
    want = sorted(map(tuple, turns_batch(rows, "user_id", **SETTING).collect()), key=repr)
    assert {r[2] for r in want} == {"turn", "answer", "end"} and len({r[:2] for r in want}) > 6
    assert run(spark, rows, files, str(tmp_path), "20 days", 3000 * 86_400_000_000) == want


def test_batch_of_awkward_rows(spark):
    h = 3_600_000_000
    rows = [(None, 0, 1, 0), (None, 9 * h, 2, 0), (1, 5, 1, 2), (1, 7, 2, 1), (2, None, 1, 0), (3, 4, 2, 0), (3, 4, 1, 0), (3, 4 + 40 * h, 3, 1)]
    got = sorted(map(tuple, turns_batch(spark.createDataFrame(rows, "user_id long, us long, ident long, what int"), "user_id", **SETTING).collect()), key=repr)
    assert got == sorted(
        [
            (None, 0, "turn", 0, 0.0, 43200.0, 1, 2, 3), (None, 0, "end", 1, None, None, None, None, 2),
            (1, 0, "end", 0, None, None, None, None, 0), (1, 1, "answer", 2, None, None, None, None, 0), (1, 1, "end", 0, None, None, None, None, 0),
            (3, 0, "turn", 0, 0.0, 14400.0, 1, 1, 1), (3, 0, "answer", 3, None, None, None, None, 2), (3, 0, "end", 1, None, None, None, None, 2),
        ], key=repr,
    )
