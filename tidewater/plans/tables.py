"""The tables that queries read, in the roles they play, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer rows: documents with a label; quality is the truth, toxic the prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("qid"),
        F.col("source").alias("task"),
        F.col("lang").alias("family"),
        F.col("toxic").cast("long").alias("pred"),
        F.col("quality").cast("long").alias("gold"),
        (F.col("toxic") == F.col("quality")).cast("long").alias("correct"),
        (F.pmod("doc_id", F.lit(3)) * 32 + 32).alias("retrieve_size"),
        (F.pmod("doc_id", F.lit(2)) + 1).alias("chunk_size"),
        "n_chars",
    )


RESULTS = """r AS (SELECT d.doc_id AS qid, d.source AS task, d.lang AS family, l.toxic::BIGINT AS pred, l.quality::BIGINT AS gold,
  CASE WHEN l.toxic = l.quality THEN 1 ELSE 0 END::BIGINT AS correct, d.doc_id % 3 * 32 + 32 AS retrieve_size, d.doc_id % 2 + 1 AS chunk_size, d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a user's frames; ``t`` is seconds from the user's first event."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.withColumn("t", (F.col("us") - F.min("us").over(W.partitionBy("user_id"))) / 1e6)


FRAMES = """f AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as timed questions: realtime is 2.5 seconds per turn."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", "text", (F.col("turn") * 2.5).cast("double").alias("realtime"))


TURNS = "q AS (SELECT conv_id, turn, text, (turn * 2.5)::DOUBLE AS realtime FROM conversations WHERE role = 'user')"
