"""Annotations: documents as questions, written in each data set's format and loaded from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.sources import annotations as A
from tidewater.sources import files as S
from tidewater.sources.scratch import new_folder

from .registry import query
from .tables import table

_FIELDS = ["video_id", "video_path", "n", "question", "choices", "answer"]
_N = "(row_number() OVER (PARTITION BY video ORDER BY {}) - 1)::INTEGER AS n"


def _docs(spark, sf):
    """Documents as questions of videos, about 50 each."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    return d.withColumn("video", F.concat("lang", F.lit("_"), F.floor(F.col("doc_id") / 50).cast("string")))


_DOCS = "d AS (SELECT doc_id, source, lang, n_chars::BIGINT AS n_chars, lang || '_' || doc_id // 50 AS video FROM documents)"


@query("N A2 D1 D4 D23 I1", f"""WITH {_DOCS} SELECT video AS video_id, 'v/' || video || '/video.mp4' AS video_path, {_N.format('n_chars, doc_id')}, 'q' || doc_id AS question, [lang, source, 'x. y'] AS choices, CASE n_chars % 4 WHEN 0 THEN lang WHEN 1 THEN source WHEN 2 THEN 'x. y' ELSE '' END AS answer,
CASE WHEN video = 'en_0' THEN least(n_chars, 900) ELSE n_chars END::DOUBLE AS end_time FROM d""")
def annotations_streamed_choices(spark, sf):
    path, d = new_folder(spark, "streamed"), _docs(spark, sf)
    options = F.array(F.concat(F.lit("A. "), "lang"), F.concat(F.lit("B. "), "source"), F.lit("C. x. y"))
    rows = d.select("doc_id", F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), options.alias("options"), F.char(65 + F.col("n_chars") % 4).alias("answer"), F.col("n_chars").alias("video_end"), F.concat("video", F.lit("/video.mp4")).alias("video"))
    S.write_jsonl(rows.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").drop("doc_id"), path)
    return A.questions_of(A.load_streamed_choices(spark, path, "v", {"en_0/video.mp4": 900})).select(*_FIELDS, "end_time")


@query("N A1 D15 J2", f"""WITH {_DOCS}, t AS (SELECT *, ['SSR', 'CRR', 'REC', 'EPM'][doc_id % 4 + 1] AS task FROM d),
u AS (SELECT *, unnest(CASE WHEN task = 'EPM' THEN [0] ELSE [0, 1] END) AS k FROM t), r AS (SELECT *, n_chars + k * 7 AS rt FROM u)
SELECT video AS video_id, 'data/ovo/' || video || '.mp4' AS video_path, (row_number() OVER w - 1)::INTEGER AS n, task, rt::DOUBLE AS end_time, coalesce(lag(rt) OVER w, 0)::DOUBLE AS start_time,
CASE WHEN task = 'EPM' THEN [lang, source] END AS choices, CASE task WHEN 'EPM' THEN CASE n_chars % 2 WHEN 0 THEN lang ELSE source END WHEN 'REC' THEN ((n_chars + k) % 9)::VARCHAR ELSE CASE WHEN (n_chars + k) % 2 = 1 THEN 'Yes' ELSE 'No' END END AS answer
FROM r WINDOW w AS (PARTITION BY video ORDER BY rt, doc_id, k)""")
def annotations_timed_tasks(spark, sf):
    path, d = new_folder(spark, "timed"), _docs(spark, sf)
    task = F.get(F.array(*[F.lit(t) for t in ("SSR", "CRR", "REC", "EPM")]), (F.col("doc_id") % 4).cast("int"))
    tests = F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.struct((F.col("n_chars") + k * 7).alias("realtime"), F.col("source").alias("step"), ((F.col("n_chars") + k) % 2).alias("type"), ((F.col("n_chars") + k) % 9).alias("count")))
    own = F.struct(
        F.col("doc_id").alias("id"), task.alias("task"), F.concat("video", F.lit(".mp4")).alias("video"), F.when(task == "EPM", F.col("n_chars")).alias("realtime"), F.col("source").alias("question"), F.when(task == "EPM", F.array("lang", "source")).alias("options"),
        (F.col("n_chars") % 2).alias("gt"), F.col("source").alias("activity"), F.when(task != "EPM", tests).alias("test_info"),
    )
    # a file per language, its items in order
    items = d.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.to_json(own).alias("x")))).alias("xs"))
    value = F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["x"]), ","), F.lit("]"))
    S.write_named(items.select(F.concat("lang", F.lit(".json")).alias("name"), value.alias("value")), path, "name", "value").agg(F.sum("size")).collect()
    return A.questions_of(A.load_timed_tasks(spark, path, "data/ovo")).select("video_id", "video_path", "n", "task", "end_time", "start_time", "choices", "answer")


@query("N A1 I3", f"""WITH {_DOCS}, f AS (SELECT video, arg_min(n_chars % 5, doc_id) FILTER (n_chars % 5 <> 0) AS duration FROM d WHERE video <> 'de_1' GROUP BY video)
SELECT video AS video_id, 'videos/x/' || video || '.mp4' AS video_path, coalesce(duration, 0)::DOUBLE AS duration, {_N.format('doc_id')}, source AS question, [lang, source] AS choices, CASE n_chars % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE '' END AS answer,
CASE WHEN n_chars % 2 = 0 THEN [[n_chars::DOUBLE, n_chars + 1.5::DOUBLE]] END AS temporal_windows FROM d JOIN f USING (video)""")
def annotations_grounded(spark, sf):
    path, d = new_folder(spark, "grounded"), _docs(spark, sf)
    windows = F.when(F.col("n_chars") % 2 == 0, F.array(F.array(F.col("n_chars").cast("double"), F.col("n_chars") + 1.5))).otherwise(F.array().cast("array<array<double>>"))
    own = F.struct(F.concat(F.lit("x/"), "video", F.lit(".mp4")).alias("video"), (F.col("n_chars") % 5).alias("duration"), F.col("source").alias("q"), F.array("lang", "source").alias("o"), (F.col("n_chars") % 3).alias("p"), windows.alias("tgt"))
    items = d.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.to_json(own).alias("x")))).alias("xs"))
    value = F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["x"]), ","), F.lit("]"))
    S.write_named(items.select(F.concat("lang", F.lit(".json")).alias("name"), value.alias("value")), path, "name", "value").agg(F.sum("size")).collect()
    return A.questions_of(A.load_grounded(spark, path, "videos", ["x/de_1.mp4"])).select(*_FIELDS, "duration", "temporal_windows")


@query("N A10", f"""WITH {_DOCS} SELECT 'v' || doc_id AS video_id, 'ach/v' || doc_id || '.mp4' AS video_path, 0 AS n, source AS question, [lang, source, '', 'last'] AS choices, CASE n_chars % 2 WHEN 0 THEN lang ELSE 'last' END AS answer FROM d""")
def annotations_named_choices(spark, sf):
    path, d = new_folder(spark, "named"), _docs(spark, sf)
    choices = F.create_map(F.lit("A"), "lang", F.lit("B"), "source", F.lit("D"), F.lit("last"))
    own = F.struct(F.col("source").alias("Question"), choices.alias("Choices"), F.when(F.col("n_chars") % 2 == 0, "A").otherwise("D").alias("Correct Answer"))
    groups = d.groupBy("video").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("v"), F.col("doc_id").cast("string")), own))).alias("g"))
    files = groups.select(F.concat("video", F.lit(".json")).alias("name"), F.to_json(F.create_map("video", "g")).alias("value"))
    S.write_named(files, path, "name", "value").agg(F.sum("size")).collect()
    return A.questions_of(A.load_named_choices(spark, path, "ach")).select(*_FIELDS)


@query("N A11 D28", f"""WITH {_DOCS}, s AS (SELECT *, CASE WHEN lang = 'de' THEN 'interleave' ELSE lang END AS split FROM d)
SELECT doc_id::VARCHAR AS video_id, 'hal/' || split || '/' || split || '_' || doc_id || '.mp4' AS video_path, n::INTEGER AS n, source || n AS question, CASE (n_chars + n) % 2 WHEN 0 THEN 'Yes' ELSE 'No it is not' END AS answer FROM s, (VALUES (0), (1)) t(n)""")
def annotations_judged_splits(spark, sf):
    path, d = new_folder(spark, "judged"), _docs(spark, sf)
    asked = F.transform(F.array(F.lit(0), F.lit(1)), lambda n: F.struct(F.concat("source", n.cast("string")).alias("question"), F.when((F.col("n_chars") + n) % 2 == 0, "Yes.").otherwise("No it is not.").alias("answer")))
    own = F.to_json(F.struct(F.concat("lang", F.lit("_"), F.col("doc_id").cast("string")).alias("id"), asked.alias("questions")))
    name = F.concat(F.when(F.col("lang") == "de", "mix").otherwise(F.col("lang")), F.lit("_questions.json"))
    files = d.groupBy(name.alias("name")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(own), ","), F.lit("]")).alias("value"))
    S.write_named(files, path, "name", "value").agg(F.sum("size")).collect()
    return A.questions_of(A.load_judged_splits(spark, path, "hal")).select("video_id", "video_path", "n", "question", "answer")


@query("N A9 A21", f"""WITH {_DOCS} SELECT video AS video_id, 'ego/' || video || '.mp4' AS video_path, -1::DOUBLE AS duration, {_N.format('doc_id')}, 'q' || doc_id AS question, source AS answer FROM d WHERE video NOT LIKE 'fr_%'""")
def annotations_open_answers(spark, sf):
    path, d = new_folder(spark, "open"), _docs(spark, sf)
    by = d.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("doc_id", "source"))).alias("xs"))
    rows = by.select(F.col("video").alias("video_id"), F.transform("xs", lambda x: F.concat(F.lit("q"), x["doc_id"].cast("string"))).alias("questions"), F.transform("xs", lambda x: x["source"]).alias("answers"))
    rows.write.parquet(path)
    existing = d.where(~F.col("video").startswith("fr_")).select(F.concat(F.lit("ego/"), "video", F.lit(".mp4")).alias("video_path"))
    return A.questions_of(A.load_open_answers(spark, path, "ego", existing)).select("video_id", "video_path", "duration", "n", "question", "answer")


@query("N A1", f"""WITH {_DOCS} SELECT video AS video_id, 'x/' || video AS video_path, 9.5::DOUBLE AS duration, {_N.format('doc_id')}, source AS question, [lang, source] AS choices, lang AS answer, n_chars::DOUBLE AS end_time FROM d""")
def annotations_samples(spark, sf):
    path, d = new_folder(spark, "samples"), _docs(spark, sf)
    q = F.struct(F.col("source").alias("question"), F.array("lang", "source").alias("choices"), F.col("lang").alias("answer"), F.col("n_chars").cast("double").alias("end_time"))
    by = d.groupBy("video").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", q.alias("q")))), lambda x: x["q"]).alias("conversations"))
    S.write_json_arrays(by.select(F.col("video").alias("video_id"), F.concat(F.lit("x/"), "video").alias("video_path"), F.lit(9.5).alias("duration"), "conversations"), path, 3)
    return A.questions_of(A.load_samples(spark, path)).select(*_FIELDS, "duration", "end_time")


