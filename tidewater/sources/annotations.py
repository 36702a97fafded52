"""Annotation formats of the data sets, each loaded as video samples with timed questions.

All loaders return video_id, video_path, duration (seconds, null if not given) and
conversations: an array in order of (question, choices, answer, start_time, end_time, task,
temporal_windows). Items of one file keep their order where times tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as X

from .files import read_json_array

QUESTION = "struct<question: string, choices: array<string>, answer: string, start_time: double, end_time: double, task: string, temporal_windows: array<array<double>>>"
SAMPLE = f"video_id string, video_path string, duration double, conversations array<{QUESTION}>"


def _question(question: Column, answer: Column, *, choices=None, start=None, end=None, task=None, windows=None) -> Column:
    none = F.lit(None)
    pick = lambda c: none if c is None else c
    return F.struct(
        question.cast("string").alias("question"), pick(choices).cast("array<string>").alias("choices"), answer.cast("string").alias("answer"), pick(start).cast("double").alias("start_time"),
        pick(end).cast("double").alias("end_time"), pick(task).cast("string").alias("task"), pick(windows).cast("array<array<double>>").alias("temporal_windows"),
    )


def _items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(file, pos, item fields) of files that each hold a JSON array, or one object."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(F.array(F.from_json("value", item)))
    return whole.select("file", F.posexplode(rows).alias("pos", "x")).select("file", "pos", "x.*")


def _by_video(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per video with its questions in order; a video's questions are one row, as in the files."""
    placed = F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "q")))
    return rows.groupBy(*keys).agg(placed.alias("placed")).withColumn("conversations", F.transform("placed", lambda x: x["q"])).drop("placed")


def _sample(df: DataFrame, video_id: Column, path: Column, duration: Column | None = None) -> DataFrame:
    return df.select(video_id.cast("string").alias("video_id"), path.alias("video_path"), (F.lit(None) if duration is None else duration).cast("double").alias("duration"), F.col("conversations").cast(f"array<{QUESTION}>"))


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold arrays of video samples already."""
    return read_json_array(spark, path, SAMPLE)


def load_streamed_choices(spark: SparkSession, path: str, folder: str, caps: dict[str, float] | None = None) -> DataFrame:
    """JSON lines of single questions with lettered options and the letter of the answer (streamingbench).

    Questions of a video are ordered by ``video_end``; ``caps`` bounds it for some videos.
    """
    item = "question string, options array<string>, answer string, video_end double, video string, task string"
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    rows = lines.select("at", F.from_json("value", item).alias("x")).select("at", "x.*").where("video IS NOT NULL")
    choices = X.strip_option_prefix(F.col("options"))
    end = F.col("video_end")
    for video, cap in (caps or {}).items():
        end = F.when(F.col("video") == video, F.least(end, F.lit(float(cap)))).otherwise(end)
    q = _question(F.col("question"), X.letter_to_text(choices, F.col("answer")), choices=choices, start=F.lit(0.0), end=end, task=F.col("task"))
    by = _by_video(rows.withColumn("q", q), ["video"], [F.col("video_end"), F.col("at")])
    name = F.when(F.col("video").contains("/"), F.substring_index("video", "/", 1)).otherwise(X.stem(F.col("video")))
    return _sample(by, name, F.concat(F.lit(f"{folder}/"), "video"))


def load_timed_tasks(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Items of several tasks (ovobench): choice questions with a time, and tasks whose ``test_info`` lists tests with times.

    Questions are ordered by time; each begins where the one before ended.
    """
    item = "struct<id: string, task: string, video: string, realtime: double, question: string, options: array<string>, gt: int, activity: string, test_info: array<struct<realtime: double, step: string, type: int, count: int>>>"
    rows = _items(spark, path, item)
    none = "struct<realtime: double, step: string, type: int, count: int>"
    tests = F.when(F.col("task").isin("SSR", "CRR", "REC"), F.col("test_info")).otherwise(F.array(F.lit(None).cast(none)))
    rows = rows.select("*", F.posexplode(tests).alias("n", "t"))
    subject = F.when(F.col("task") == "SSR", F.col("t.step")).when(F.col("task") == "REC", F.col("activity")).otherwise(F.col("question"))
    answer = X.task_answer(F.col("task"), F.col("t.type"), F.col("t.count"), F.col("options"), F.col("gt"))
    at = F.coalesce("t.realtime", "realtime")
    q = _question(X.task_question(F.col("task"), subject), answer, choices=F.when(F.col("t").isNull(), F.col("options")), end=at, task=F.col("task"))
    by = _by_video(rows.withColumns({"at": at, "q": q}), ["video"], [F.col("at"), F.col("file"), F.col("pos"), F.col("n")])
    before = lambda i: F.when(i > 0, F.get("conversations", i - 1)["end_time"]).otherwise(0.0)
    by = by.withColumn("conversations", F.transform("conversations", lambda x, i: x.withField("start_time", before(i))))
    return _sample(by, F.substring_index(F.substring_index("video", "/", -1), ".", 1), F.concat(F.lit(f"{folder}/"), "video"))


def load_grounded(spark: SparkSession, path: str, folder: str, broken: list[str] | None = None) -> DataFrame:
    """Items with question ``q``, options ``o``, the place ``p`` of the answer and target windows ``tgt`` (etbench); videos of ``broken`` are left out.

    A video has the first duration that is given and not 0.
    """
    item = "struct<video: string, duration: double, q: string, o: array<string>, p: string, tgt: array<array<double>>>"
    rows = _items(spark, path, item).withColumn("video", F.coalesce("video", F.lit("")))
    rows = rows.where(~F.col("video").isin(broken)) if broken else rows
    k = F.col("p").try_cast("int")
    answer = F.when((k >= 0) & (k < F.size("o")), F.get("o", k)).otherwise("")
    windows = F.when(F.size("tgt") > 0, F.col("tgt"))
    at = F.struct("file", "pos")
    q = _question(F.coalesce("q", F.lit("")), F.coalesce(answer, F.lit("")), choices=F.col("o"), windows=windows)
    known = F.min_by("duration", F.when(F.col("duration") != 0, at))
    lengths = rows.groupBy("video").agg(F.coalesce(known, F.lit(0.0)).alias("duration"))
    by = _by_video(rows.withColumn("q", q), ["video"], [F.col("file"), F.col("pos")]).join(lengths, "video")
    return _sample(by, F.when(F.col("video") == "", "").otherwise(X.stem(F.col("video"))), F.when(F.col("video") == "", "").otherwise(F.concat(F.lit(f"{folder}/"), "video")), F.col("duration"))


def load_named_choices(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Groups of named videos with one question each, choices under their letters (vidhalluc)."""
    item = "map<string, map<string, struct<Question: string, Choices: map<string, string>, `Correct Answer`: string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", item).alias("m"))
    rows = whole.select(F.explode(F.map_values("m")).alias("g")).select(F.explode("g").alias("video", "x"))
    choices = F.array(*[F.coalesce(F.try_element_at("x.Choices", F.lit(c)), F.lit("")) for c in "ABCD"])
    q = _question(F.col("x.Question"), F.try_element_at("x.Choices", F.col("x.Correct Answer")), choices=choices)
    return _sample(rows.withColumn("conversations", F.array(q)), F.col("video"), F.concat(F.lit(f"{folder}/"), "video", F.lit(".mp4")))


def load_judged_splits(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """A folder of ``<split>_questions.json`` files of samples with yes and no questions (eventhal); ``mix`` is the split interleave."""
    item = "struct<id: string, questions: array<struct<question: string, answer: string>>>"
    rows = _items(spark, f"{path}/*_questions.json", item)
    split = F.substring_index("file", "_", 1)
    split = F.when(split == "mix", "interleave").otherwise(split)
    sample = F.substring_index("id", "_", -1)
    asked = F.transform("questions", lambda x: _question(F.coalesce(x["question"], F.lit("")), F.replace(x["answer"], F.lit("."), F.lit(""))))
    return _sample(rows.withColumn("conversations", asked), sample, F.concat(F.lit(f"{folder}/"), split, F.lit("/"), split, F.lit("_"), sample, F.lit(".mp4")))


def load_open_answers(spark: SparkSession, path: str, folder: str, existing: DataFrame | None = None) -> DataFrame:
    """Parquet rows of a video with lists of questions and answers (egoplan): the answer is the only choice, the window is the whole video.

    With ``existing`` (video_path) other videos are left out.
    """
    rows = spark.read.schema("video_id string, questions array<string>, answers array<string>").parquet(path)
    n = F.least(F.size("questions"), F.size("answers"))
    whole = F.array(F.array(F.lit(0.0), F.lit(-1.0)))
    pair = lambda i: _question(F.get("questions", i), F.get("answers", i), choices=F.array(F.get("answers", i)), windows=whole)
    asked = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.array().cast(f"array<{QUESTION}>"))
    out = _sample(rows.withColumn("conversations", asked), F.col("video_id"), F.concat(F.lit(f"{folder}/"), "video_id", F.lit(".mp4")), F.lit(-1.0))
    return out.join(existing.select("video_path").distinct(), "video_path", "left_semi").select(*out.columns) if existing is not None else out


def questions_of(samples: DataFrame) -> DataFrame:
    """A row per question: video_id, video_path, duration, n (from 0) and its fields."""
    return samples.select("video_id", "video_path", "duration", F.posexplode("conversations").alias("n", "q")).select("video_id", "video_path", "duration", "n", "q.*")
