"""The benchmark drivers: load annotations, cut them in chunks, answer, merge, evaluate.

A driver is a data set's questions, read from annotation files of its format, a solver and an evaluator. Chunks of videos are
answered by the solver's seam and come back as one table of answer rows with the
run's name and parameters, which is what merged shard files hold. Layered drivers
pass the layers that keep short memory to the solver and name them in the run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.functions import timeline as T
from tidewater.operators import metrics as M
from tidewater.operators import sequences as S
from tidewater.operators.matching import consuming_match
from tidewater.sources import annotations as A
from tidewater.sources.files import write_json_arrays, write_jsonl, write_named
from tidewater.sources.scratch import new_folder

from .registry import query
from .tables import table

CHUNKS, LAYERS = 8, (0, 1, 26, 27)
#: (retrieve_size, chunk_size) of the runs whose rows a result table holds.
PARAMETERS = [(32, 1), (64, 1)]
#: Tasks and the families that report them; other tasks are forward tasks.
REAL_TIME, BACKWARD, FORWARD = ["OCR", "ACR", "ATR", "STU", "FPD", "OJR"], ["EPM", "ASI", "HLD"], ["REC", "SSR", "CRR"]
TASKS = [*REAL_TIME, *BACKWARD, *FORWARD]


@dataclass(frozen=True)
class Driver:
    name: str
    layers: tuple[int, ...] = ()

    @property
    def run(self) -> str:
        """The folder of the results."""
        return f"{self.name}/layered_{'_'.join(map(str, self.layers))}_64-1.0" if self.layers else f"{self.name}/64-1.0"

    @property
    def shift(self) -> int:
        return sum(self.layers)


def answered(questions: DataFrame, driver: Driver, solver: Callable[[DataFrame, Driver], DataFrame]) -> DataFrame:
    """Answer rows of all chunks: questions (qid, …) in contiguous chunks, solved, with run, retrieve_size and chunk_size."""
    chunks = S.contiguous_parts(questions, "qid", CHUNKS).withColumnRenamed("part", "chunk").drop("rank", "total")
    parameters = F.array(*[F.struct(F.lit(r).alias("retrieve_size"), F.lit(c).alias("chunk_size")) for r, c in PARAMETERS])
    rows = chunks.select("*", F.explode(parameters).alias("p")).select("*", "p.*").drop("p")
    return solver(rows, driver).withColumn("run", F.lit(driver.run))


def pick(driver: Driver, n: int) -> Column:
    """A number below n from the question, the parameters and the layers, where a model would answer."""
    return F.pmod(F.col("qid") * 7919 + F.col("retrieve_size") + driver.shift, F.lit(n))


def solve_choice(rows: DataFrame, driver: Driver) -> DataFrame:
    """pred_choice (a letter, at times none of the options), latency and speed; the stub of the question-answering seam."""
    k = pick(driver, 5).cast("int")
    return rows.withColumns({"pred_choice": F.when(k == 4, "?").otherwise(F.char(F.lit(65) + k)), "response_time_s": F.pmod("qid", F.lit(50)) / 10.0, "processing_fps": 10.0 + F.pmod("qid", F.lit(7))})


def choice_questions(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    tasks = F.array(*[F.lit(t) for t in TASKS])
    return d.select(F.col("doc_id").alias("qid"), F.col("source").alias("video_id"), F.get(tasks, F.pmod("doc_id", F.lit(12)).cast("int")).alias("task"), F.char(F.lit(65) + F.col("n_chars") % 4).alias("correct_choice"), "n_chars")


_OPTIONS = ["w", "x", "y", "z"]
#: Questions of a video in the annotation files.
PER_VIDEO = 100


def _as_samples(spark, q: DataFrame) -> DataFrame:
    path = new_folder(spark, "annotations")
    one = F.struct(F.col("qid").cast("string").alias("question"), "choices", F.get("choices", F.ascii("correct_choice") - 65).alias("answer"), F.col("n_chars").cast("double").alias("end_time"), "task")
    by = q.groupBy("video").agg(F.transform(F.sort_array(F.collect_list(F.struct("qid", one.alias("q")))), lambda x: x["q"]).alias("conversations"))
    write_json_arrays(by.select(F.col("video").alias("video_id"), F.concat(F.lit("videos/"), "video", F.lit(".mp4")).alias("video_path"), "conversations"), path, CHUNKS)
    return A.load_samples(spark, path)


def _as_streamed_choices(spark, q: DataFrame) -> DataFrame:
    path = new_folder(spark, "annotations")
    lettered = F.transform("choices", lambda x, i: F.concat(F.char(65 + i), F.lit(". "), x))
    line = q.select(F.col("qid").cast("string").alias("question"), lettered.alias("options"), F.col("correct_choice").alias("answer"), F.col("n_chars").alias("video_end"), F.concat("video", F.lit(".mp4")).alias("video"), "task")
    write_jsonl(line, path)
    return A.load_streamed_choices(spark, path, "videos")


def _as_named_choices(spark, q: DataFrame) -> DataFrame:
    path = new_folder(spark, "annotations")
    named = F.map_from_arrays(F.array(*[F.lit(c) for c in "ABCD"]), "choices")
    one = F.struct(F.col("qid").cast("string").alias("Question"), named.alias("Choices"), F.col("correct_choice").alias("Correct Answer"))
    groups = q.groupBy("video").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("video", F.lit("_"), F.col("qid").cast("string")), one))).alias("g"))
    files = groups.select(F.concat(F.replace("video", F.lit("/"), F.lit("_")), F.lit(".json")).alias("name"), F.to_json(F.create_map("video", "g")).alias("value"))
    write_named(files, path, "name", "value").agg(F.sum("size")).collect()
    return A.load_named_choices(spark, path, "videos")


#: Data sets whose annotations come in another form than video samples.
FORMATS = {"streamingbench": _as_streamed_choices, "vidhalluc_ach_mcq": _as_named_choices}


def annotated_questions(spark, sf, driver: Driver) -> DataFrame:
    """The questions of a driver, from annotation files of its data set's format: qid, video_id, task, correct_choice and n_chars.

    Documents stand for the annotations; they are written in that format, a video per ``PER_VIDEO`` questions, and loaded.
    """
    choices = F.array(*[F.lit(x) for x in _OPTIONS])
    q = choice_questions(spark, sf).withColumns({"choices": choices, "video": F.concat("video_id", F.lit("/"), F.floor(F.col("qid") / PER_VIDEO).cast("string"))})
    loaded = A.questions_of(FORMATS.get(driver.name, _as_samples)(spark, q))
    return loaded.select(
        F.col("question").cast("long").alias("qid"), F.substring_index("video_id", "/", 1).alias("video_id"), "task", X.text_to_letter(F.col("choices"), F.col("answer")).alias("correct_choice"), F.col("end_time").cast("long").alias("n_chars")
    )


def sql_rows(driver: Driver) -> str:
    """Answer rows of ``choice_questions`` in SQL."""
    return f"""a AS (SELECT doc_id AS qid, source AS video_id, {TASKS}[doc_id % 12 + 1] AS task, chr((65 + n_chars % 4)::INTEGER) AS correct_choice, n_chars, retrieve_size, chunk_size,
  CASE WHEN k = 4 THEN '?' ELSE chr((65 + k)::INTEGER) END AS pred_choice, doc_id % 50 / 10.0::DOUBLE AS response_time_s, 10.0::DOUBLE + doc_id % 7 AS processing_fps
  FROM (SELECT *, (doc_id * 7919 + retrieve_size + {driver.shift}) % 5 AS k FROM documents, (VALUES (32, 1), (64, 1)) t(retrieve_size, chunk_size)))"""


# evaluators


def evaluate_choice(rows: DataFrame) -> DataFrame:
    """Accuracy in percent by parameters, rate of invalid letters, mean latency and speed."""
    right = (F.col("pred_choice") == F.col("correct_choice")).cast("double") * 100
    invalid = (~X.is_letter_answer(F.col("pred_choice"))).cast("double")
    return rows.groupBy("run", "retrieve_size", "chunk_size").agg(F.count("*").alias("n"), F.avg(right).alias("qa_acc"), F.avg(invalid).alias("error_rate"), F.avg("response_time_s").alias("latency"), F.avg("processing_fps").alias("fps"))


def evaluate_tasks(rows: DataFrame) -> DataFrame:
    """Accuracy of each task, their mean (``avg``) and that of all rows (``overall``)."""
    marked = rows.withColumn("correct", F.substring("pred_choice", 1, 1) == F.trim("correct_choice"))
    by = M.accuracy_by(marked, "run", "task")
    total = by.groupBy("run").agg(F.sum("n_correct").alias("n_correct"), F.sum("n").alias("n"), F.avg("accuracy").alias("mean"))
    named = lambda name, value: total.select("run", F.lit(name).alias("task"), "n_correct", "n", value.alias("accuracy"))
    return by.unionByName(named("avg", F.col("mean"))).unionByName(named("overall", F.col("n_correct") / F.col("n")))


def evaluate_families(rows: DataFrame) -> DataFrame:
    """Mean task accuracy and row-weighted latency of each family and of all; forward tasks compare whole answers without brackets."""
    reply = F.when(F.col("task").isin(FORWARD), F.trim(F.translate("pred_answer", "()", ""))).otherwise(F.substring("pred_answer", 1, 1))
    family = F.when(F.col("task").isin(REAL_TIME), "real_time").when(F.col("task").isin(BACKWARD), "backward").otherwise("forward")
    marked = rows.withColumns({"correct": reply == F.trim("correct_choice"), "family": family})
    by = marked.groupBy("run", "family", "task").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.sum("response_time_s").alias("s"), F.count("*").alias("n"))
    facts = [F.avg("accuracy").alias("accuracy"), F.count("*").alias("n_tasks"), (F.sum("s") / F.sum("n")).alias("latency")]
    return by.groupBy("run", "family").agg(*facts).unionByName(by.groupBy("run").agg(F.lit("all").alias("family"), *facts).select("run", "family", "accuracy", "n_tasks", "latency"))


def submission(rows: DataFrame) -> DataFrame:
    """q_uid and ordinal answer (invalid letters are A) of the greatest retrieve_size at chunk_size 1."""
    most = rows.agg(F.max("retrieve_size").alias("most"))
    last = rows.join(F.broadcast(most), F.col("retrieve_size") == F.col("most")).where("chunk_size = 1")
    return last.select("run", F.col("qid").alias("q_uid"), F.when(F.col("pred_choice").isin(*"ABCDE"), F.ascii("pred_choice") - 65).otherwise(0).alias("answer"))


def evaluate_judged(rows: DataFrame) -> DataFrame:
    """Share of yes among replies that say yes or no, and the mean of the whole part of the scores."""
    verdict = F.lower("verdict")
    yes, no = verdict.contains("yes"), ~verdict.contains("yes") & verdict.contains("no")
    return rows.groupBy("run").agg(F.count_if(yes).alias("n_yes"), F.count_if(no).alias("n_no"), F.try_divide(F.count_if(yes), F.count_if(yes | no)).alias("accuracy"), F.avg(F.col("score").cast("int")).alias("mean_score"))


def evaluate_binary(rows: DataFrame) -> DataFrame:
    """Accuracy of yes and no by parameters, after both sides are normalised."""
    right = X.normalize_binary(F.col("pred_answer")) == X.normalize_binary(F.col("answer"))
    return rows.groupBy("run", "retrieve_size", "chunk_size").agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def _register(name: str, layered: bool, sql: Callable[[Driver], str] | None, body) -> None:
    """A driver as a query, and its layered variant."""
    for driver in [Driver(name), *([Driver(name, LAYERS)] if layered else [])]:

        def run(spark, sf, driver=driver):
            return body(spark, sf, driver)

        run.__name__ = f"driver_{name}{'_layered' if driver.layers else ''}"
        query("N", sql(driver) if sql else None)(run)


# multiple choice: mlvu, qaego4d, cgbench, vidhalluc_ach_mcq


def _choice(spark, sf, driver):
    # means of floating point numbers depend on the order of rows in their last digits
    found = evaluate_choice(answered(annotated_questions(spark, sf, driver), driver, solve_choice))
    return found.withColumns({c: F.round(c, 9) for c in ("qa_acc", "error_rate", "latency", "fps")})


def _choice_sql(driver):
    return f"""WITH {sql_rows(driver)} SELECT '{driver.run}' AS run, retrieve_size, chunk_size, count(*) AS n, round(avg(CASE WHEN pred_choice = correct_choice THEN 100.0 ELSE 0.0 END::DOUBLE), 9) AS qa_acc,
  round(avg((pred_choice NOT IN ('A', 'B', 'C', 'D'))::INT::DOUBLE), 9) AS error_rate, round(avg(response_time_s), 9) AS latency, round(avg(processing_fps), 9) AS fps FROM a GROUP BY ALL"""


for _name, _layered in (("mlvu", True), ("qaego4d", True), ("cgbench", False), ("vidhalluc_ach_mcq", False)):
    _register(_name, _layered, _choice_sql, _choice)


# multiple choice with moved windows: qaego4d_temporal_shift


_PLACES = {"head": 0.0, "q25": 0.25, "mid": 0.5, "q75": 0.75, "tail": 1.0}


def _shifted(spark, sf, driver):
    """Of 100 videos one question with a window each, its window moved to five places at its length; results by place."""
    q = annotated_questions(spark, sf, driver)
    one = F.row_number().over(W.partitionBy("video_id").orderBy(S.seeded_order(2025, "qid"), "qid"))
    picked = q.withColumn("r", one).where("r = 1 and n_chars > 0").orderBy(S.seeded_order(2025, "qid"), "qid").limit(100).drop("r")  # the driver takes 100 videos
    length = F.lit(30.5)
    total = F.col("n_chars").cast("double")
    rows = answered(picked, driver, solve_choice)
    places = F.array(*[F.struct(F.lit(p).alias("place"), T.moved_window(length, total, x).alias("start")) for p, x in _PLACES.items()])
    moved = rows.select("*", F.explode(places).alias("m")).select("*", "m.place", "m.start")
    right = (F.col("pred_choice") == F.col("correct_choice")).cast("double") * 100
    return moved.groupBy("run", "place", "retrieve_size", "chunk_size").agg(F.count("*").alias("n"), F.avg(right).alias("qa_acc"), F.round(F.avg("start"), 6).alias("mean_start"))


def _shifted_sql(driver):
    h = "(2025 * 31 + qid * 2654435761) % 4294967296"
    return f"""WITH {sql_rows(driver)}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id, retrieve_size ORDER BY {h}, qid) AS r FROM a), s AS (SELECT DISTINCT qid, {h} AS h FROM o WHERE r = 1 AND n_chars > 0 ORDER BY h, qid LIMIT 100),
m AS (SELECT o.*, place, CASE WHEN x = 0 THEN 0 ELSE greatest(0, least(x * n_chars - CASE WHEN x = 1 THEN 30.5 ELSE 15.25 END, greatest(0, n_chars - 30.5))) END::DOUBLE AS start FROM o JOIN s ON o.qid = s.qid, (VALUES {', '.join(f"('{p}', {x})" for p, x in _PLACES.items())}) t(place, x) WHERE r = 1)
SELECT '{driver.run}' AS run, place, retrieve_size, chunk_size, count(*) AS n, avg(CASE WHEN pred_choice = correct_choice THEN 100.0 ELSE 0.0 END::DOUBLE) AS qa_acc, round(avg(start), 6) AS mean_start FROM m GROUP BY ALL"""


_register("qaego4d_temporal_shift", False, _shifted_sql, _shifted)


# submissions: egoschema


def _submission_sql(driver):
    return f"WITH {sql_rows(driver)} SELECT '{driver.run}' AS run, qid AS q_uid, CASE WHEN pred_choice = '?' THEN 0 ELSE ascii(pred_choice) - 65 END::INTEGER AS answer FROM a WHERE retrieve_size = 64"


_register("egoschema", True, _submission_sql, lambda spark, sf, driver: submission(answered(annotated_questions(spark, sf, driver), driver, solve_choice)))


# open questions judged by a model: activitynet_qa, rvs_ego, rvs_movie


def _judged(spark, sf, driver):
    c = table(spark, sf, "conversations").where("role = 'user'")
    q = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "conv_id")

    def solve(rows, driver):
        k = pick(driver, 4)
        verdict = F.when(k == 0, "Yes").when(k == 1, "no").when(k == 2, "it's a yes, not a no").otherwise("unclear")
        return rows.withColumns({"verdict": verdict, "score": k + 0.8})

    return evaluate_judged(answered(q, driver, solve))


def _judged_sql(driver):
    return f"""WITH a AS (SELECT ((conv_id * 1000 + turn) * 7919 + retrieve_size + {driver.shift}) % 4 AS k FROM conversations, (VALUES (32), (64)) t(retrieve_size) WHERE role = 'user')
SELECT '{driver.run}' AS run, count(*) FILTER (k IN (0, 2)) AS n_yes, count(*) FILTER (k = 1) AS n_no, count(*) FILTER (k IN (0, 2)) / nullif(count(*) FILTER (k < 3), 0)::DOUBLE AS accuracy, avg(k::DOUBLE) AS mean_score FROM a"""


for _name in ("activitynet_qa", "rvs_ego", "rvs_movie"):
    _register(_name, True, _judged_sql, _judged)


# families of tasks: ovobench


def _families(spark, sf, driver):
    def solve(rows, driver):
        # forward tasks are answered in brackets, others with text after the letter
        rows = solve_choice(rows, driver)
        return rows.withColumn("pred_answer", F.when(F.col("task").isin(FORWARD), F.concat(F.lit("("), "pred_choice", F.lit(") "))).otherwise(F.concat("pred_choice", F.lit(". because"))))

    return evaluate_families(answered(annotated_questions(spark, sf, driver), driver, solve)).select("run", "family", F.round("accuracy", 9).alias("accuracy"), "n_tasks", F.round("latency", 9).alias("latency"))


def _families_sql(driver):
    return f"""WITH {sql_rows(driver)}, t AS (SELECT CASE WHEN task IN {tuple(REAL_TIME)} THEN 'real_time' WHEN task IN {tuple(BACKWARD)} THEN 'backward' ELSE 'forward' END AS family, task, avg((pred_choice = correct_choice)::INT::DOUBLE) AS acc, sum(response_time_s) AS s, count(*) AS n FROM a GROUP BY ALL)
SELECT '{driver.run}' AS run, family, round(avg(acc), 9) AS accuracy, count(*) AS n_tasks, round(sum(s) / sum(n), 9) AS latency FROM t GROUP BY family UNION ALL SELECT '{driver.run}', 'all', round(avg(acc), 9), count(*), round(sum(s) / sum(n), 9) FROM t"""


_register("ovobench", True, _families_sql, _families)


# tasks: streamingbench, videomme


def _tasks(spark, sf, driver):
    return evaluate_tasks(answered(annotated_questions(spark, sf, driver), driver, solve_choice)).withColumn("accuracy", F.round("accuracy", 9))


def _tasks_sql(driver):
    return f"""WITH {sql_rows(driver)}, t AS (SELECT task, count(*) FILTER (pred_choice = correct_choice) AS n_correct, count(*) AS n, avg((pred_choice = correct_choice)::INT::DOUBLE) AS acc FROM a GROUP BY task)
SELECT '{driver.run}' AS run, task, n_correct, n, round(acc, 9) AS accuracy FROM t UNION ALL SELECT '{driver.run}', 'avg', sum(n_correct)::BIGINT, sum(n)::BIGINT, round(avg(acc), 9) FROM t
UNION ALL SELECT '{driver.run}', 'overall', sum(n_correct)::BIGINT, sum(n)::BIGINT, round(sum(n_correct) / sum(n)::DOUBLE, 9) FROM t"""


_register("streamingbench", True, _tasks_sql, _tasks)
_register("videomme", False, _tasks_sql, _tasks)


# yes and no: eventhal


def _binary(spark, sf, driver):
    # a folder of files of yes and no questions, each of a part of the labels
    path, labels = new_folder(spark, "annotations"), table(spark, sf, "labels")
    asked = F.array(F.struct(F.col("doc_id").cast("string").alias("question"), F.when(F.col("quality") == 1, "Yes.").otherwise("no").alias("answer")))
    one = F.to_json(F.struct(F.concat(F.lit("part_"), F.col("doc_id").cast("string")).alias("id"), asked.alias("questions")))
    name = F.concat(F.floor(F.col("doc_id") / (100 * PER_VIDEO)).cast("string"), F.lit("_questions.json"))
    files = labels.where("doc_id is not null and quality is not null").groupBy(name.alias("name")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))
    write_named(files, path, "name", "value").agg(F.sum("size")).collect()
    q = A.questions_of(A.load_judged_splits(spark, path, "videos")).select(F.col("question").cast("long").alias("qid"), "answer")
    forms = F.array(*[F.lit(x) for x in ("yes", "(Yes)", "No, it isn't", "F", "perhaps")])
    return evaluate_binary(answered(q, driver, lambda rows, d: rows.withColumn("pred_answer", F.get(forms, pick(d, 5).cast("int")))))


def _binary_sql(driver):
    return f"""WITH a AS (SELECT quality, retrieve_size, 1 AS chunk_size, (doc_id * 7919 + retrieve_size + {driver.shift}) % 5 AS k FROM labels, (VALUES (32), (64)) t(retrieve_size))
SELECT '{driver.run}' AS run, retrieve_size, chunk_size, count(*) AS n, avg(CASE WHEN k = 4 THEN 0 WHEN (k < 2) = (quality = 1) THEN 1 ELSE 0 END::DOUBLE) AS accuracy FROM a GROUP BY ALL"""


_register("eventhal", True, _binary_sql, _binary)


# matched by several keys: etbench


def etbench_truths(spark, sf) -> DataFrame:
    """User turns as truths: task by turn, source by conversation, a video path for each conversation."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    path = F.concat(F.lit("videos/"), F.col("conv_id").cast("string"), F.lit(".mp4"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.concat(F.lit("t"), (F.col("turn") % 3).cast("string")).alias("task"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("source"), F.col("turn").alias("idx"), path.alias("video"), F.col("text").alias("q"))


def etbench_predictions(truths: DataFrame, driver: Driver) -> DataFrame:
    """A prediction per truth that names it by triplet, by video and question, by base name, by a longer question, or by its video only."""
    k = F.pmod(F.col("pos") + driver.shift, F.lit(5))
    none = F.lit(None).cast("string")
    return truths.select(
        "pos", F.when(k == 0, F.col("task")).alias("task"), F.when(k == 0, F.col("source")).alias("source"), F.when(k == 0, F.col("idx")).alias("idx"),
        F.when(k == 2, F.concat(F.lit("/other/"), F.substring_index("video", "/", -1))).otherwise(F.col("video")).alias("video"),
        F.when(k == 0, none).when(k == 3, F.concat("q", F.lit(" Options: x"))).when(k == 4, F.lit("?")).otherwise(F.upper("q")).alias("q"), F.concat(F.lit("a"), F.col("pos").cast("string")).alias("a"),
    )


def _etbench(spark, sf, driver):
    truths = etbench_truths(spark, sf)
    return consuming_match(etbench_predictions(truths, driver), truths).withColumn("run", F.lit(driver.run))


_register("etbench", True, None, _etbench)
