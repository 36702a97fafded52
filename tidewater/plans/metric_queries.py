"""Metric queries over answer rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.operators import metrics as M

from .registry import query
from .tables import RESULTS, results, table, turns, TURNS

WITH = f"WITH {RESULTS} "


@query("I4 I19 I31", WITH + "SELECT task, sum(correct)::BIGINT AS n_correct, count(*) AS n, avg(correct::DOUBLE) AS accuracy FROM r GROUP BY task")
def task_accuracy(spark, sf):
    return M.accuracy_by(results(spark, sf), "task")


@query("I5", WITH + ", t AS (SELECT task, sum(correct) AS c, count(*) AS n, avg(correct::DOUBLE) AS a FROM r GROUP BY task) SELECT sum(c)::DOUBLE / sum(n) AS micro, round(avg(a), 9) AS macro, count(*) AS n_groups FROM t")
def micro_macro_accuracy(spark, sf):
    return M.micro_macro(results(spark, sf), "task").withColumn("macro", F.round("macro", 9))


@query("I6 E17", WITH + ", t AS (SELECT family, task, avg(correct::DOUBLE) AS a FROM r GROUP BY ALL) SELECT family, round(avg(a), 9) AS macro, count(*) AS n_tasks FROM t GROUP BY family UNION ALL SELECT NULL, round(avg(a), 9), count(*) FROM t")
def family_rollup(spark, sf):
    return M.family_rollup(results(spark, sf), "family", "task").withColumn("macro", F.round("macro", 9))


@query("I7 I8", WITH + "SELECT retrieve_size, chunk_size, avg(correct::DOUBLE) AS accuracy, avg(n_chars::DOUBLE) AS mean_chars FROM r GROUP BY ALL")
def accuracy_by_parameters(spark, sf):
    return results(spark, sf).groupBy("retrieve_size", "chunk_size").agg(F.avg("correct").alias("accuracy"), F.avg("n_chars").alias("mean_chars"))


@query("I9", WITH + "SELECT chunk_size, avg(correct::DOUBLE) FILTER (retrieve_size = 32) AS \"32\", avg(correct::DOUBLE) FILTER (retrieve_size = 64) AS \"64\", avg(correct::DOUBLE) FILTER (retrieve_size = 96) AS \"96\" FROM r GROUP BY chunk_size")
def pivot_metric(spark, sf):
    return M.pivot_mean(results(spark, sf), "chunk_size", "retrieve_size", [32, 64, 96], F.col("correct"))


@query("I10", WITH + "SELECT task, sum(correct)::DOUBLE / (SELECT count(*) FROM r) AS share FROM r GROUP BY task")
def task_share(spark, sf):
    return M.task_share(results(spark, sf), "task", "correct")


@query("I11 D35 E6", WITH + "SELECT avg(CASE WHEN pred NOT IN (0, 1) OR gold = 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS error_rate, avg(n_chars::DOUBLE) AS mean_latency, count(*) AS n FROM r WHERE task <> 'src0'")
def error_rate(spark, sf):
    kept = results(spark, sf).where(~F.col("task").isin("src0"))
    bad = ~X.is_letter_answer(F.col("pred").cast("string"), "01") | (F.col("gold") == 0)
    return kept.agg(F.avg(bad.cast("double")).alias("error_rate"), F.avg("n_chars").alias("mean_latency"), F.count("*").alias("n"))


@query("I12 D9", "SELECT avg(CASE WHEN e.said = e.truth THEN 1.0 ELSE 0.0 END::DOUBLE) AS accuracy, count(*) AS n FROM (SELECT CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS truth, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS said FROM labels) e")
def binary_accuracy(spark, sf):
    said = F.when(F.col("quality") == 1, " Yes, it is.").otherwise("(no)")
    truth = F.when(F.col("toxic") == 1, "TRUE").otherwise("0")
    return table(spark, sf, "labels").agg(F.avg((X.normalize_binary(said) == X.normalize_binary(truth)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


@query("I13", "SELECT conv_id, avg(CASE WHEN contains(lower(text), 'the') THEN 1.0 WHEN contains(lower(text), 'no') THEN 0.0 ELSE 0.5 END::DOUBLE) AS said FROM conversations GROUP BY conv_id")
def contains_accuracy(spark, sf):
    low = F.lower("text")
    mark = F.when(low.contains("the"), 1.0).when(low.contains("no"), 0.0).otherwise(0.5)
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.avg(mark).alias("said"))


@query("I14", WITH + ", b AS (SELECT correct, (qid % 101) / 100.0 AS recall FROM r) SELECT CASE WHEN recall > 0 AND recall <= 0.1 THEN '0-0.1' WHEN recall > 0.1 AND recall <= 0.3 THEN '0.1-0.3' WHEN recall > 0.3 AND recall <= 0.5 THEN '0.3-0.5' WHEN recall > 0.5 AND recall <= 1 THEN '0.5-1' END AS bin, avg(correct::DOUBLE) AS mean, round(stddev_samp(correct::DOUBLE), 9) AS std, count(*) AS n FROM b GROUP BY bin")
def binned_accuracy(spark, sf):
    b = results(spark, sf).withColumn("recall", F.pmod("qid", F.lit(101)) / 100.0)
    return b.groupBy(M.right_closed_bin(F.col("recall"), [0, 0.1, 0.3, 0.5, 1]).alias("bin")).agg(F.avg("correct").alias("mean"), F.round(F.stddev_samp("correct"), 9).alias("std"), F.count("*").alias("n"))


@query("I15", WITH + "SELECT family, task, chunk_size, sum(correct)::BIGINT AS n_correct, count(*) AS n FROM r GROUP BY GROUPING SETS ((family, task), (family, chunk_size), (task), (chunk_size), (family), ())")
def grouping_sets_report(spark, sf):
    return M.grouping_sets(results(spark, sf), [["family", "task"], ["family", "chunk_size"], ["task"], ["chunk_size"], ["family"], []])


@query("I16 I20", WITH + "SELECT task, count(*) FILTER (answer <> '') AS n_answered, count(*) AS n, avg(correct::DOUBLE) FILTER (answer <> '') AS accuracy FROM (SELECT *, CASE WHEN n_chars % 5 = 0 THEN '' ELSE 'A' END AS answer FROM r) GROUP BY task")
def answered_only_accuracy(spark, sf):
    return M.answered_accuracy(results(spark, sf).withColumn("answer", F.when(F.col("n_chars") % 5 == 0, "").otherwise("A")), "task", "answer")


@query("I17", "SELECT source, count(*) AS n, count(*) = 50 AS complete FROM documents GROUP BY source")
def group_completeness(spark, sf):
    return M.completeness(table(spark, sf, "documents"), "source", 50)


@query("I18", WITH + "SELECT task, count(*) AS n, string_agg(qid::VARCHAR, ',' ORDER BY qid) AS qids FROM r GROUP BY task")
def nested_questions(spark, sf):
    from tidewater.operators.sequences import nest

    n = nest(results(spark, sf), ["task"], "qid", ["pred", "gold"])
    return n.select("task", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x["qid"].cast("string")), ",").alias("qids"))


@query("I23", "SELECT lang, avg(contains(text, 'the')::INT::DOUBLE) AS contains_acc, avg((upper(substr(ltrim(text), 1, 1)) = 'T')::INT::DOUBLE) AS first_char_acc FROM documents GROUP BY lang")
def match_accuracies(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.avg(t.contains("the").cast("double")).alias("contains_acc"),
        F.avg((F.upper(F.substring(F.ltrim(t), 1, 1)) == "T").cast("double")).alias("first_char_acc"),
    )


@query("I24 E12", f"WITH {TURNS} SELECT conv_id % 4 AS kind, avg((abs(realtime - 6) <= 2)::INT::DOUBLE) AS time_accuracy, avg((contains(text, 'e'))::INT::DOUBLE) AS contains_accuracy, count(*) AS n FROM q GROUP BY kind")
def time_accuracy(spark, sf):
    q = turns(spark, sf)
    return q.groupBy(F.pmod("conv_id", F.lit(4)).alias("kind")).agg(
        F.avg((F.abs(F.col("realtime") - 6) <= 2).cast("double")).alias("time_accuracy"), F.avg(F.col("text").contains("e").cast("double")).alias("contains_accuracy"), F.count("*").alias("n")
    )


@query("I25", WITH + "SELECT gold AS truth, count(*) AS n, count(*) FILTER (gold = pred) AS n_right, count(*) FILTER (pred = 1) AS n_said_one FROM r GROUP BY gold")
def confusion_split(spark, sf):
    return M.confusion_split(results(spark, sf), "gold", "pred")


@query("I26", "SELECT (count(*) FILTER (doc_id % 3 = 0) + count(*) FILTER (doc_id % 4 = 0)) / (2.0 * count(*))::DOUBLE AS win_rate, count(*) AS n FROM labels")
def win_rate(spark, sf):
    j = table(spark, sf, "labels").select(F.when(F.col("doc_id") % 3 == 0, "M").otherwise("G").alias("ab"), F.when(F.col("doc_id") % 4 == 0, "M").when(F.col("doc_id") % 4 == 1, "tie").otherwise("G").alias("ba"))
    return M.win_rate(j, "ab", "ba", "M")


@query("I27", "SELECT count(*) FILTER (toxic = 1)::DOUBLE / count(*) FILTER (toxic IN (0, 1)) AS yes_rate, avg(floor((doc_id % 50) / 10.0)) AS mean_score FROM labels")
def judge_scores(spark, sf):
    j = table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "yes").when(F.col("toxic") == 0, "no").alias("verdict"), (F.pmod("doc_id", F.lit(50)) / 10.0).alias("score"))
    return j.agg((F.count_if(F.col("verdict") == "yes") / F.count_if(F.col("verdict").isin("yes", "no"))).alias("yes_rate"), F.avg(F.col("score").cast("int")).alias("mean_score"))


@query("I28 J15", WITH + ", a AS (SELECT task, retrieve_size, avg(n_chars::DOUBLE) AS v FROM r GROUP BY ALL), c AS (SELECT task, (v - lag(v) OVER w) / lag(v) OVER w AS change FROM a WINDOW w AS (PARTITION BY task ORDER BY retrieve_size)) SELECT task, round(avg(change), 9) AS mean_change FROM c GROUP BY task")
def relative_change(spark, sf):
    a = results(spark, sf).groupBy("task", "retrieve_size").agg(F.avg("n_chars").alias("v"))
    return M.relative_change(a, "task", "retrieve_size", "v").select("task", F.round("mean_change", 9).alias("mean_change")).orderBy(F.desc(F.abs("mean_change")), "task")


@query("I29", "WITH n AS (SELECT source, (n_chars % 1000) / 1000.0 AS pos, count(*) OVER (PARTITION BY source) AS c FROM documents), b AS (SELECT source, pos, CASE WHEN c >= 100 THEN 10 WHEN c >= 20 THEN 5 ELSE 1 END AS bins FROM n) SELECT source, bins, least(floor(pos * bins), bins - 1)::BIGINT AS bin, count(*) AS n, (count(*) * bins)::DOUBLE AS density FROM b GROUP BY source, bins, least(floor(pos * bins), bins - 1)::BIGINT")
def adaptive_density(spark, sf):
    return M.adaptive_bins(table(spark, sf, "documents"), "source", F.pmod("n_chars", F.lit(1000)) / 1000.0)


@query("I30", "SELECT lang, avg(n_chars::DOUBLE) AS mean, median(n_chars)::DOUBLE AS median, min(n_chars) AS least, max(n_chars) AS most, count(*) AS n FROM documents GROUP BY lang")
def length_summary(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.avg("n_chars").alias("mean"), F.median("n_chars").alias("median"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count("*").alias("n"))


@query("I30", "SELECT lang, (n_chars // 500) AS bin, count(*) AS n FROM documents GROUP BY ALL")
def length_histogram(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", F.floor(F.col("n_chars") / 500).alias("bin")).agg(F.count("*").alias("n"))


@query("I32", WITH + ", m AS (SELECT task, max(n_chars / 1000.0) AS top FROM r GROUP BY task) SELECT r.task, round(sum(exp(n_chars / 1000.0 - top) * gold) / sum(exp(n_chars / 1000.0 - top)), 6) AS weighted FROM r JOIN m ON r.task = m.task GROUP BY r.task")
def online_softmax_mean(spark, sf):
    r = results(spark, sf).withColumn("s", F.col("n_chars") / 1000.0)
    return M.softmax_mean(r, "task", "s", "gold").withColumn("weighted", F.round("weighted", 6))


@query("E7", WITH + "SELECT qid, retrieve_size FROM r WHERE retrieve_size = (SELECT max(retrieve_size) FROM r) AND chunk_size = 1")
def parameter_filter(spark, sf):
    r = results(spark, sf)
    most = r.agg(F.max("retrieve_size").alias("most"))
    return r.join(F.broadcast(most), r.retrieve_size == most.most).where("chunk_size = 1").select("qid", "retrieve_size")


@query("E8", WITH + "SELECT family, count(*) AS n FROM r WHERE n_chars BETWEEN 500 AND 2000 GROUP BY family")
def duration_bucket(spark, sf):
    return results(spark, sf).where(F.col("n_chars").between(500, 2000)).groupBy("family").agg(F.count("*").alias("n"))


@query("B10 D8", WITH + "SELECT qid, CASE WHEN pred = 1 THEN 1 ELSE 0 END::INTEGER AS answer FROM r")
def submission(spark, sf):
    letter = F.when(F.col("pred") == 1, "B").otherwise("x")
    return results(spark, sf).select("qid", F.when(letter.isin("A", "B", "C", "D", "E"), F.ascii(letter) - 65).otherwise(0).alias("answer"))


@query("B9", WITH + "SELECT task || ': ' || sum(correct) || '/' || count(*) AS line FROM r GROUP BY task")
def text_report(spark, sf):
    return M.accuracy_by(results(spark, sf), "task").select(F.format_string("%s: %d/%d", "task", "n_correct", "n").alias("line"))
