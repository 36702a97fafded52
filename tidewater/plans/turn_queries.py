"""Queries over conversations as turn arrays, question wordings and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.functions import timeline as T
from tidewater.operators import sequences as S
from tidewater.operators import turns as U

from .registry import query
from .tables import TURNS, table, turns

_CONTENT = "array<struct<type:string,text:string,text_stream:string,image:string,video:string>>"


def raw_turns(spark, sf):
    """Conversations with videos, streamed texts, unknown elements and unknown roles: conv_id, turns."""
    c = table(spark, sf, "conversations")
    video = F.array(U.element("video", video=F.concat(F.lit("/old/"), F.col("conv_id").cast("string"))), U.element("text", text=F.col("text")))
    streamed = F.array(U.element("text", text=F.lit(""), text_stream=F.col("text")))
    mixed = F.array(U.element("image", image=F.lit("x")), U.element("audio"), U.element("text", text=F.col("text")))
    k = F.col("turn") % 3
    content = F.when(F.col("role") == "system", mixed).when((k == 0) & (F.col("role") == "user"), video).when(k == 1, streamed).otherwise(mixed).cast(_CONTENT)
    rows = c.select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, "tool").otherwise(F.col("role")).alias("role"), content.alias("content"))
    nested = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("rows"))
    return nested.select("conv_id", F.transform("rows", lambda r: U.turn(r["role"], r["content"])).alias("turns"))


#: Normalised turns in SQL: role, what stands before the text, and the text, by place from 1.
_NORMAL = f"""raw AS (SELECT conv_id, turn, role AS given, CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END AS role, text,
  CASE WHEN role = 'system' THEN '' WHEN turn % 3 = 0 AND role = 'user' THEN 'video:|' WHEN turn % 3 = 1 THEN '' ELSE 'image:|' END AS pre FROM conversations),
heads AS (SELECT conv_id, arg_min(role, turn) AS head FROM raw GROUP BY conv_id),
kept AS (SELECT conv_id, turn, role, pre, text FROM raw WHERE role <> 'tool' UNION ALL SELECT conv_id, -1, 'system', '', '{U.DEFAULT_SYSTEM}' FROM heads WHERE head <> 'system'),
norm AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord, count(*) OVER (PARTITION BY conv_id) AS n FROM kept),
slot AS (SELECT conv_id, min(ord) FILTER (role = 'user' AND starts_with(pre, 'video')) AS slot FROM norm GROUP BY conv_id)"""


@query("D36", f"WITH {_NORMAL} SELECT conv_id, md5(string_agg(role || '[' || pre || 'text:' || text || ']', ' ' ORDER BY ord)) AS outline, max(n) AS n FROM norm GROUP BY conv_id")
def normalised_conversations(spark, sf):
    n = raw_turns(spark, sf).select("conv_id", U.normalised(F.col("turns")).alias("turns"))
    return n.select("conv_id", F.md5(U.outline(F.col("turns"))).alias("outline"), F.size("turns").cast("long").alias("n"))


@query("D37", f"WITH {_NORMAL} SELECT conv_id, md5(string_agg(role || '[' || CASE WHEN ord = slot THEN 'text:Time=0-1s|video:|text:Time=1-2s|video:|' ELSE pre END || 'text:' || text || ']', ' ' ORDER BY ord)) AS outline FROM norm JOIN slot USING (conv_id) GROUP BY conv_id")
def expanded_slots(spark, sf):
    n = raw_turns(spark, sf).select("conv_id", U.normalised(F.col("turns")).alias("turns"))
    wide = U.expand_slot(F.col("turns"), F.array(F.lit("Time=0-1s"), F.lit("Time=1-2s")))
    return n.select("conv_id", F.md5(U.outline(wide)).alias("outline"))


@query("D38", f"""WITH {_NORMAL}, p AS (SELECT norm.*, coalesce(slot, 2) AS p FROM norm JOIN slot USING (conv_id))
SELECT conv_id, md5(string_agg(CASE WHEN ord = p AND n > p THEN role || '[' || pre || 'text:Q?] assistant[text:A!] user[text:' || text || ']' ELSE role || '[' || pre || 'text:' || text || ']' END, ' ' ORDER BY ord)) AS outline,
  max(n + CASE WHEN n > p THEN 2 ELSE 0 END) AS n FROM p GROUP BY conv_id""")
def inserted_turns(spark, sf):
    n = raw_turns(spark, sf).select("conv_id", U.normalised(F.col("turns")).alias("turns"))
    longer = U.insert_question(F.col("turns"), F.lit("Q?"), F.lit("A!"))
    return n.select("conv_id", F.md5(U.outline(longer)).alias("outline"), F.size(longer).cast("long").alias("n"))


@query("D26", "SELECT conv_id, count(*) FILTER (role = 'user' AND turn % 3 = 0 AND turn % 5 <> 4) AS n_videos, '/data/' || conv_id AS path FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user' AND turn % 3 = 0 AND turn % 5 <> 4) > 0")
def rebased_contents(spark, sf):
    def rebased(t):
        return U.turn(t["role"], F.when(t["role"] == "user", F.transform(t["content"], lambda e: F.when(e["video"].isNotNull(), e.withField("video", X.path_rebase(e["video"], "/old/", "/data/"))).otherwise(e))).otherwise(t["content"]))

    r = raw_turns(spark, sf).select("conv_id", F.transform("turns", rebased).alias("turns"))
    paths = F.flatten(F.transform("turns", lambda t: F.transform(F.filter(t["content"], lambda e: e["video"].startswith("/data/")), lambda e: e["video"])))
    return r.select("conv_id", paths.alias("p")).where("size(p) > 0").select("conv_id", F.size("p").cast("long").alias("n_videos"), F.element_at("p", 1).alias("path"))


_SYSTEM = "Be brief."


@query("D31", f"""WITH t AS (SELECT conv_id, role, CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY conv_id) THEN '' ELSE text END AS text, row_number() OVER w - 1 AS i, turn FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, md5('{_SYSTEM} ' || string_agg(CASE WHEN text <> '' THEN role || ': ' || text || CASE WHEN i % 2 = 0 THEN ' ' ELSE '</s>' END ELSE role || ':' END, '' ORDER BY i)) AS two,
  md5('{_SYSTEM}' || string_agg(CASE WHEN text <> '' THEN text || '</s>' ELSE '' END, '' ORDER BY i)) AS plain,
  md5('{_SYSTEM}<|im_end|>' || chr(10) || string_agg(role || chr(10) || CASE WHEN text <> '' THEN text || '<|im_end|>' || chr(10) ELSE '' END, '' ORDER BY i)) AS chatml,
  md5(ltrim(string_agg(CASE WHEN text = '' THEN '' WHEN i % 2 = 0 THEN '<s>[INST] ' || CASE WHEN i = 0 THEN '<<SYS>>' || chr(10) || '{_SYSTEM}' || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || text || ' [/INST]' ELSE ' ' || text || ' </s>' END, '' ORDER BY i), '<s>')) AS llama_2,
  md5('<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || '{_SYSTEM}<|eot_id|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || CASE WHEN text <> '' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '<|eot_id|>' ELSE '' END, '' ORDER BY i)) AS llama_3,
  md5('<|im_start|>system' || chr(10) || '{_SYSTEM}<|im_end|>' || chr(10) || string_agg('<|im_start|>' || role || chr(10) || CASE WHEN text <> '' THEN text || '<|im_end|>' || chr(10) ELSE '' END, '' ORDER BY i)) AS qwen2
FROM t GROUP BY conv_id""")
def rendered_styles(spark, sf):
    c = table(spark, sf, "conversations").where("role <> 'system'")
    t = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    # the last text is left for the answer
    slots = F.transform("rows", lambda r, i: F.struct(r["role"].alias("role"), F.when(i + 1 < F.size("rows"), r["text"]).otherwise("").alias("text")))
    t = t.select("conv_id", slots.alias("turns"))
    return t.select("conv_id", *[F.md5(render(F.col("turns"), _SYSTEM)).alias(name) for name, render in U.STYLES.items()])


@query("D32", "SELECT doc_id, trim(regexp_replace(replace(replace(x, '<image>', '|<image>|'), '<a.b>', '|<a.b>|'), '[|]+', '|', 'g'), '|') AS parts FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a<image>' || source || '<a.b>' WHEN doc_id % 3 = 1 THEN '<image><a.b>' || lang ELSE source || '<axb>' END AS x FROM documents)")
def kept_separators(spark, sf):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(F.lit("a<image>"), "source", F.lit("<a.b>"))).when(k == 1, F.concat(F.lit("<image><a.b>"), "lang")).otherwise(F.concat("source", F.lit("<axb>")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.keep_separators(text, ["<image>", "<a.b>"]), "|").alias("parts"))


_WORDING = " ".join(f"WHEN '{name}' THEN '{w.replace(chr(39), chr(39) * 2).split('{}')[0]}' || source || '{w.replace(chr(39), chr(39) * 2).split('{}')[1]}'" for name, w in X.TASK_QUESTIONS.items())


@query("D15", f"SELECT doc_id, md5(CASE task {_WORDING} ELSE source END) AS question, CASE WHEN task IN ('SSR', 'CRR') THEN CASE WHEN n_chars % 2 = 1 THEN 'Yes' ELSE 'No' END WHEN task = 'REC' THEN (n_chars % 7)::VARCHAR ELSE ['w', 'x', 'y', 'z'][n_chars % 4 + 1] END AS answer FROM (SELECT *, ['SSR', 'CRR', 'REC', 'EPM'][doc_id % 4 + 1] AS task FROM documents)")
def task_questions(spark, sf):
    d = table(spark, sf, "documents").withColumn("task", F.get(F.array(*[F.lit(t) for t in ("SSR", "CRR", "REC", "EPM")]), (F.col("doc_id") % 4).cast("int")))
    options = F.array(*[F.lit(x) for x in "wxyz"])
    answer = X.task_answer(F.col("task"), F.col("n_chars") % 2, F.col("n_chars") % 7, options, (F.col("n_chars") % 4).cast("int"))
    return d.select("doc_id", F.md5(X.task_question(F.col("task"), F.col("source"))).alias("question"), answer.alias("answer"))


@query("D2", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Yes|No' WHEN 1 THEN 'No|Yes' ELSE 'A. ' || lang || '|B. ' || source END AS options, CASE WHEN doc_id % 3 = 2 THEN chr((65 + n_chars % 2)::INTEGER) WHEN (doc_id % 3 + n_chars) % 2 = 0 THEN 'Yes' ELSE 'No' END AS answer FROM documents")
def yes_no_options(spark, sf):
    k = F.col("doc_id") % 3
    options = F.when(k == 0, F.array(F.lit("yes"), F.lit("no"))).when(k == 1, F.array(F.lit("no"), F.lit("yes"))).otherwise(F.array("lang", "source"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.yes_no_or_lettered(options), "|").alias("options"), X.yes_no_or_letter(options, (F.col("n_chars") % 2).cast("int")).alias("answer"))


@query("D8", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN (n_chars % 10)::VARCHAR ELSE chr((65 + n_chars % 4)::INTEGER) END AS answer FROM documents")
def typed_answers(spark, sf):
    k, letter = F.col("doc_id") % 3, F.char(F.lit(65) + F.col("n_chars") % 4)
    choices = F.when(k == 0, F.array(F.lit("Yes"), F.lit("No"))).when(k == 1, F.array(F.lit("1"), F.lit("22"))).otherwise(F.array(F.lit("A. x"), F.lit("B. y")))
    reply = F.when(k == 0, F.lit(" Yes ")).when(k == 1, F.concat(F.lit(" "), (F.col("n_chars") % 10).cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("The answer is ("), letter, F.lit(") because")))
    return table(spark, sf, "documents").select("doc_id", X.typed_answer(choices, reply).alias("answer"))


@query("D12", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, CASE WHEN doc_id % 3 = 0 THEN source END, left(text, 5)) AS said FROM documents")
def picked_predictions(spark, sf):
    a, b = F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    return table(spark, sf, "documents").select("doc_id", X.first_text(a, b, F.substring("text", 1, 5)).alias("said"))


_AB = "'A. ' || lang || chr(10) || 'B. ' || source"
_PAREN = "'(A) ' || lang || chr(10) || '(B) ' || source"


@query("D13 D14 L15", f"""SELECT doc_id, md5('Question: Q?' || chr(10) || 'Options:' || chr(10) || {_PAREN} || chr(10) || 'Only give the best option.') AS "default",
  md5('Q?' || chr(10) || {_AB} || chr(10) || chr(10) || 'Only give the best option.') AS streaming, md5('Q?' || chr(10) || {_AB}) AS compact,
  md5('{X.INSTRUCTION}' || chr(10) || chr(10) || 'Question: Q?' || chr(10) || chr(10) || 'Options:' || chr(10) || {_PAREN} || chr(10) || chr(10) || 'Please provide your answer as a single letter (A, B, C, or D).') AS instruction_rich,
  md5('Question: Q?' || chr(10) || 'Options:' || chr(10) || '1. ' || lang || chr(10) || '2. ' || source || chr(10) || 'Answer with the option number (1, 2, 3, or 4).') AS numbered FROM documents""")
def prompt_builders(spark, sf):
    choices = F.array("lang", "source")
    return table(spark, sf, "documents").select("doc_id", *[F.md5(build(F.lit("Q?"), choices)).alias(name) for name, build in X.PROMPTS.items()])


@query("D17", f"WITH {TURNS} SELECT conv_id, turn, printf('Time=%07.1f-%07.1fs', realtime, realtime + 2.5::DOUBLE) AS label FROM q")
def time_labels(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", T.time_label(F.col("realtime"), F.col("realtime") + 2.5).alias("label"))


@query("D24", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (props->>'$.k')::BIGINT END AS k FROM events")
def parsed_objects(spark, sf):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.replace(F.col("props"), F.lit('"'), F.lit("'"))).otherwise(F.lit("not {an object"))
    return table(spark, sf, "events").select("event_id", X.parsed_object(raw, "struct<k:bigint>")["k"].alias("k"))


@query("D29", 'SELECT doc_id AS "id", lang AS "meta/lang", source AS "meta/from/source", CASE WHEN doc_id % 2 = 0 THEN n_chars END AS "stats/n" FROM documents')
def flattened_records(spark, sf):
    n = F.when(F.col("doc_id") % 2 == 0, F.array("n_chars")).otherwise(F.array("n_chars", "n_chars"))
    nested = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.struct("lang", F.struct("source").alias("from")).alias("meta"), F.struct(X.scalars(n).alias("n")).alias("stats")
    )
    return nested.select(*X.flattened(nested.schema))


@query("I1 I2", f"WITH {TURNS}, w AS (SELECT conv_id, turn, lag(realtime, 1, 0) OVER (PARTITION BY conv_id ORDER BY realtime, turn) AS a, realtime AS b FROM q) SELECT conv_id, count(*) AS n, string_agg(a || '-' || b, ' ' ORDER BY b, turn) AS spans, string_agg('0.0-' || b, ' ' ORDER BY b, turn) AS from_start FROM w GROUP BY conv_id")
def nested_conversations(spark, sf):
    spans = turns(spark, sf).withColumns({"start_time": S.previous_end(["conv_id"], ["realtime", "turn"], "realtime"), "end_time": F.col("realtime")})
    nested = S.nest(spans.select("conv_id", "turn", "start_time", "end_time"), ["conv_id"], "end_time", ["turn", "start_time"], "conversations")
    line = lambda a: F.array_join(F.transform("conversations", lambda x: F.concat(a(x).cast("string"), F.lit("-"), x["end_time"].cast("string"))), " ")
    return nested.select("conv_id", F.size("conversations").cast("long").alias("n"), line(lambda x: x["start_time"]).alias("spans"), line(lambda x: F.lit(0.0)).alias("from_start"))
