"""Queries over column functions and nested data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.functions import timeline as T

from .registry import query
from .tables import TURNS, table, turns


def _choices():
    """Four options from a document's id."""
    return F.array(*[F.concat(F.lit(f"{c}. "), F.lit("opt"), (F.pmod("doc_id", F.lit(k)) + k).cast("string")) for c, k in zip("ABCD", (3, 5, 7, 11), strict=True)])


_BARE = "['opt' || (doc_id % 3 + 3), 'opt' || (doc_id % 5 + 5), 'opt' || (doc_id % 7 + 7), 'opt' || (doc_id % 11 + 11)]"


@query("D1 D2 D3", f"SELECT doc_id, array_to_string({_BARE}, '|') AS bare, array_to_string(list_transform({_BARE}, lambda x, i: chr((64 + i)::INTEGER) || '. ' || x), '|') AS lettered, 'x' || doc_id AS cleaned FROM documents")
def option_prefixes(spark, sf):
    bare = X.strip_option_prefix(_choices())
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(bare, "|").alias("bare"), F.array_join(X.add_option_prefix(bare), "|").alias("lettered"), X.after_colon_paren(F.concat(F.lit("(A):x"), F.col("doc_id").cast("string"))).alias("cleaned")
    )


@query("D4 D5", f"SELECT doc_id, coalesce(({_BARE})[doc_id % 6 + 1], '') AS chosen, CASE WHEN list_position({_BARE}, 'opt7') > 0 THEN chr((64 + list_position({_BARE}, 'opt7'))::INTEGER) END AS letter FROM documents")
def letters_and_texts(spark, sf):
    bare = X.strip_option_prefix(_choices())
    return table(spark, sf, "documents").select(
        "doc_id", X.letter_to_text(bare, F.char(F.lit(65) + F.pmod("doc_id", F.lit(6)))).alias("chosen"), X.text_to_letter(bare, F.lit("opt7")).alias("letter")
    )


@query("D6 D7", "SELECT doc_id, CASE WHEN length(text) = 0 THEN NULL WHEN strpos(text, ')') > 1 THEN substr(text, strpos(text, ')') - 1, 1) WHEN strpos(text, ')') = 1 THEN '' ELSE substr(text, 1, 1) END AS choice, regexp_extract(text, '[ABCD]') AS letter FROM documents")
def extract_answers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.extract_choice(F.col("text")).alias("choice"), X.extract_option_letter(F.concat(F.lit("The answer is "), F.col("text"))).alias("letter"))


@query("D9", "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'yes' WHEN turn % 4 = 1 THEN 'yes' WHEN turn % 4 = 2 THEN 'no' ELSE 'maybe' END AS said FROM conversations")
def binary_labels(spark, sf):
    k = F.col("turn") % 4
    raw = F.when(k == 0, "Yes, it is.").when(k == 1, " (yes) ").when(k == 2, "Nothing").otherwise("maybe")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.normalize_binary(raw).alias("said"))


@query("D10 D11", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(url, '([^/.]*)[^/]*$', 1) AS stem FROM pages")
def url_stems(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.basename(F.col("url")).alias("base"), X.stem(F.col("url")).alias("stem"))


@query("D10", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS digest FROM documents")
def squashed_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.squash(F.col("text"))).alias("digest"))


@query("D13 D14 L15", f"SELECT doc_id, 'Q?' || chr(10) || array_to_string(list_transform({_BARE}, lambda x, i: chr((64 + i)::INTEGER) || '. ' || x), chr(10)) AS compact, 'Question: Q?' || chr(10) || 'Options:' || chr(10) || array_to_string(list_transform({_BARE}, lambda x, i: i || '. ' || x), chr(10)) || chr(10) || 'Answer with the option number (1, 2, 3, or 4).' AS numbered FROM documents")
def prompts(spark, sf):
    bare = X.strip_option_prefix(_choices())
    return table(spark, sf, "documents").select("doc_id", X.PROMPTS["compact"](F.lit("Q?"), bare).alias("compact"), X.PROMPTS["numbered"](F.lit("Q?"), bare).alias("numbered"))


@query("D15 D16", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || chr(10) || source WHEN doc_id % 3 = 1 THEN lang ELSE source END AS context FROM documents")
def context_texts(spark, sf):
    k = F.col("doc_id") % 3
    return table(spark, sf, "documents").select("doc_id", X.context_text(F.when(k != 2, F.col("lang")).otherwise(" "), F.when(k != 1, F.col("source"))).alias("context"))


@query("D18", "SELECT doc_id, (doc_id % 24 * 3600 + doc_id % 60 * 60 + doc_id % 59)::DOUBLE AS seconds FROM documents")
def hms_seconds(spark, sf):
    clock = F.format_string("%02d:%02d:%02d", F.col("doc_id") % 24, F.col("doc_id") % 60, F.col("doc_id") % 59)
    return table(spark, sf, "documents").select("doc_id", T.clock_to_seconds(clock).alias("seconds"))


@query("D17 D19 D20 D21 D40", f"WITH {TURNS} SELECT conv_id, turn, (floor(realtime * 2) / 2)::DOUBLE AS lo, least(ceil((realtime + 0.7) * 2) / 2, 100)::DOUBLE AS hi, greatest(least(floor(realtime * 2), 39), 0)::BIGINT AS first_frame, floor(realtime * 3)::INTEGER AS frame FROM q")
def frame_grid(spark, sf):
    r = F.col("realtime")
    frames = T.window_frames(r, r + 0.7, 2.0, F.lit(40))
    return turns(spark, sf).select(
        "conv_id", "turn", T.floor_to_grid(r, 2.0, F.lit(0.0), F.lit(1e9)).alias("lo"), T.ceil_to_grid(r + 0.7, 2.0, F.lit(0.0), F.lit(100.0)).alias("hi"), F.element_at(frames, 1).alias("first_frame"), T.frame_of(r, 3.0, F.lit(0)).alias("frame")
    )


@query("D22 D23", "SELECT doc_id, greatest(n_chars - 30.5, 0)::DOUBLE * 0.25::DOUBLE AS q25, greatest(n_chars - 30.5, 0)::DOUBLE AS tail, least(n_chars, CASE WHEN doc_id = 332 THEN 200 ELSE 1500 END) AS capped FROM documents")
def shifted_windows(spark, sf):
    n = F.col("n_chars").cast("double")
    return table(spark, sf, "documents").select(
        "doc_id", T.shift_window(F.lit(10.0), F.lit(40.5), n, "q25").alias("q25"), T.shift_window(F.lit(10.0), F.lit(40.5), n, "tail").alias("tail"), F.least("n_chars", F.when(F.col("doc_id") == 332, 200).otherwise(1500)).alias("capped")
    )


@query("D24 D29 M8", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def nested_json(spark, sf):
    literal = F.replace(F.col("props"), F.lit('"'), F.lit("'"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(X.literal_to_json(literal), "$.k").cast("long").alias("k"))


@query("D25 E5", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'YES' ELSE 'NO' END AS result, CASE WHEN doc_id % 2 = 0 THEN source END AS query FROM documents")
def llm_verdict(spark, sf):
    reply = F.format_string('ok ```json\n{"result": "%s", "query": "%s"}\n``` done', F.when(F.col("doc_id") % 2 == 0, "YES").otherwise("NO"), "source")
    x = F.from_json(X.fenced_json(reply), "result string, query string")
    return table(spark, sf, "documents").select("doc_id", x["result"].alias("result"), F.when(x["result"] == "YES", x["query"]).alias("query"))


@query("D26", "SELECT page_id, replace(url, 'http://', '/data/') AS path FROM pages WHERE starts_with(url, 'http://')")
def rebased_paths(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").startswith("http://")).select("page_id", X.path_rebase(F.col("url"), "http://", "/data/").alias("path"))


@query("D27 J18")
def truncated_repeats(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.drop_repeats(F.col("text")).alias("text"))


@query("D28 D33", "SELECT doc_id, replace(source || '.', '.', '') AS label, lang || ' ' || source || '...' AS joined FROM documents")
def cleaned_responses(spark, sf):
    parts = F.array(F.concat("lang", F.lit(" ...")), F.lit(" ..."), F.concat("source", F.lit(" ...")))
    return table(spark, sf, "documents").select("doc_id", F.replace(F.concat("source", F.lit(".")), F.lit("."), F.lit("")).alias("label"), X.join_streamed(parts).alias("joined"))


@query("D30", "SELECT vec_id, array_to_string(list_concat(list_transform(range(0, vec_id % 6), lambda i: i), [-1, -1, -1, -1])[1:4], ',') AS padded FROM embeddings")
def padded_arrays(spark, sf):
    k = F.pmod("vec_id", F.lit(6))
    a = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(X.pad_to(a, 4, F.lit(-1).cast("long")), ",").alias("padded"))


@query("D31 D36 M11", "SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS rendered FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY conv_id")
def rendered_turns(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role").isin("user", "assistant", "system"))
    t = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return t.select("conv_id", F.array_join(F.transform("turns", lambda x: F.concat(F.upper(x["role"]), F.lit(": "), x["text"])), "\n").alias("rendered"))


@query("D39", "WITH c AS (SELECT doc_id, w, h, least(w, doc_id % 900 + 1) * least(h, n_chars % 900 + 1) AS eff, w * h - least(w, doc_id % 900 + 1) * least(h, n_chars % 900 + 1) AS waste, k FROM documents, (VALUES (336, 672, 0), (672, 336, 1), (672, 672, 2), (1008, 336, 3)) t(w, h, k)) SELECT doc_id, arg_max(k, eff * 100000000 - waste * 10 - k) AS best FROM c GROUP BY doc_id")
def best_fit(spark, sf):
    options = spark.createDataFrame([(336, 672, 0), (672, 336, 1), (672, 672, 2), (1008, 336, 3)], "w long, h long, k int")
    eff = F.least("w", F.col("doc_id") % 900 + 1) * F.least("h", F.col("n_chars") % 900 + 1)
    d = table(spark, sf, "documents").select("doc_id", "n_chars").crossJoin(F.broadcast(options)).withColumn("eff", eff)  # four candidates
    return d.groupBy("doc_id").agg(F.max_by("k", F.struct("eff", (F.col("eff") - F.col("w") * F.col("h")).alias("spare"), (-F.col("k")).alias("first"))).alias("best"))


@query("A15", "SELECT event_id, props->>'$.k' AS k FROM events")
def key_extraction(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
