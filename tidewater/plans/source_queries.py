"""Sinks and sources: a given table is written in a format, read back, and compared with itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.sources import files as S
from tidewater.sources.scratch import new_folder

from .registry import query
from .tables import table

_TURN = "conv_id long, turn int, role string, text string"


def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")


_ROWS = "SELECT conv_id, turn::INTEGER AS turn, role, text FROM conversations"


@query("A1", _ROWS)
def json_array_files(spark, sf):
    path = new_folder(spark, "arrays")
    S.write_json_arrays(_turns(spark, sf), path, 3)
    return S.read_json_array(spark, path, _TURN)


@query("A2 B3 B7", _ROWS)
def jsonl_files(spark, sf):
    path = new_folder(spark, "lines")
    S.write_jsonl(_turns(spark, sf), path, 1000)
    return S.read_jsonl(spark, path, _TURN)


@query("A3", _ROWS)
def jsonl_files_with_index(spark, sf):
    path = new_folder(spark, "indexed")
    S.write_jsonl_indexed(_turns(spark, sf), path, 4)
    return S.read_jsonl_indexed(spark, path, _TURN)


@query("A4", _ROWS)
def jsonl_files_encoded_twice(spark, sf):
    path, t = new_folder(spark, "twice"), _turns(spark, sf)
    line = F.to_json(F.struct(*t.columns))
    quoted = F.regexp_extract(F.to_json(F.struct(line.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    t.select(F.when(F.pmod("conv_id", F.lit(2)) == 0, line).otherwise(quoted).alias("value")).write.text(path)
    return S.read_jsonl_double(spark, path, _TURN)


@query("A6", f"{_ROWS} UNION ALL {_ROWS} UNION ALL {_ROWS} UNION ALL {_ROWS}")
def files_by_extension(spark, sf):
    path, t = new_folder(spark, "kinds"), _turns(spark, sf)
    S.write_jsonl_indexed(t, f"{path}/a.jsonl", 2)
    S.write_json_arrays(t, f"{path}/b.json", 2)
    t.write.parquet(f"{path}/c.parquet")
    t.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue='""').csv(f"{path}/d.csv")
    a, b, c, d = (S.read_by_extension(spark, f"{path}/{n}", _TURN) for n in ("a.jsonl", "b.json", "c.parquet", "d.csv"))
    return a.unionByName(b).unionByName(c).unionByName(d)


@query("A7 A8 D24", "SELECT doc_id, lang, [source, lang, 'x y'] AS choices FROM documents")
def csv_with_list_literals(spark, sf):
    path, d = new_folder(spark, "csv"), table(spark, sf, "documents")
    literal = F.concat(F.lit("['"), F.concat_ws("', '", "source", "lang", F.lit("x y")), F.lit("']"))
    d.select("doc_id", "lang", literal.alias("choices")).write.options(header=True, escape='"').csv(path)
    return S.read_csv(spark, path, "doc_id long, lang string, choices string").withColumn("choices", S.parse_list("choices"))


@query("A10", "SELECT conv_id::VARCHAR AS grp, turn::VARCHAR AS name, any_value(role) AS role, any_value(length(text))::BIGINT AS n FROM conversations GROUP BY conv_id, turn HAVING count(*) = 1")
def dict_of_dicts(spark, sf):
    """A file of one object per conversation, its turns as named records."""
    path, t = new_folder(spark, "dicts"), table(spark, sf, "conversations")
    once = t.groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.first(F.length("text")).cast("long").alias("n"), F.count("*").alias("c")).where("c = 1")
    record = F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), F.struct("role", "n"))))
    objects = once.groupBy("conv_id").agg(record.alias("turns")).select(F.concat("conv_id", F.lit(".json")).alias("name"), F.to_json(F.create_map(F.col("conv_id").cast("string"), "turns")).alias("value"))
    S.write_named(objects, path, "name", "value").agg(F.sum("size")).collect()
    return S.read_dict_of_dicts(spark, path, "struct<role string, n long>")


@query("A11 A12", "SELECT conv_id, turn::INTEGER AS turn, role, text, CASE WHEN conv_id % 3 = 0 THEN 'interleave' ELSE 'part' || conv_id END AS split FROM conversations WHERE conv_id % 5 <> 4")
def folder_with_broken_files(spark, sf):
    """A file per conversation; some are cut off and some have another suffix, and those are left out."""
    path, t = new_folder(spark, "folder"), _turns(spark, sf)
    stem = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.concat(F.lit("mix"), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("part"), F.col("conv_id").cast("string")))
    whole = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*t.columns))), ","), F.lit("]"))
    own = t.groupBy("conv_id").agg(whole.alias("value")).withColumn("name", F.concat(stem, F.lit(".json")))
    broken = F.pmod("conv_id", F.lit(10)) == 4
    other = F.pmod("conv_id", F.lit(10)) == 9
    own = own.withColumns({"value": F.when(broken, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")), "name": F.when(other, F.concat("name", F.lit(".bak"))).otherwise(F.col("name"))})
    S.write_named(own, path, "name", "value").agg(F.sum("size")).collect()
    return S.read_folder(spark, path, _TURN)


@query("B1 B2", "SELECT doc_id, lang, n_chars::BIGINT AS n_chars, 4 AS num_chunks, (doc_id % 4)::INTEGER AS chunk_idx FROM documents")
def csv_shards(spark, sf):
    path, d = new_folder(spark, "shards"), table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    for chunk in range(4):
        S.write_shards(d.where(F.pmod("doc_id", F.lit(4)) == chunk), path, num_chunks=4, chunk_idx=chunk)
    return S.read_csv(spark, path, "doc_id long, lang string, n_chars long, num_chunks int, chunk_idx int")


@query("B6", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS part FROM documents")
def parts_of_hundred(spark, sf):
    """Written in two runs, of which the second finds the first one's parts."""
    path, d = new_folder(spark, "parts"), table(spark, sf, "documents").select("doc_id")
    S.write_every(d, path, "doc_id", 100)
    S.write_every(d, path, "doc_id", 100)
    return spark.read.schema("doc_id long, part long").parquet(path)


@query("B8", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, count(*) AS n_csv FROM documents GROUP BY lang")
def metric_files(spark, sf):
    path, d = new_folder(spark, "metrics"), table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    S.write_metrics(d.groupBy("lang").agg(F.count("*").alias("n")), d, path)
    detail = spark.read.schema("doc_id long, lang string, n_chars long").json(f"{path}/detail").groupBy("lang").agg(F.sum("n_chars").alias("n_chars"))
    csv = S.read_csv(spark, f"{path}/detail_csv", "doc_id long, lang string, n_chars long").groupBy("lang").agg(F.count("*").alias("n_csv"))
    return spark.read.schema("lang string, n long").json(f"{path}/metrics").join(detail, "lang").join(csv, "lang").select("lang", "n", "n_chars", "n_csv")


@query("L13 L10", """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT epoch_us(start) AS start_us, n FROM w, m WHERE start + INTERVAL 6 HOUR <= mark""")
def closed_windows(spark, sf):
    """A stream with a watermark of a day: windows are handed over once it has passed their end."""
    from tidewater.streaming import state as St

    path = new_folder(spark, "closed")
    table(spark, sf, "events").select("ts", "value").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    counts = St.tumbling(St.late_safe(stream, "1 day"), "6 hours")
    run = counts.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/out").select(F.unix_micros("start").alias("start_us"), "n")


@query("A5 B4", "SELECT doc_id - (SELECT min(doc_id) FROM documents) AS line_no, sha256(text) AS digest FROM documents WHERE doc_id - (SELECT min(doc_id) FROM documents) BETWEEN 0 AND 1000000000")
def records_by_offset(spark, sf):
    """All documents in files with an index of offsets, read by seeking."""
    from tidewater.sources import offsets

    path = new_folder(spark, "records")
    offsets.write_records(table(spark, sf, "documents"), "text", "doc_id", _uri(path))
    return offsets.read_records(spark, _uri(path)).where("line_no BETWEEN 0 AND 1000000000").select("line_no", F.sha2("value", 256).alias("digest"))


@query("A19", "SELECT page_id, sha256(coalesce(html, '')) AS digest FROM pages")
def images_by_offset(spark, sf):
    """Pages stand for images that lie end to end in files; each is read by file, offset and length."""
    from tidewater.sources import offsets

    path = new_folder(spark, "images")
    index = offsets.write_records(table(spark, sf, "pages"), "html", "page_id", _uri(path), separator=b"")
    return offsets.read_ranges(index.select("page_id", "file", "offset", "length"), _uri(path)).select("page_id", F.sha2("value", 256).alias("digest"))


def _uri(path):
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


_SOUND = """c AS (SELECT label, vec_id, list_transform(range(32), lambda i: (embedding[2 * i + 1]::DOUBLE + embedding[2 * i + 2]::DOUBLE) / 2) AS x FROM embeddings),
p AS (SELECT label, max(list_max(list_transform(x, lambda v: abs(v)))) AS peak FROM c GROUP BY label),
s AS (SELECT c.label, vec_id, list_transform(x, lambda v: v / peak) AS x FROM c JOIN p USING (label))"""


def _sound(spark, sf):
    """Vectors as chunks of 32 stereo frames, labels as streams."""
    from tidewater.operators import audio

    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").alias("x"))
    return audio.peak_normalised(audio.mono(e, "x", 2), ["label"], "x")


@query("A18", f"WITH {_SOUND} SELECT label, vec_id, list_transform(x, lambda v: round(v, 6)) AS x FROM s")
def sound_chunks(spark, sf):
    from tidewater.operators.audio import rounded

    return _sound(spark, sf).withColumn("x", F.transform("x", lambda v: rounded(v, 6)))


@query("A18", f"""WITH {_SOUND}, n AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 32 AS base, x FROM s), v AS (SELECT label, base + i AS i, x[i + 1] AS v FROM n, range(32) t(i)),
q AS (SELECT label, vec_id, (vec_id % 50) * 0.7::DOUBLE AS a, (vec_id % 50) * 0.7::DOUBLE + 1 + vec_id % 7 AS b FROM embeddings)
SELECT q.label, q.vec_id, count(*) AS n, round(sum(v), 6) AS total, round(arg_min(v, i), 6) AS first FROM q JOIN v ON v.label = q.label AND i >= floor(a * 50) AND i < floor(b * 50) GROUP BY ALL""")
def sound_slices(spark, sf):
    """A span of some seconds for each vector, at 50 samples a second; spans cross the borders of chunks."""
    from tidewater.operators import audio

    start = (F.pmod("vec_id", F.lit(50)) * 0.7).cast("double")
    spans = table(spark, sf, "embeddings").select("label", "vec_id", start.alias("start"), (start + 1 + F.pmod("vec_id", F.lit(7))).alias("end"))
    got = audio.sliced(_sound(spark, sf).withColumnRenamed("vec_id", "chunk"), ["label"], "chunk", "x", spans, 50.0, "vec_id")
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return got.select("label", "vec_id", F.size("x").cast("long").alias("n"), audio.rounded(total, 6).alias("total"), audio.rounded(F.get("x", F.lit(0)), 6).alias("first"))


@query("L18 C7", """WITH r AS (SELECT doc_id, length(text) AS n FROM documents) SELECT doc_id, doc_id AS used, n AS result FROM r WHERE n % 5 <> 0""")
def model_with_retries(spark, sf):
    """A model that fails on some texts: the rows that needed no other row in their place."""
    from .seams import apply_with_retries

    def model(row):
        if len(row["text"]) % 5 == 0:
            raise ValueError("unreadable")
        return len(row["text"])

    results, _ = apply_with_retries(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", model, "long", tries=20)
    return results.where("used = doc_id")
