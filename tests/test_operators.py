"""Hand-computed cases of single operators."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.functions import timeline as T
from tidewater.functions import vectors as V
from tidewater.operators import joins as J
from tidewater.operators import metrics as M
from tidewater.operators import numeric as N
from tidewater.operators import retrieval as R
from tidewater.operators import scans as Sc
from tidewater.operators import sequences as S
from tidewater.sources import files, schemas
from tidewater.streaming import state as St


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def strings(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_binary_labels(spark):
    said = {"Yes, it is.": "yes", "(yes)": "yes", "Nothing": "no", "maybe": "maybe"}
    for raw, want in said.items():
        assert value(spark, X.normalize_binary(F.lit(raw))) == want
    assert value(spark, X.normalize_binary(F.lit(None).cast("string"))) == ""


def test_extractors(spark):
    assert [value(spark, X.extract_choice(F.lit(x))) for x in ("Best (B) x", "C", ")")] == ["B", "C", ""]
    assert value(spark, X.extract_option_letter(F.lit("The answer is B."))) == "B"
    assert value(spark, X.squash(F.lit("  A  b\tC "))) == "a b c"
    assert value(spark, X.drop_repeats(F.lit("a b b c"))) == "a b"
    assert value(spark, X.drop_repeats(F.lit("a b a c"))) == "a b c"
    assert value(spark, X.typed_answer(strings("Yes", "No"), F.lit(" YES "))) == "yes"
    assert value(spark, X.literal_to_json(F.lit("{'a': None, 'b': True}"))) == '{"a": null, "b": true}'


def test_prompts(spark):
    for build in X.PROMPTS.values():
        assert "opt2" in value(spark, build(F.lit("Q?"), strings("opt1", "opt2")))
    assert value(spark, X.prompt_streaming(F.lit("Q?"), F.array().cast("array<string>"))).endswith("Answer:")


def test_clock_and_frames(spark):
    assert value(spark, T.clock_to_seconds(F.lit("00:01:05"))) == 65
    assert value(spark, T.uniform_positions(F.lit(12), 3)) == [0, 5, 11]
    assert value(spark, T.uniform_positions(F.lit(12), 3, rounded=True)) == [0, 6, 11]
    assert value(spark, T.window_frames(F.lit(1.2), F.lit(1.3), 1.0, F.lit(10))) == [1]
    assert value(spark, T.time_label(F.lit(1.5), F.lit(2.25))).startswith("Time=00001.5-")
    moved = [value(spark, T.moved_position(F.lit(i), F.lit(2), F.lit(4), F.lit(5))) for i in range(8)]
    assert sorted(moved) == list(range(8)) and moved[2:4] == [3, 4]


def test_entropy_and_dynamic_k(spark):
    assert value(spark, V.softmax_entropy(F.array(*[F.lit(1.0)] * 10))) == pytest.approx(1.0, abs=1e-6)
    assert value(spark, V.softmax_entropy(F.array(F.lit(100.0), *[F.lit(0.0)] * 9))) == pytest.approx(0.0, abs=1e-6)
    assert [value(spark, V.dynamic_k(64, F.lit(h), 64)) for h in (0.0, 1.0)] == [32, 18]


def test_gae(spark):
    got = value(spark, V.gae(F.array(*map(F.lit, (0.0, 0.0, 1.0))), F.array(*[F.lit(0.5)] * 3), 1.0, 0.95))
    assert got == pytest.approx([0.45125, 0.475, 0.5])


def test_window_prf(spark):
    w = spark.createDataFrame([(1, 1.5, 3.2)], "k long, start double, end double")
    s = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "k long, sec long")
    r = R.window_overlap(w, s, ["k"]).first()
    assert (r.overlap, round(r.recall, 6), round(r.precision, 6), round(r.f1, 6)) == (pytest.approx(1.5), 0.882353, 0.5, 0.638298)


def test_chunked_top_k(spark):
    def ids(scores, k, chunk):
        df = spark.createDataFrame(list(enumerate(map(float, scores))), "vec_id long, score double")
        return sorted(r.vec_id for r in R.chunked_top_k(df, k, chunk).collect())

    assert ids([5, 1, 4, 4, 0, 9, 3], 4, 2) == [2, 3, 4, 5]
    assert ids([1, 1, 0, 0, 9], 2, 2) == [4]


def test_votes(spark):
    hits = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 2, 1.0), (2, 3, 1.0)], "layer long, vec_id long, weight double")
    votes = R.layer_votes(hits, 0)
    assert {r.vec_id: r.votes for r in votes.collect()} == {1: 1, 2: 3, 3: 2}
    assert {r.vec_id for r in R.recent_and_best(votes, 0, 0, 2).collect()} == {2, 3}


def words(spark, ends, least, most=10.0, gap=3.0):
    df = spark.createDataFrame([("v", i, e - 1.0, float(e), f"w{i}") for i, e in enumerate(ends)], "video string, pos long, start double, end double, word string")
    return [(r.first, r.n) for r in Sc.cut_clips(df, "video", least=least, most=most, gap=gap).orderBy("clip").collect()]


def test_clips(spark):
    assert words(spark, [1, 2, 3, 4, 10, 11], 3) == [(0, 4)]
    assert words(spark, [1, 2, 3, 4], 2) == [(0, 3)]
    assert words(spark, [1], 0) == []


def test_explode_words(spark):
    df = spark.createDataFrame([(0.0, 2.0, "go go on"), (2.0, 3.0, "[Music]")], "a double, b double, text string")
    got = [(r.word_start, r.word_end, r.word) for r in S.explode_words(df, "text", F.col("a"), F.col("b")).orderBy("pos").collect()]
    assert got == [(0.0, 1.0, "go"), (1.0, 2.0, "on")]


def test_splits(spark):
    for n, want in ((10, {0: 3, 1: 3, 2: 3, 3: 1}), (9, {0: 3, 1: 3, 2: 3})):
        assert {r.part: r["count"] for r in S.contiguous_parts(spark.range(n), "id", 4).groupBy("part").count().collect()} == want


def test_bins_and_shares(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.3, 0.5, 1.0)], "x double")
    assert [r.b for r in df.orderBy("x").select(M.right_closed_bin(F.col("x"), [0, 0.1, 0.3, 0.5, 1]).alias("b")).collect()] == [None, "0-0.1", "0.1-0.3", "0.3-0.5", "0.5-1"]
    t = spark.createDataFrame([("A", 100.0), ("A", 0.0), ("B", 100.0)], "task string, m double")
    assert {r.task: round(r.share, 2) for r in M.task_share(t, "task", "m").collect()} == {"A": 33.33, "B": 33.33}
    j = spark.createDataFrame([("M", "M"), ("M", "G"), ("tie", "G")], "ab string, ba string")
    assert M.win_rate(j, "ab", "ba", "M").first().win_rate == 0.5


def test_joins(spark):
    left = spark.createDataFrame([(1, "Ab"), (2, "zz")], "id long, q string")
    right = spark.createDataFrame([("ab", "hit")], "k string, v string")
    got = {r.id: r.v for r in J.priority_lookup(left, right, [(F.col("q"), F.col("k")), (F.lower("q"), F.lower("k"))], "v").collect()}
    assert got == {1: "hit", 2: ""}
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1.0, 0.0, 11.0, 10.0), (1, 1, 50.0, 0.0, 60.0, 10.0)], "video long, frame long, x1 double, y1 double, x2 double, y2 double")
    assert J.track_boxes(boxes, "video").count() == 2
    scored = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1.0, 0.0, 11.0, 10.0, 0.8)], "video long, x1 double, y1 double, x2 double, y2 double, score double")
    assert J.suppress_overlaps(scored, "video").count() == 1


def test_nucleus(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate((0.5, 0.3, 0.2))], "k long, i long, p double")
    assert N.nucleus(df, ["k"], "p", "i", 0.6).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n[0, 9]\n')
    assert files.read_jsonl_indexed(spark, str(tmp_path / "a.jsonl"), "a long").count() == 2
    (tmp_path / "b.jsonl").write_text('"{\\"a\\": 5}"\n{"a": 6}\n')
    assert {r.a for r in files.read_jsonl_double(spark, str(tmp_path / "b.jsonl"), "a long").collect()} == {5, 6}
    (tmp_path / "c.json").write_text('{"g": {"x": {"q": "1"}, "y": {"q": "2"}}}')
    assert files.read_dict_of_dicts(spark, str(tmp_path / "c.json"), "struct<q: string>").count() == 2
    (tmp_path / "v.json").write_text('[{"video_id": "v", "duration": 2.5, "conversations": [{"question": "q", "choices": ["a"]}]}]')
    assert files.read_json_array(spark, str(tmp_path / "v.json"), schemas.VIDEO_SAMPLE).first().conversations[0].choices == ["a"]
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "mixed.json").write_text('[{"a": 1}]')
    (folder / "other.json").write_text('[{"a": 2}]')
    assert {r.split for r in files.read_folder(spark, str(folder), "a long").collect()} == {"interleave", "other"}
    (tmp_path / "s.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHello\n\n2\n00:00:03,000 --> 00:00:04,000\nthere\n")
    assert files.read_subtitles(spark, str(tmp_path / "s.srt")).first().text == "Hello there"


def test_sinks_resume(spark, tmp_path):
    df = spark.range(5)
    assert [files.write_pending(df, str(tmp_path / "out"), ["id"]), files.write_pending(spark.range(7), str(tmp_path / "out"), ["id"])] == [5, 2]
    files.write_shards(df, str(tmp_path / "csv"), retrieve_size=64)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    src = tmp_path / "in"
    for k in range(2):  # two files, in time order per key
        half = events.orderBy("ts", "event_id").limit(400) if k == 0 else events.join(events.orderBy("ts", "event_id").limit(400), "event_id", "left_anti")
        half.select(*events.columns).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(src))
    q = St.blocks_stream(stream, "user_id", "value", 8).writeStream.format("memory").queryName("blocks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = sorted((r.user_id, r.block, r.n, r.total) for r in spark.sql("select * from blocks").collect())
    want = sorted((r.user_id, r.block, r.n, r.total) for r in St.blocks_batch(events, "user_id", ["ts", "event_id"], "value", 8).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-3)


def test_shuffle_is_a_bijection(spark):
    df = spark.createDataFrame([Row(k=1, i=i) for i in range(50)])
    pos = sorted(r.p for r in df.withColumn("h", S.seeded_order(3, "k", "i")).select(S.ordinal(["k"], ["h", "i"]).alias("p")).collect())
    assert pos == list(range(50))


def test_windowed_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = St.late_safe(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 day")
    q = St.tumbling(stream, "6 hours", "event_type").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.sql("select * from windows").collect())) == sorted(map(key, St.tumbling(St.late_safe(events, "1 day"), "6 hours", "event_type").collect()))


def test_asof_forward(spark):
    ticks = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.5), (2, 0.0)], "k long, tick double")
    points = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k long, p double")
    got = {(r.k, r.tick): r.p for r in S.first_at_or_after(ticks, points, ["k"], "tick", "p").collect()}
    assert got == {(1, 0.0): 1.0, (1, 1.0): 1.0, (1, 2.5): None, (2, 0.0): None}


def test_frame_segments(spark):
    df = spark.createDataFrame([(1, i) for i in range(6)], "k long, i long")
    assert [r.segment for r in St.segments(df, "k", ["i"], 2, 2).orderBy("i").collect()] == ["init", "init", "global", "global", "local", "local"]
    assert St.sink_and_window(df, "k", ["i"], 2, 2).count() == 4


def test_adaptive_controller_and_whitening(spark):
    assert value(spark, N.adaptive_kl(F.array(F.lit(12.0)), 0.2, 6.0, 100.0, 10)) == pytest.approx(0.2 * 1.02)
    assert value(spark, N.preference_loss(F.lit(2.0), F.lit(1.0), 0.1, "hinge")) == pytest.approx(0.9)
