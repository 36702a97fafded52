"""Operators and queries that no SQL states, against plain loops; streams against their batch twins; guards."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewater.operators import joins as J
from tidewater.operators import metrics as M
from tidewater.operators import numeric as N
from tidewater.operators import retrieval as R
from tidewater.operators import sequences as S
from tidewater.operators import turns as U
from tidewater.plans import benchmark_queries as B
from tidewater.plans import registry
from tidewater.sources import files
from tidewater.streaming import state as St

#: Queries without SQL, each of which a test here or in ``test_whole_jobs`` holds against a plain version.
TESTED = {
    "truncated_repeats", "track_faces", "suppressed_boxes", "clip_cut", "clip_cut_sentences", "driver_etbench", "driver_etbench_layered",
}


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_every_query_is_tested():
    assert set(registry.queries()) - set(registry.oracle_sql()) == TESTED


def test_truncated_repeats(spark, sf):
    def plain(text):
        out = []
        for w in text.split(" "):
            if w not in out:
                out.append(w)
            elif w == out[-1]:
                break
        return " ".join(out)

    want = {(r.conv_id, r.turn): plain(r.text) for r in read(spark, sf, "conversations").collect()}
    assert {(r.conv_id, r.turn): r.text for r in entry.queries()["truncated_repeats"](spark, sf).collect()} == want


def _plain_clips(words, least, most, gap, by, sentences):
    """words: (start, end, word) of one transcript."""
    out, i, n = [], 0, len(words)
    at = [w[0] if by == "start" else w[1] for w in words]
    while i < n:
        if sentences and i > 0 and not (words[i - 1][2][-1:] in (".", "?", "!") and words[i][2].isupper()):
            i += 1
            continue
        stop = next((j for j in range(i + 1, n - 1) if at[j] - at[i] > most or at[j] - at[j - 1] > gap), max(n - 1, i + 1))
        if stop >= n and i + 1 >= n:
            break
        if at[stop - 1] - at[i] >= least:
            out.append((len(out), i, stop - i, words[i][0], words[stop - 1][1], " ".join(w[2] for w in words[:i])))
        i = stop
    return out


@pytest.mark.parametrize("name, options", [("clip_cut", (30, 240, 2.6, "end", False)), ("clip_cut_sentences", (10, 240, 3.2, "start", True))])
def test_clips_of_all_documents(spark, sf, name, options):
    want = []
    for r in read(spark, sf, "documents").select("doc_id", "text").collect():
        words = []
        for pos, w in enumerate(r.text.split(" ")):
            start = (pos * 7 + r.doc_id) % 5 * 0.25 + pos * 2.0
            words.append((start, start + 0.5, w))
        want += [(r.doc_id, *c) for c in _plain_clips(words, *options)]
    got = [(r.video, r.clip, r.first, r.n, r.start, r.end, r.previous) for r in entry.queries()[name](spark, sf).collect()]
    assert sorted(got) == sorted(want) and got


def test_tracks_equal_plain_loops(spark):
    rnd = random.Random(5)
    rows = [(v, f, rnd.uniform(0, 6), rnd.uniform(0, 3)) for v in range(4) for f in range(25) if f % 9 for _ in range(rnd.randint(1, 4))]
    rows = [(v, f, x, y, x + 10, y + 10) for v, f, x, y in rows]

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(w, 0) * max(h, 0)
        return inter / (200 - inter)

    want = []
    for v in range(4):
        tracks, live = [], []
        for f in range(25):
            boxes = sorted(r[2:] for r in rows if r[0] == v and r[1] == f)
            if not boxes:
                live = []
                continue
            held = {}  # track -> box of this frame
            old = list(live)
            for b in boxes:
                scores = [iou(tracks[t][-1][1] if t not in held else tracks[t][-2][1], b) for t in old]
                best = max(range(len(old)), key=lambda k: (scores[k], -k), default=None)
                if best is not None and scores[best] > 0.7:
                    t = old[best]
                    if t not in held:
                        tracks[t].append((f, b))
                        held[t] = scores[best]
                    elif scores[best] > held[t]:
                        tracks[t][-1] = (f, b)
                        held[t] = scores[best]
                else:
                    tracks.append([(f, b)])
                    held[len(tracks) - 1] = 2.0
            live = list(held)
        for k, t in enumerate(x for x in tracks if len(x) >= 2):
            want += [(v, f, *b) for f, b in t]
    df = spark.createDataFrame(rows, "video long, frame long, x1 double, y1 double, x2 double, y2 double")
    got = [(r.video, r.frame, r.x1, r.y1, r.x2, r.y2) for r in J.track_boxes(df, "video").collect()]
    assert sorted(got) == sorted(want) and want


def _plain_match(preds, truths):
    base = lambda v: v.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    norm = lambda q: " ".join((q or "").lower().split())
    used, out = set(), []
    for p in preds:
        found = None
        name = (p.task, p.source, p.idx)
        if p.task is not None and name not in used:
            found = next((t for t in reversed(truths) if (t.task, t.source, t.idx) == name), None)
        for key in (lambda x: (x.video, norm(x.q)), lambda x: (base(x.video), norm(x.q))):
            found = found or next((t for t in reversed(truths) if key(t) == key(p)), None)
        free = [t for t in truths if base(t.video) == base(p.video) and (t.task, t.source, t.idx) not in used]
        found = found or next((t for t in free if norm(t.q) and norm(p.q).startswith(norm(t.q))), None) or (free[0] if free else None)
        if found:
            used.add((found.task, found.source, found.idx))
            out.append((found.task, found.source, found.idx, p.a, p.pos))
    return out


@pytest.mark.parametrize("layers", [(), B.LAYERS])
def test_consuming_match(spark, sf, layers):
    driver = B.Driver("etbench", layers)
    truths = B.etbench_truths(spark, sf)
    preds = B.etbench_predictions(truths, driver)
    rows = lambda df: sorted(df.collect(), key=lambda r: r.pos)
    want = _plain_match(rows(preds), rows(truths))
    got = entry.queries()["driver_etbench" + ("_layered" if layers else "")](spark, sf).collect()
    assert sorted((r.task, r.source, r.idx, r.a, r.pos) for r in got) == sorted(want) and {r.run for r in got} == {driver.run}


def test_guards(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "", 2)], "k long, v string, n long")
    with pytest.raises(Exception, match="empty record"):
        J.keyed_lookup(rows.select("k"), rows, ["k"], "v", "n").collect()
    assert [r.v for r in J.keyed_lookup(rows.select("k").limit(1), rows.withColumn("n", -F.col("n")), ["k"], "v", "n").collect()] == ["a"]
    with pytest.raises(Exception, match="gathered blocks: 3"):
        spark.range(1).select(R.gathered(F.array(F.lit(1), F.lit(2)), F.array(F.lit(9), F.lit(1)), 2)).collect()
    with pytest.raises(Exception, match="group of 2 rows"):
        M.require_complete(rows, "k", 3).collect()


def test_sequence_ranges(spark, monkeypatch):
    """A key that spans many ranges is summed as in one."""
    monkeypatch.setattr(S, "RANGE_ROWS", 2)
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id"), (F.col("id") % 7).alias("v"))
    got = {r.id: r.s for r in S.with_prefix_sum(df, ["k"], ["id"], "v", "s").collect()}
    assert got == {i: sum(j % 7 for j in range(i % 2, i, 2)) for i in range(500)}
    assert {r.id: r["rank"] for r in S.with_rank(df.select("id"), "id").collect()} == {i: i for i in range(500)}


def test_ranges_of_awkward_rows(spark, monkeypatch):
    """Null keys are a key of their own, ties go by the second column, an empty table gives none."""
    monkeypatch.setattr(S, "RANGE_ROWS", 2)
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate([(None, 1), (None, 1), (None, None), ("a", 2), ("a", 1), ("a", 1)])], "k string, v long, i long")
    got = {r.i: r.n for r in S.with_ordinal(df, ["k"], ["v", "i"], "n").collect()}
    assert got == {2: 0, 0: 1, 1: 2, 4: 0, 5: 1, 3: 2}
    assert S.with_ordinal(df.limit(0), ["k"], ["v", "i"], "n").count() == 0
    pieces = {(r.k, r.piece, r.source, r.from_token, r.to_token) for r in S.pack_constant(df.where("v is not null"), ["k"], "i", "v", 2).collect()}
    assert pieces == {(None, 0, 0, 0, 2), (None, 1, 1, 0, 2), ("a", 0, 3, 0, 2), ("a", 1, 3, 2, 3), ("a", 1, 4, 0, 1), ("a", 2, 4, 1, 2), ("a", 2, 5, 0, 1)}
    pairs = J.greedy_pairs(df.select("k", F.col("i").alias("a")), df.where("i <> 3").select("k", F.col("i").alias("b")), "k", "a", "b")
    assert {tuple(r) for r in pairs.collect()} == {("a", 3, 4), ("a", 4, 5)}
    p = spark.createDataFrame([(None, 1, 0.4), (None, 2, None), (None, 3, 0.6), (1, 4, 0.5), (1, 5, 0.5)], "k long, i long, p double")
    assert {r.i for r in N.nucleus(p, ["k"], "p", "i", 0.5).collect()} == {3, 4}


def test_styles_leave_a_slot(spark):
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("text")) for r, t in (("user", " hi "), ("assistant", "yes<|endoftext|>"), ("user", "and"), ("assistant", ""))])
    got = {name: spark.range(1).select(render(turns, "S").alias("x")).first().x for name, render in U.STYLES.items()}
    assert got["two"] == "S user:  hi  assistant: yes<|endoftext|></s>user: and assistant:"
    assert got["llama_2"] == "[INST] <<SYS>>\nS\n<</SYS>>\n\n hi  [/INST] yes<|endoftext|> </s><s>[INST] and [/INST]"
    assert got["llama_3"].startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>")
    assert got["qwen2"].endswith("<|im_start|>assistant\nyes<|im_end|>\n<|endoftext|><|im_start|>user\nand<|im_end|>\n<|im_start|>assistant\n")
    assert got["plain"] == "S hi </s>yes<|endoftext|></s>and</s>" and got["chatml"].endswith("user\nand<|im_end|>\nassistant\n")


def test_memory_stream_equals_batch(spark, sf, tmp_path):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    early = "2024-01-16"
    for k, part in enumerate((e.where(F.col("ts") < early), e.where(F.col("ts") >= early))):
        part.repartition(2).write.parquet(str(tmp_path / f"in/{k}"))
    options = dict(first=3, recent=5, size=4, then=3)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in/*"))
    # both files of a half are one trigger, so rows of a user arrive in order
    found = St.memory_stream(stream, "user_id", query="purchase", reblock="error", kind="event_type", value="value", **options)
    St.append_batches(found, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    names = ["event_id", "n_init", "n_local", "n_blocks", "remainder"]
    got = spark.read.parquet(str(tmp_path / "out"))
    kind = F.col("event_type")
    want = St.memory_answers(e, "user_id", ["ts", "event_id"], kind == "purchase", kind == "error", **options)
    rows = lambda df: sorted(tuple(r) for r in df.select(*names).collect())
    assert rows(got) == rows(want) and got.select("batch").distinct().count() == 2
    firsts = e.where("event_type not in ('purchase', 'error')").groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("v"))
    assert got.join(firsts, "user_id").where("fixed <> v").count() == 0


def test_answers_are_appended_once(spark, tmp_path):
    spark.range(20).select((F.col("id") % 4).alias("k")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
    questions = spark.createDataFrame([(1, "q1"), (2, "q2"), (9, "q9")], "k long, q string")
    for _ in range(2):  # the second run finds no new frames
        St.answer_batches(stream, questions, "k", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("k", "q").agg(F.sum("n_frames").alias("n")).collect()
    assert sorted((r.k, r.q, r.n) for r in got) == [(1, "q1", 5), (2, "q2", 5)]


def test_sources_and_sinks(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    (tmp_path / "l.json").write_text(json.dumps(rows))
    (tmp_path / "d.json").write_text(json.dumps({"p": rows[0], "q": rows[1]}))
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n[0, 18]\n")
    for name in ("l.json", "d.json", "s.jsonl"):
        got = files.read_by_extension(spark, str(tmp_path / name), "a int, b string").collect()
        assert sorted((r.a, r.b) for r in got) == [(1, "x"), (2, "y")], name
    df = spark.range(50).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    files.write_jsonl_seeks(df, str(tmp_path / "seeks"), "id")
    lines = spark.read.parquet(str(tmp_path / "seeks")).orderBy("line_no").collect()
    at = 0
    for k, r in enumerate(lines):
        assert (r.line_no, r.seek, json.loads(r.value)) == (k, at, {"id": k, "t": f"t{k}"})
        at += len(r.value) + 1
    assert files.read_line(spark, str(tmp_path / "seeks"), 31, "id long, t string").first().t == "t31"
    assert files.write_every(df.where("id < 25"), str(tmp_path / "every"), "id", 10) == 3
    assert files.write_every(df, str(tmp_path / "every"), "id", 10) == 2
    files.write_metrics(df.agg(F.count("*").alias("n")), df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/metrics")).first().n == 50 == spark.read.option("header", True).csv(str(tmp_path / "report/detail_csv")).count()
    broken = spark.createDataFrame([("v", i, None if i == 3 else float(i)) for i in range(8)] + [("w", i, i / 2) for i in range(5)], "v string, f int, t double")
    report = {r.v: (r.ok, r.fps, r.duration) for r in files.check_sources(broken, ["v"], "f", "t", F.col("f")).collect()}
    assert report == {"v": (False, 1.0, 7.0), "w": (True, 2.0, 2.0)}
    frames = spark.createDataFrame([(float(i),) for i in range(10)], "t double")
    assert files.frames_between(frames, [], "t", 2.0, 4.0).count() == 3 and files.frames_between(frames, [], "t", 0, None).count() == 10


def test_permutations_are_bijections(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("k"), "id")
    placed = rows.withColumns({"i": S.ordinal(["k"], ["id"]), "n": F.lit(13).cast("long")}).where("i < 13")
    for out in (
        S.partial_permutation(placed, "k", "i", "n", 0.4, S.seeded_order(1, "id"), S.seeded_order(2, "id"), "id"),
        S.clip_permutation(placed, "k", "i", "n", 4, lambda key, clip: S.seeded_order(3, "k", "__clip")),
    ):
        got = {}
        for r in out.collect():
            got.setdefault(r.k, []).append((r.i, r.new_place))
        for pairs in got.values():
            assert sorted(p for _, p in pairs) == list(range(13)) and any(a != b for a, b in pairs)

