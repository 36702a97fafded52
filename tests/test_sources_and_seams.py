"""Offset reads, sound arrays, retries, boxes and one-pass states against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from pyspark.sql import functions as F

from tidewater.operators import audio
from tidewater.operators import joins as J
from tidewater.operators import metrics as M
from tidewater.operators import questions as Q
from tidewater.plans.retrieval_queries import event_boxes
from tidewater.plans.seams import apply_with_retries
from tidewater.sources import files, offsets


def test_one_record_touches_only_its_bytes(spark, tmp_path, monkeypatch):
    uri = f"file://{tmp_path}/r"
    texts = [None if i == 3 else "" if i == 4 else f"é{i} " * (i % 50) for i in range(400)]
    index = offsets.write_records(spark.createDataFrame([(i * 2, t) for i, t in enumerate(texts)], "id long, text string").repartition(3), "text", "id", uri, parts=4)
    assert index.count() == 400 and {(r.id, r.line_no) for r in index.collect()} == {(2 * i, i) for i in range(400)}
    got = {r.line_no: r.value for r in offsets.read_records(spark, uri).collect()}
    assert got == {i: (t or "").encode() for i, t in enumerate(texts)}
    some = offsets.read_records(spark, uri).where("line_no IN (5, 399) OR line_no = 7").where("line_no >= 6")
    assert {r.line_no for r in some.collect()} == {7, 399}

    reader = offsets.OffsetReader(uri)
    assert list(reader.pushFilters([EqualTo(("line_no",), 150), EqualTo(("value",), b"x")])) == [EqualTo(("value",), b"x")]
    parts = reader.partitions()
    assert len(parts) == 1
    monkeypatch.setattr(offsets, "INDEX_ROWS", 10)
    (part,) = reader.partitions()
    assert part.count == 10
    touched, read = [], offsets._Files.read
    monkeypatch.setattr(offsets._Files, "read", lambda self, name, at, n: touched.append(n) or read(self, name, at, n))
    rows = [r for b in reader.read(part) for r in b.to_pylist()]
    assert rows == [{"line_no": 150, "value": texts[150].encode()}] and touched == [len(texts[150].encode())]
    for filters, n in (([In(("line_no",), (1, 2))], 1), ([GreaterThanOrEqual(("line_no",), 390)], 1), ([LessThan(("line_no",), 0)], 1), ([], 40)):
        reader = offsets.OffsetReader(uri)
        assert not list(reader.pushFilters(filters)) and len(reader.partitions()) == n


def test_slices_of_concatenated_files(spark, tmp_path):
    index = offsets.write_records(spark.createDataFrame([(i, bytes([i]) * (i % 9)) for i in range(60)], "id long, image binary"), "image", "id", f"file://{tmp_path}/i", separator=b"", parts=2)
    got = offsets.read_ranges(index.where("id % 3 = 0").withColumn("value2", F.lit(1)), f"file://{tmp_path}/i").collect()
    assert {r.id: r.value for r in got} == {i: bytes([i]) * (i % 9) for i in range(0, 60, 3)}


def test_only_the_index_line_goes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('[0, 7]\n{"a": 1}\n[0]\n[0, 8, 17]\n')  # three other lines
    (tmp_path / "b.jsonl").write_text('{"a": 2}\n[5]\n')
    lines = spark.read.text(str(tmp_path)).select("value", F.col("_metadata.file_name").alias("file"))
    assert sorted(r.value for r in files.without_index_line(lines).collect()) == ["[0, 7]", "[0]", "[5]", '{"a": 1}', '{"a": 2}']


def test_sound_of_awkward_chunks(spark):
    rows = [("a", 0, [1.0, 3.0, -8.0]), ("a", 1, []), ("a", 2, [2.0, 2.0]), ("z", 0, [0.0, 0.0]), ("n", 0, None), (None, 0, [4.0, 4.0])]
    c = audio.peak_normalised(audio.mono(spark.createDataFrame(rows, "k string, chunk long, x array<double>"), "x", 2), ["k"], "x")
    assert {(r.k, r.chunk): r.x for r in c.collect()} == {("a", 0): [0.25, -1.0], ("a", 1): [], ("a", 2): [0.25], ("z", 0): [0.0], ("n", 0): [], (None, 0): [1.0]}
    spans = spark.createDataFrame([("a", 1, 0.5, 9.0), ("a", 2, 0.0, 0.0), (None, 3, 0.0, 1.0), ("a", 4, 2.0, 3.0)], "k string, i long, start double, end double")
    assert {(r.k, r.i): r.x for r in audio.sliced(c, ["k"], "chunk", "x", spans, 2.0, "i").collect()} == {("a", 1): [-1.0, 0.25], (None, 3): [1.0]}


def test_slices_equal_plain_ones(spark):
    rng = random.Random(2)
    chunks = [[float(rng.randrange(100)) for _ in range(rng.randrange(0, 9))] for _ in range(40)]
    whole = [x for c in chunks for x in c]
    spans = [(i, a := rng.random() * 50, a + rng.random() * 20) for i in range(50)]
    c = spark.createDataFrame([("k", i, x) for i, x in enumerate(chunks)], "k string, chunk long, x array<double>")
    got = {r.i: r.x for r in audio.sliced(c, ["k"], "chunk", "x", spark.createDataFrame([("k", *s) for s in spans], "k string, i long, start double, end double"), 3.0, "i").collect()}
    want = {i: whole[int(a * 3) : int(b * 3)] for i, a, b in spans}
    assert got == {i: x for i, x in want.items() if x}


def test_failing_rows_do_not_end_the_job(spark):
    def model(row):
        if row["id"] % 3 == 0:
            raise ValueError(f"bad {row['id']}")
        return row["id"] * 10

    df = spark.range(60)
    results, failures = apply_with_retries(df, "id", model, "long", tries=30)
    got = {r.id: (r.used, r.result) for r in results.collect()}
    assert set(got) == set(range(60)) and all(r == u * 10 and u % 3 for u, r in got.values()) and all(got[i][0] == i for i in range(60) if i % 3)
    listed = failures.collect()
    assert {r.id for r in listed if r.tried == 1} == set(range(0, 60, 3)) and all(r.error == f"ValueError: bad {r.used}" for r in listed)
    results, failures = apply_with_retries(df, "id", lambda row: 1 / 0, "long", tries=3)
    assert results.count() == 0 and failures.count() == 180
    assert apply_with_retries(df.limit(0), "id", model, "long")[0].count() == 0


def test_suppression_equals_plain_loops(spark, sf):
    boxes = event_boxes(spark, sf).where("picture < 8")
    got = {r.id for r in J.suppress_overlaps(boxes, "picture", 0.3).collect()}
    want, by = set(), {}
    for r in boxes.collect():
        by.setdefault(r.picture, []).append(r)
    for rows in by.values():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.score, r.x1, r.id)):
            overlap = lambda o: max(0.0, min(r.x2, o.x2) - max(r.x1, o.x1)) * max(0.0, min(r.y2, o.y2) - max(r.y1, o.y1))  # noqa: E731, B023
            area = lambda o: (o.x2 - o.x1) * (o.y2 - o.y1)
            if all(overlap(o) / (area(r) + area(o) - overlap(o)) <= 0.3 for o in kept):
                kept.append(r)
        want |= {r.id for r in kept}
    assert got == want and len(want) < boxes.count()


def test_intervals_of_any_length(spark):
    rng = random.Random(6)
    make = lambda n, k: [(rng.choice([1, 2, None]), i, a := rng.uniform(-50, 50), a + rng.choice([0.0, 1e-9, 0.5, 3.0, 40.0, 1e4, -1.0])) for i in range(n)]
    left, right = make(60, 0), make(60, 1)
    x = spark.createDataFrame(left, "k int, i long, a double, b double")
    y = spark.createDataFrame(right, "k int, j long, c double, d double")
    got = sorted((r.i, r.j) for r in J.overlapping(x, y, ["k"], ("a", "b"), ("c", "d")).collect())
    assert got == sorted((i, j) for k, i, a, b in left for m, j, c, d in right if k == m is not None and a <= b and c <= d and a <= d and c <= b) and got
    got = sorted((r.i, r.j) for r in J.stab(x.select("k", "i", "a"), y, ["k"], "a", "c", "d").collect())
    assert got == sorted((i, j) for k, i, a, _ in left for m, j, c, d in right if k == m is not None and c <= a <= d) and got


def test_softmax_states_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(M, "_GROUPS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i % 4 if i % 5 else None, float((i * 37) % 900) if i % 11 else None, float(i)) for i in range(300)]
        df = spark.createDataFrame(rows, "k int, s double, v double").repartition(3)
        got = {r.k: r.weighted for r in M.merge_softmax(M.softmax_states(df, ["k"], F.col("s"), F.col("v")), ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in {r[0] for r in rows}:
        s, v = (np.array([r[c] for r in rows if r[0] == k and r[1] is not None]) for c in (1, 2))
        w = np.exp(s - s.max())
        assert got[k] == pytest.approx(float((w * v).sum() / w.sum()))


@pytest.mark.parametrize("score", ["dot", "max", "mean"])
def test_questions_in_small_blocks(spark, score):
    rng = np.random.default_rng(1)
    blocks = [(s, i, v.tolist()) for i, (s, v) in enumerate(zip(rng.integers(0, 2, 60).tolist(), rng.integers(-2, 3, size=(60, 4)).astype(float), strict=True))]
    blocks += [(None, 90, [1.0] * 4), (0, 91, None), (3, 92, [1.0] * 4)]
    asked = [(f"q{i}", s, v.tolist(), u) for i, (s, v, u) in enumerate(zip([0, 1] * 10, rng.integers(-2, 3, size=(20, 4)).astype(float), [None, 30] * 10, strict=True))]
    asked += [("x", None, [1.0] * 4, None), ("y", 0, None, None), ("few", 3, [1.0] * 4, None)]
    q = spark.createDataFrame(asked, "name string, stream int, q array<double>, until int")
    b = spark.createDataFrame(blocks, "stream int, vec_id long, embedding array<double>")
    got = sorted((r.name, r["rank"], r.vec_id, r.score) for r in Q.retrieve(q, b, ["name"], 5, score=score, width=2, until="until", at="vec_id", block_rows=7, question_rows=3).collect())
    want = []
    for name, s, v, u in asked:
        scored = []
        for t, i, w in blocks:
            if v is not None and w is not None and s is not None and s == t and (u is None or i < u):
                tokens = [max(v[k] * w[m] + v[k + 1] * w[m + 1] for m in (0, 2)) for k in (0, 2)]
                scored.append((-(sum(x * y for x, y in zip(v, w, strict=True)) if score == "dot" else max(tokens) if score == "max" else sum(tokens) / 2), i))
        want += [(name, n, i, -x) for n, (x, i) in enumerate(sorted(scored)[:5], 1)]
    assert got == sorted(want) and ("few", 1, 92) in {r[:3] for r in got}


def test_prefixes_of_many_lengths(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 9)))) for i in range(60)] + [(60, None)]
    prefixes = sorted({t[: rng.randrange(0, 9)] for _, t in texts if t} | {"aaaaaaaaaaaaaaaaaaaa", ""})
    got = J.prefix_match(spark.createDataFrame(texts, "i long, text string"), spark.createDataFrame([(p,) for p in prefixes], "p string"), "text", "p")
    assert sorted((r.i, r.p) for r in got.collect()) == sorted((i, p) for i, t in texts for p in prefixes if p and t is not None and t.startswith(p))
