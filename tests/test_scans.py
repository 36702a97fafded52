"""Recurrences and cuts of keys that span many blocks, against plain loops."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from test_completion import _plain_clips
from tidewater.operators import scans as Sc


@pytest.mark.parametrize("block", [None, 5])
@pytest.mark.parametrize("reverse", [False, True])
def test_affine_scan(spark, block, reverse):
    rng = random.Random(1)
    rows = [(k, i, rng.uniform(-1, 1) if rng.random() > 0.05 else None, rng.uniform(-1, 1)) for k, n in ((None, 40), ("a", 37), ("b", 3), ("c", 1)) for i in range(n)]
    want, x, last = {}, 0.0, object()
    for k, i, a, b in sorted(rows, key=lambda r: (r[0] or "", -r[1] if reverse else r[1])):
        x = 0.5 if k != last else x
        x, last = (1.0 if a is None else a) * x + b, k
        want[k, i] = x
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "kept") for r in rows], "k string, i long, a double, b double, x string")
    got = Sc.affine_scan(df.withColumnRenamed("x", "note"), ["k"], ["i"], F.col("a"), F.col("b"), "x", start=0.5, reverse=reverse, block=block).collect()
    assert {(r.k, r.i): r.x for r in got} == pytest.approx(want) and got[0].note == "kept"
    assert Sc.affine_scan(df.limit(0), ["k"], ["i"], F.col("a"), F.col("b"), "x").count() == 0


def test_advantage_of_a_key_in_blocks(spark):
    rows = [("a", i, float(i % 3), float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i long, r double, v double")
    want, adv, after = {}, 0.0, 0.0
    for _, i, r, v in reversed(rows):
        adv, after = r + 0.9 * after - v + 0.9 * 0.8 * adv, v
        want[i] = adv
    for block in (None, 6):
        got = Sc.generalized_advantage(df, ["k"], ["i"], "r", "v", 0.9, 0.8, block=block).collect()
        assert {r.i: r.advantage for r in got} == pytest.approx(want)


def test_controller_in_any_order(spark):
    df = spark.range(30).select((F.col("id") % 2).alias("k"), "id", (F.col("id") * 0.7).alias("kl"))
    path = {r.id: r.coefficient for r in Sc.controller_path(df, ["k"], ["id"], "kl", 0.2, 6.0, 100.0, 10, block=4).collect()}
    ends = {r.k: r.coefficient for r in Sc.controller_end(df, ["k"], "kl", 0.2, 6.0, 100.0, 10).collect()}
    assert ends == pytest.approx({0: path[28], 1: path[29]}) and len(path) == 30


@pytest.mark.parametrize("sentences, most, block", [(False, 9.0, 7), (False, 40.0, 5), (True, 9.0, 7), (True, 30.0, 64)])
def test_clips_of_a_transcript_in_blocks(spark, sentences, most, block):
    rng, rows, want = random.Random(block), [], []
    for key, n in (("a", 300), (None, 90), ("b", 1), ("c", block), ("d", block + 1)):
        t, words = 0.0, []
        for _ in range(n):
            t += rng.choice([0.25, 0.5, 1.0, 1.0, 2.5, 4.0])
            words.append((t, t + 0.25, rng.choice(["A", "b", "C.", "d?", "E"])))
        rows += [(key, i, *w) for i, w in enumerate(words)]
        want += [(key, *c[:5]) for c in _plain_clips(words, 1.5, most, 3.0, "start", sentences)]
    df = spark.createDataFrame(rows, "video string, pos long, start double, end double, word string").repartition(3)
    got = [tuple(r) for r in Sc.cut_clips(df, "video", least=1.5, most=most, gap=3.0, by="start", sentences=sentences, block=block).collect()]
    key = lambda r: (r[0] or "", r[1])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 15
    assert Sc.cut_clips(df.limit(0), "video").count() == 0


@pytest.mark.parametrize("sentences, by, block", [(False, "end", None), (True, "start", None), (True, "start", 40), (False, "start", 40)])
def test_clips_inside_rows(spark, sentences, by, block):
    rng, rows, want = random.Random(3), [("none", None, None, None), ("empty", [], [], [])], []
    for key, n in (("a", 300), (None, 90), ("b", 1), ("c", 40), ("d", 41)):
        t, words = 0.0, []
        for _ in range(n):
            t += rng.choice([0.25, 0.5, 1.0, 1.0, 2.5, 4.0])
            words.append((t, t + 0.25, rng.choice(["A", "b", "C.", "d?", "E", "", "Éa", "É", "x.\n"])))
        rows.append((key, *map(list, zip(*words, strict=True))))
        want += [(key, *c[:5]) for c in _plain_clips(words, 1.5, 9.0, 3.0, by, sentences)]
    df = spark.createDataFrame(rows, "video string, start array<double>, end array<double>, word array<string>").coalesce(1)
    cut = Sc.cut_transcripts(df, key="video", n=F.size("start"), least=1.5, most=9.0, gap=3.0, by=by, sentences=sentences, block=block)
    assert cut.columns == ["video", "clip", "first", "n", "start", "end"]
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, cut.collect()), key=key) == sorted(want, key=key) and len(want) > 15


@pytest.mark.parametrize("name", ["clip_cut", "clip_cut_sentences"])
def test_words_of_clips_are_not_shuffled(spark, sf, name):
    """A transcript is one row: its words as rows of their own took most of the time, and were cut twice if the cut was planned twice."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_words_before_keep_spaces(spark):
    df = spark.createDataFrame([(" a  b é c ", n) for n in range(7)] + [(None, 1)], "text string, first long")
    split = " a  b é c ".split(" ")
    assert [r.p for r in df.select(Sc.words_before("text", "first").alias("p")).collect()] == [" ".join(split[:n]) for n in range(7)] + [None]
