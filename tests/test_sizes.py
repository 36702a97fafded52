"""Faults that only larger or odd tables show."""

from __future__ import annotations

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def _sql(name, path, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as from '{path}/{table}.parquet/*.parquet'")
    return con.execute(entry.oracle_sql()[name]).fetchall()


def test_groups_that_the_end_of_the_table_cuts(spark, tmp_path):
    from tidewater.operators import metrics as M

    spark.range(26).where("id <> 3").select(F.col("id").alias("vec_id"), F.array(F.lit(0.0)).alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.grp, r.n) for r in entry.queries()["complete_groups"](spark, str(tmp_path)).collect())
    assert got == sorted(_sql("complete_groups", tmp_path, "embeddings")) == [(0, 10), (1, 10), (2, 10)]
    rows = spark.createDataFrame([("a", 0), ("a", 2), ("a", 2), ("b", 5)], "k string, p int")
    assert sorted(tuple(r) for r in M.with_missing(rows, "k", "p", 3).collect()) == [("a", 0, False), ("a", 1, True), ("a", 2, False), ("b", 0, True), ("b", 1, True), ("b", 2, True), ("b", 5, False)]
    with pytest.raises(Exception, match="group of 4 rows"):  # a member that no group has room for is still an error
        M.require_complete(M.with_missing(rows, "k", "p", 3), "k", 3).collect()


def test_lines_of_many_offsets(spark, tmp_path):
    """A regular expression with a repeated group needs stack for each entry."""
    from tidewater.sources import files as S

    rows = spark.range(40_000).select("id", F.lit("x").alias("t"))
    S.write_jsonl_indexed(rows, f"{tmp_path}/lines", 1)
    assert S.read_jsonl_indexed(spark, f"{tmp_path}/lines", "id long, t string").agg(F.count("id"), F.sum("id"), F.count("*")).first()[:] == (40_000, 799_980_000, 40_000)
    lines = ["7", "[0, 2, 9]", "[0 2]", "[0,, 2]", "[0, 2,]", "[]", "[a]"]
    df = spark.createDataFrame([(v, "f") for v in [*lines, "[ 0,2 ,\t4,6,8,10,12 ]"]], "value string, file string")
    assert sorted(r.value for r in S.without_index_line(df).collect()) == sorted(lines)


def test_values_at_the_threshold(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), 1, float(20 + i)) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in entry.queries()["stepwise_gate"](spark, str(tmp_path)).collect())
    assert got == sorted(_sql("stepwise_gate", tmp_path, "events")) == [(i, True) for i in range(400)]


def test_negative_zeros_of_sound(spark, tmp_path):
    rows = [(1, [-2e-7] * 2 + [-0.0] * 2 + [0.0] * 2 + [1.0] * 58, 1), (2, [0.5] * 64, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("sound_chunks", "sound_slices"):
        got = sorted(repr(tuple(r)) for r in entry.queries()[name](spark, str(tmp_path)).collect())
        assert got == sorted(repr(tuple(r)) for r in _sql(name, tmp_path, "embeddings"))
        assert name == "sound_slices" or "-0.0" in got[0]


def test_ranges_of_wide_rows(spark):
    """Few rows of many bytes are ranked in ranges, too: 400 texts of 100 kB are no one task's."""
    from tidewater.operators import sequences as S

    wide = spark.range(400).select("id", F.repeat(F.lit("x"), 100_000).alias("text"), F.array(F.lit(1.0)).alias("v"))
    assert S.ranged(wide, "id").select("__range").distinct().count() > 32
    assert S.ranged(wide.select("id"), "id").select("__range").distinct().count() == 1
    assert {r.id: r["rank"] for r in S.with_rank(wide, "id").select("id", "rank").collect()} == {i: i for i in range(400)}
    named = wide.select(F.format_string("%03d", "id").alias("name"), "text")
    assert {r.name: r["rank"] for r in S.with_rank(named, "name").select("name", "rank").collect()} == {f"{i:03d}": i for i in range(400)}


def test_prefixes_meet_starts_of_texts(spark, tmp_path):
    """What is shuffled of a text is as long as the prefixes that it is compared with."""
    spark.createDataFrame([(1, "It is. It was."), (2, "It is. No."), (3, "It. is"), (4, None), (5, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["prefix_match_join"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(_sql("prefix_match_join", tmp_path, "documents"))
    heads = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "AS __head" in line]
    assert heads and not any(re.search(r"[\[ ]text#\d+[,\]]", line) for line in heads)


def test_long_lines_of_offsets_by_extension(spark, tmp_path):
    from tidewater.sources import files as S

    S.write_jsonl_indexed(spark.range(30_000).select("id", F.lit("x").alias("t")), f"{tmp_path}/a.jsonl", 1)
    assert S.read_by_extension(spark, f"{tmp_path}/a.jsonl", "id long, t string").agg(F.count("*"), F.sum("id")).first()[:] == (30_000, 449_985_000)


def test_tracks_make_no_table_per_frame(spark):
    """A table per frame took most of the fold's time; null frames are in no track."""
    from tidewater.operators import joins as J

    rows = [("v", f, 1.0, 0.0, 9.0, 9.0) for f in (0, 1, 2, 4, None)] + [("w", None, 1.0, 0.0, 9.0, 9.0)]
    boxes = spark.createDataFrame(rows, "video string, frame long, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.video, r.track, r.frame) for r in J.track_boxes(boxes, "video").collect()) == [("v", 0, 0), ("v", 0, 1), ("v", 0, 2)]
    folded = [c for c in J.track_boxes.__code__.co_consts if hasattr(c, "co_names")]
    assert folded and not any("itertuples" in c.co_names for c in folded)


def test_files_of_records_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    """An array is one row of one task, so files must not grow with the table."""
    from tidewater.sources import files as S

    rows = spark.range(2_000).select("id", F.lit("é" * 40).alias("t"))
    monkeypatch.setattr(S, "FILE_BYTES", 20_000)
    S.write_json_arrays(rows, f"{tmp_path}/b.json", 2)
    S.write_jsonl_indexed(rows, f"{tmp_path}/a.jsonl", 2)
    for name in ("a.jsonl", "b.json"):
        sizes = [f.stat().st_size for f in (tmp_path / name).glob("part-*")]
        assert len(sizes) > 5 and max(sizes) < 40_000
        assert S.read_by_extension(spark, f"{tmp_path}/{name}", "id long, t string").agg(F.count("*"), F.sum("id")).first()[:] == (2_000, 1_999_000)
    monkeypatch.setattr(S, "FILE_BYTES", 1 << 20)
    S.write_json_arrays(rows, f"{tmp_path}/c.json", 2)
    assert len(list((tmp_path / "c.json").glob("part-*"))) == 2
