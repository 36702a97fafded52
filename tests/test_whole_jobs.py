"""Queries that must see all of their input."""

from __future__ import annotations

import datetime as dt

import duckdb

import __spark_entry__ as entry

DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"


def test_tracks_take_every_event(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(60 * u + i, start + dt.timedelta(seconds=i), u, 5.0 if i % 60 else 500.0) for u in range(25) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["track_faces"](spark, str(tmp_path)).collect()
    # the first box of each user lies elsewhere and is a track of one box, which goes
    assert sorted((r.video, r.frame, r.x1) for r in got) == [(u, i, 5.0) for u in range(25) for i in range(1, 60)]
    assert {r.track for r in got} == {0}


def test_votes_of_whole_blocks(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf}/embeddings.parquet'")
    con.sql(f"create table s as select a.vec_id, a.label, round({DOT}, 6) as score from embeddings a, (select embedding from embeddings where vec_id = 0) b")
    con.sql("""create table v as select vec_id, sum(1.0 + label % 2)::double as votes from
        (select *, row_number() over (partition by label order by score desc, vec_id) as rn from s) where rn <= 5 and label >= 2 group by vec_id""")
    got = {(r.vec_id, r.votes) for r in entry.queries()["layer_vote"](spark, sf).collect()}
    assert got == set(con.sql("select vec_id, votes from v").fetchall())
    want = con.sql("select vec_id from (select * from v order by votes desc, vec_id limit 6) union select vec_id from (select vec_id from embeddings order by vec_id desc limit 5)")
    assert {(r.vec_id,) for r in entry.queries()["recent_union_topk"](spark, sf).collect()} == set(want.fetchall())


def test_votes_of_layers_meet(spark, tmp_path):
    # block i has its one key in layers 0 to i, so layer l ranks the blocks from l on, and equal scores go by id
    rows = [(i, [1.0 if layer <= i and k == 0 else 0.0 for layer in range(8) for k in range(8)], i % 3) for i in range(1, 9)]
    _write(spark, tmp_path, embeddings=([(0, [1.0] * 64, 0), *rows], "vec_id long, embedding array<float>, label int"))
    want = {}
    for layer in range(2, 8):
        order = sorted(range(9), key=lambda i: (-8.0 if i == 0 else -1.0 if layer <= i else 0.0, i))
        for i in order[:5]:
            want[i] = want.get(i, 0.0) + 1.0 + layer % 2
    got = {r.vec_id: r.votes for r in entry.queries()["layer_vote_all_blocks"](spark, str(tmp_path)).collect()}
    assert got == want and want[0] == 9.0


def _write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_priority_match_of_whole_texts(spark, tmp_path):
    same = "the same twenty characters "
    texts = ["Label Me", "label me", "\tlabel me \n", "entire_005_x", "x", same + "a", same + "b", None, ""]
    _write(spark, tmp_path, documents=([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string"), labels=([(2, 1, 0), (4, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.quality for r in entry.queries()["priority_match_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: "1", 2: "1", 3: "1", 4: "0", 5: "0", 6: "1", 7: "", 8: "", 9: ""}


def test_joins_of_whole_tables(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    run = lambda name: sorted(map(tuple, entry.queries()[name](spark, sf).collect()))
    exact = con.sql("select d.doc_id, max(x.quality)::varchar from documents d join (select text, quality from documents join labels using (doc_id)) x on d.text = x.text group by d.doc_id").fetchall()
    got = run("priority_match_texts")
    assert len(got) == con.sql("select count(*) from documents").fetchall()[0][0] and set(exact) <= set(got)
    n = "select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from conversations where role = "
    want = con.sql(f"select u.conv_id, u.turn, a.turn from ({n} 'user') u join ({n} 'assistant') a on u.conv_id = a.conv_id and u.n = a.n").fetchall()
    assert run("consumed_replies") == sorted(want) and want
