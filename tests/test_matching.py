"""Matching with consumption against a plain copy of its steps."""

from __future__ import annotations

import random
from types import SimpleNamespace as Row

from tidewater.operators.matching import consuming_match

PREDS = "pos long, task string, source string, idx long, video string, q string, a string"
TRUTHS = "pos long, task string, source string, idx long, video string, q string"


def plain(preds, truths):
    base = lambda v: v.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    norm = lambda q: " ".join((q or "").lower().split())
    name = lambda t: (t.task, t.source, t.idx)
    used, out = set(), []
    for p in sorted(preds, key=lambda r: r.pos):
        found = None
        if None not in name(p) and name(p) not in used:
            found = next((t for t in reversed(truths) if name(t) == name(p)), None)
        if p.video is not None:
            for key in (lambda x: (x.video, norm(x.q)), lambda x: (base(x.video), norm(x.q))):
                found = found or next((t for t in reversed(truths) if key(t) == key(p)), None)
            free = [t for t in truths if base(t.video) == base(p.video) and name(t) not in used]
            found = found or next((t for t in free if norm(t.q) and norm(p.q).startswith(norm(t.q))), None) or (free[0] if free else None)
        if found:
            used.add(name(found))
            out.append((*name(found), p.a, p.pos))
    return out


def check(spark, preds, truths, want):
    got = consuming_match(spark.createDataFrame([tuple(vars(p).values()) for p in preds], PREDS), spark.createDataFrame([tuple(vars(t).values()) for t in truths], TRUTHS)).collect()
    assert sorted((r.task, r.source, r.idx, r.a, r.pos) for r in got) == sorted(want)


def test_used_triplet_of_another_video(spark):
    truths = [Row(pos=0, task="a", source="s", idx=0, video="v1.mp4", q="one"), Row(pos=1, task="b", source="s", idx=1, video="v2.mp4", q="two")]
    preds = [Row(pos=0, task="a", source="s", idx=0, video="v1.mp4", q="x", a="p0"), Row(pos=1, task="a", source="s", idx=0, video="v2.mp4", q="two", a="p1")]
    want = plain(preds, truths)
    assert want == [("a", "s", 0, "p0", 0), ("b", "s", 1, "p1", 1)]
    check(spark, preds, truths, want)


def test_random_matches_across_videos(spark):
    """Independent instances in one table: names carry the instance's number."""
    rng, preds, truths, want, crossing = random.Random(7), [], [], [], 0
    for n in range(60):
        videos = [f"{d}/v{n}_{b}.mp4" for d in ("x", "y") for b in range(3)]
        questions = ["what", "what is", "what is it", "", None, "why  Not"]
        own = [Row(pos=100 * n + i, task="t", source=f"s{n}", idx=i if rng.random() < 0.9 else 0, video=rng.choice(videos), q=rng.choice(questions)) for i in range(rng.randrange(1, 12))]
        asked = []
        for i in range(rng.randrange(1, 16)):
            named = rng.random() < 0.5
            asked.append(Row(pos=100 * n + i, task="t" if named else None, source=f"s{n}", idx=rng.randrange(12), video=rng.choice([*videos, None, f"v{n}_9.mp4"]), q=rng.choice([*questions, "What is it now", "?"]), a=f"a{i}"))
        preds += asked
        truths += own
        want += plain(asked, own)
        names = {(t.task, t.source, t.idx): t.video for t in own}
        crossing += sum(p.video is not None and names.get((p.task, p.source, p.idx), p.video) != p.video for p in asked)
    assert crossing > 50
    check(spark, preds, truths, want)


def test_no_rows(spark):
    t = spark.createDataFrame([(0, "a", "s", 0, "v", "q")], TRUTHS)
    p = spark.createDataFrame([(0, None, None, None, "v", "z", "x")], PREDS)
    assert consuming_match(p.limit(0), t).count() == 0 and consuming_match(p, t.limit(0)).count() == 0 and consuming_match(p, t).count() == 1
