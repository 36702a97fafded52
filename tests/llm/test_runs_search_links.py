"""Periodic runs, ranked search and embedding links against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidewater.llm import cover_tree, lexical_search, periodic_runs, queries

LONG = "word " * 30_000


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# 11


def _text(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randrange(0, 250))]
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(words) + 1)
        words[at:at] = (words[at : at + 1 + rng.randrange(30)] * 120)[: rng.randrange(120)]
    if len(words) > 20 and rng.random() < 0.5:
        a, b = sorted(rng.randrange(len(words)) for _ in range(2))
        at = rng.randrange(len(words))
        words[at:at] = words[a:b]
    return np.array(words, np.int64)


@pytest.mark.parametrize("least", [6, 9, 24])
def test_runs_equal_brute_force(least):
    rng, found = random.Random(least), 0
    for _ in range(60):
        texts = [_text(rng) for _ in range(rng.randrange(1, 8))]
        for text, got in zip(texts, periodic_runs.runs_of(texts, least), strict=True):
            assert got == periodic_runs.brute_force(text.tolist(), least)
            found += len(got)
    assert found > 100


def test_runs_do_not_depend_on_grouping(monkeypatch):
    rng = random.Random(5)
    texts = [_text(rng) for _ in range(40)]
    want = periodic_runs.runs_of(texts)
    monkeypatch.setattr(periodic_runs, "GROUP", 50)
    monkeypatch.setattr(periodic_runs, "_PAIRS", 37)
    assert periodic_runs.runs_of(texts) == want and any(want)


def _report(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    runs = periodic_runs.brute_force(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_report_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").where(F.length("text") < 4000).collect()]
    rows += [(i, f"x{i} " + "a b c " * 40 + "tail\x0bof\x1cit all " + "z " * i) for i in range(120)]
    got = {(r[0], r.collapsed_sha256): tuple(r) for r in periodic_runs.runs_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(w[0], w[-1]): w for w in (_report(*r) for r in rows)}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 100


def test_runs_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b a b " * 8), (4, "a b a b " * 8), (None, "a b a b " * 8), (5, LONG), (6, "é   " * 30)]
    d = spark.createDataFrame([(i, t, "r", "c", "b") for i, t in rows], "doc_id long, text string, runs string, collapsed string, best string")
    got = periodic_runs.collapse_runs(d).collect()
    assert [r.collapsed for r in got] == ["", "", "", "a b", "a b", "a b", "word", "é  "]
    assert [[tuple(x) for x in r.runs] for r in got][3:] == [[(0, 32, 2)]] * 3 + [[(0, 30_000, 1)], [(0, 60, 2)]]
    assert got[0].best == "b" and periodic_runs.collapse_runs(d.limit(0)).count() == 0
    out = periodic_runs.runs_report(d).collect()
    assert [r.n_runs for r in out] == [0, 0, 0, 1, 1, 1, 1, 1] and out[0].start is None and len(out[0].runs_sha256) == 64


# 12


def test_search_equals_brute_force_and_does_not_depend_on_shards(spark, sf, monkeypatch):
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    want = sorted(lexical_search.brute_force([(r.doc_id, r.text.encode()) for r in docs.collect()], [(r.item_id, r.text.encode()) for r in items.collect()]))
    assert sorted(map(tuple, lexical_search.search(docs, items).collect())) == want
    monkeypatch.setattr(lexical_search, "SHARD_DOCUMENTS", 17)
    monkeypatch.setattr(lexical_search, "PART_BYTES", 3000)
    monkeypatch.setattr(lexical_search, "STRIDE", 1)
    assert sorted(map(tuple, lexical_search.search(docs.repartition(5), items).collect())) == want


def test_threshold_search_stops_early():
    rng = np.random.default_rng(3)
    n, per = 4000, 12
    terms = np.sort(rng.permuted(np.tile(np.arange(60), (n, 1)), axis=1)[:, :per], axis=1)
    terms[:40] = np.arange(per)  # these hold all terms, often
    terms = terms.ravel()
    counts = rng.integers(1, 4, n * per) * np.repeat(np.where(np.arange(n) < 40, 50, 1), per)
    df = np.bincount(terms, minlength=60)
    sizes = np.full(n, per)
    shard = lexical_search._Shard(np.full(n, 100), terms, counts, sizes, lexical_search.weights(df, n), n, 100 * n)
    looked, whole = [], shard.scores
    shard.scores = lambda rows, repeats: looked.append(len(rows)) or whole(rows, repeats)
    repeats = np.zeros(60, np.int64)
    repeats[:8] = 1
    got = lexical_search.threshold_search(shard, np.arange(8), np.ones(8, np.int64), repeats, np.zeros(n, bool), np.arange(n), lexical_search._NONE, 10)
    every = whole(np.arange(n), repeats)
    by = np.lexsort((np.arange(n), -every))[:10]
    assert got[2].tolist() == by.tolist() and got[0].tolist() == every[by].tolist()
    assert sum(looked) < n / 4


def test_search_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "Alpha beta"), (4, "Alpha beta"), (None, "ALPHA beta"), (5, "alpha " * 50_000), (6, "straße Ünï alpha"), (7, "gamma")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, item_id string, rank int")
    asked = [(1, "alpha beta beta"), (1, "alpha beta beta"), (1, "straße"), (2, None), (3, ""), (None, "Ünï"), (4, "absent"), (5, "??")]
    items = spark.createDataFrame([(i, t, 7) for i, t in asked], "item_id long, text string, doc_id int")
    key = lambda r: [(x is None, x or 0) for x in r]
    encoded = lambda pairs: [(i, t.encode() if t is not None else None) for i, t in pairs]
    want = sorted(lexical_search.brute_force(encoded(rows), encoded(asked)), key=key)
    assert sorted(map(tuple, lexical_search.search(docs, items).collect()), key=key) == want
    tied = [r[2] for r in want if r[0] == 1]
    assert Counter(tied)[4] == 2 and tied.index(4) < tied.index(None)
    assert lexical_search.search(docs.limit(0), items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0


# 13


def _vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = np.concatenate([rng.normal(size=(n // 3, dim)), centres[rng.integers(0, 8, n - n // 3)] + rng.normal(size=(n - n // 3, dim)) * rng.choice([0.0, 0.01, 0.05, 0.12], size=(n - n // 3, 1))])
    return [(i, v.astype(np.float32).tolist(), int(i % 3 > 0)) for i, v in enumerate(x)]


@pytest.mark.parametrize("dim", [2, 16])
@pytest.mark.parametrize("threshold", [0.5, 0.98])
def test_traversal_equals_all_pairs(dim, threshold):
    x = cover_tree.unit(np.array([v for _, v, _ in _vectors(300, dim, dim)]))
    w = np.arange(300) % 4 + 1
    right, same = np.concatenate((x[150:], x[:20])), np.concatenate((np.full(150, -1), np.arange(20)))
    got = cover_tree.Traversal(cover_tree.CoverTree(x[:150], w[:150]), cover_tree.CoverTree(right, np.concatenate((w[150:], w[:20]))), same, threshold)
    linked = x[:150] @ right.T >= threshold
    linked[np.arange(20), 150 + np.arange(20)] = False
    assert (got.counts[0] == linked @ got.right.weight).all() and (got.counts[1] == w[:150] @ linked).all()


def test_tree_levels_halve():
    x = cover_tree.unit(np.random.default_rng(2).normal(size=(400, 3)))
    tree = cover_tree.CoverTree(x, np.ones(400, np.int64))
    assert sorted(tree.order.tolist()) == list(range(400))
    for k, kids in enumerate(tree.children):
        assert not len(kids) or (tree.begin[kids[0]], tree.end[kids[-1]]) == (tree.begin[k], tree.end[k])
        own = x[tree.order[tree.begin[k] : tree.end[k]]]
        assert np.linalg.norm(own - x[tree.centre[k]], axis=1).max() <= tree.reach[k] + 1e-6
        assert not len(kids) or tree.centre[kids[0]] == tree.centre[k]


@pytest.mark.parametrize("setting", [{}, {"block": 40}, {"block": 16, "sample": 60}, {"sample": 1}])
def test_links_equal_brute_force(spark, setting):
    rows = _vectors(360, 4, 9)
    rows += [(1000 + i, [3 * x for x in rows[i][1]], rows[i][2]) for i in range(10)]  # as far from others as the vectors themselves
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(30)]
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **setting).collect()
    assert sorted(map(tuple, got)) == sorted(cover_tree.brute_force([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]))
    assert len({r.component_id for r in got}) < len(got) - 50


def test_core_links_are_counted_without_pairs(spark):
    rng = np.random.default_rng(4)
    near = [(i, (np.eye(16)[0] + rng.normal(size=16) * 0.008).tolist(), 1) for i in range(500)]
    rows = near + [(1000 + i, rng.normal(size=16).tolist(), 1) for i in range(100)]
    got = {r.vec_id: r for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=64).collect()}
    assert {got[i].n_links for i in range(500)} == {499} and {got[i].component_id for i in range(500)} == {0}


def test_links_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1),
        (9, [inf, 1.0], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.01], 2), (12, [1e200, 1e198], 2), (13, [1e-200, 0.0], 2), (13, [0.0, 1.0], 1), (14, [0.0, 2.0], 1), (15, [-1.0, 0.0], 1),
    ]
    d = spark.createDataFrame([(i, v, label, "n", "k") for i, v, label in rows], "vec_id long, embedding array<double>, label int, n_links string, kept string")
    key = lambda r: [(x is None, x or 0) for x in r]
    got = sorted(map(tuple, cover_tree.near_duplicates(d).collect()), key=key)
    scaled = [(i, [x / 1e150 for x in v] if i == 12 else [x * 1e150 for x in v] if i == 13 and label == 2 else v, label) for i, v, label in rows]
    assert got == sorted(cover_tree.brute_force(scaled), key=key)
    assert cover_tree.near_duplicates(d.limit(0)).count() == 0
    strings = d.withColumn("label", F.concat(F.lit("l"), F.col("label").cast("string")))
    assert sorted(map(tuple, cover_tree.near_duplicates(strings).collect()), key=key) == got


def test_all_vectors_equal(spark):
    d = spark.range(1500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(1).alias("label"))
    got = cover_tree.near_duplicates(d).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(1499, 0)} and sum(r.kept for r in got) == 1


def test_queries_are_registered():
    assert {"op11_periodic_runs", "op12_lexical_search", "op13_embedding_dedup"} <= set(queries.queries())


# 4


def test_names_do_not_decide_alone():
    from tidewater.llm.html_text import main_text, page_lines

    kept = ['<article class="widget"><p>body</p></article>', '<article><table class="discussion"><tr><td>body</td></tr></table></article>', '<main><div class="banner">body</div></main>', '<main class="with-sidebar"><p>body</p></main>']
    assert [main_text(page_lines(p), []) for p in kept] == ["body"] * 4
    dropped = ["ad-300x250", "promo_inline", "cookie-banner-v2", "AdSlot2", "post-comments", "sponsored-content"]
    for name in dropped:
        assert main_text(page_lines(f'<article><p>body</p><div class="{name}">other</div></article>'), []) == "body", name
    for name in ("share-price", "adhesive", "menu-planning-tips", "noticeable"):
        assert main_text(page_lines(f'<article><p class="{name}">body</p></article>'), []) == "body", name
    teaser = '<article><h1>Title</h1><p>' + "long text " * 40 + '</p></article><article><h2><a href="/x">Other story</a></h2><p>in short</p></article>'
    assert "Other" not in main_text(page_lines(teaser), []) and "long text" in main_text(page_lines(teaser), [])
    listing = "".join(f"<article><h2>Part {i}</h2><p>{'words ' * 9}</p></article>" for i in range(3))
    assert main_text(page_lines(listing), []).count("Part") == 3


def test_differencing_decides_on_doubtful_lines_of_articles(spark):
    """A banner that other pages of the host show goes, one of its own stays; against all neighbours by a plain subsequence."""
    from tidewater.llm.html_text import DOUBTFUL, MAIN, extract, page_lines

    def page(i):
        return f'<body><nav>menu</nav><article><div class="banner">{"Sale today" if i % 3 else f"Hero {i}"}</div><p>text {i}</p><div class="widget"><p>Top ten</p><p>own {i}</p></div></article></body>'

    def common(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found, i, j = set(), len(a), len(b)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                found.add(i - 1)
                i, j = i - 1, j - 1
        return found

    pages = [(i, f"http://h/{i:03}", page(i)) for i in range(30)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string"), blocks=4).collect()}
    lines = [page_lines(p) for *_, p in pages]
    assert all({s for s, _ in x} == {MAIN, DOUBTFUL} for x in lines)
    for i, own in enumerate(lines):
        doubtful = [t for s, t in own if s == DOUBTFUL]
        gone = set()
        for k in (i - 1, i + 1):
            if 0 <= k < len(lines):
                gone |= {doubtful[x] for x in common(doubtful, [t for s, t in lines[k] if s == DOUBTFUL])}
        assert got[i] == "\n\n".join(t for s, t in own if s == MAIN or t not in gone)
    assert "Hero 3" in got[3] and "Sale" not in got[4] and all("Top ten" not in t for t in got.values())


# 3


def test_parts_of_a_benchmark_equal_one_automaton(spark, sf, monkeypatch):
    """Many parts, several filters and several tasks for a part give what one automaton gives; columns with clashing names stay."""
    from tidewater.llm import decontaminate

    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 13, 14, 30])))) for i in range(60)] + [(60, None), (61, "!!")]
    texts = [(i, " ".join([*rng.choices(words, k=20), rng.choice(asked[:60])[1], *rng.choices(words, k=5), rng.choice(asked[:60])[1][:40]])) for i in range(200)] + [(200, None), (201, ""), (202, LONG)]
    items = spark.createDataFrame(asked, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, hit_items string, part int")
    rows = lambda **o: sorted((r.doc_id, r.n_words, tuple(map(tuple, r.hit_spans)), tuple(r.hit_items), r.part) for r in decontaminate.find_hits(docs, items, **o).collect())
    want = rows()
    plain = decontaminate.brute_force([t.encode() if t else None for _, t in texts], [(str(i), t.encode()) for i, t in asked if t])
    assert [(r[1], sum(b - a for a, b in r[2]), list(r[3])) for r in want] == plain and sum(bool(r[3]) for r in want) > 100
    monkeypatch.setattr(decontaminate, "MAX_FILTER_BYTES", 2000)
    monkeypatch.setattr(decontaminate, "PART_DOCUMENTS", 20)
    assert rows(max_automaton_bytes=300) == want
    assert decontaminate.find_hits(docs.limit(0), items, max_automaton_bytes=300).count() == 0


# 1, 6, 10


def test_very_long_rows_have_shards_of_their_own(spark):
    from tidewater.llm import sharding

    rows = [(i, "x" * (5000 if i % 10 == 0 else 20)) for i in range(60)] + [(None, None), (60, "")]
    got = sharding.document_shards(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()
    assert len(got) == 62 and all(r.shard_rows == 1 and r.shard_bytes == 5000 for r in got if r.n_bytes == 5000)
    assert all(r.shard_bytes <= 400 for r in got if r.n_bytes < 5000)


def test_templates_that_compress_alike():
    """Of equal wordings the first is named; of wordings that fit alike the one with fewer differences, then the longest."""
    from tidewater.llm import licenses

    same = [("one", "Under the terms of this licence here"), ("two", "Under the terms of this licence here")]
    assert [h["license"] for h in licenses.Scanner(same).scan("x under the terms of this licence here y")] == ["one"]
    nested = [("short", "the terms of this licence"), ("long", "Under the terms of this licence here")]
    assert [h["license"] for h in licenses.Scanner(nested).scan("x under the terms of this licence here y")] == ["long"]
    assert [h["license"] for h in licenses.Scanner(nested).scan("x by the terms of this licence there y")] == ["short"]


def test_digests_of_awkward_rows(spark):
    from tidewater.llm import bpe

    rows = [(1, None), (2, ""), (3, "two words"), (3, "two words"), (4, "long " * 20_000)]
    got = bpe.digests(spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, n_tokens string")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got[:2]] == [(0, empty, empty)] * 2
    assert got[2][2:] == got[3][2:] and got[4].n_tokens >= 20_000
