"""Training-data operators against brute force, and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import bpe, decontaminate, fingerprint, html_text, licenses, ngram_join, queries, sharding, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hit_spans string, shard string, p_toxic string, class_id string"
LONG = "word " * 30_000


def docs(spark, rows):
    """(doc_id, text) rows among columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z", "w") for i, t in rows], DOCS)


def awkward(spark):
    return docs(spark, [(1, None), (2, ""), (3, "!!! ???"), (3, "!!! ???"), (None, "one two"), (4, LONG), (5, "Ünïcode straße ﬁ"), (6, "one two three four five six seven")])


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# 1


def test_shards_fit_and_cover(spark, sf):
    got = sharding.document_shards(read(spark, sf, "documents"), 1 << 15).collect()
    assert len(got) == read(spark, sf, "documents").count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for shard, rows in by.items():
        assert sum(r.n_bytes for r in rows) == rows[0].shard_bytes and len(rows) == rows[0].shard_rows
        assert rows[0].shard_bytes <= 1 << 15 or len(rows) == 1
        assert not any(o != shard and o.startswith(shard) for o in by)


def test_hot_key_is_split(spark):
    hot = spark.range(300).select(F.lit(7).alias("k"), F.lit("same").alias("text"))
    got = sharding.assign_shards(hot, key=["k"], bytes_col=F.lit(10), limit=500)
    assert got.count() == 300 and got.agg(F.max("shard_bytes")).first()[0] <= 500
    assert got.columns == ["k", "text", "shard", "shard_depth", "shard_bytes", "shard_rows"]


def test_shards_of_awkward_rows(spark, tmp_path):
    a = awkward(spark)
    got = sharding.assign_shards(a, key=["doc_id"], bytes_col=F.octet_length("text"), limit=100)
    assert got.count() == 8 and got.columns.count("shard") == 1
    assert sharding.assign_shards(a.limit(0), key=["doc_id"], bytes_col=F.octet_length("text"), limit=100).count() == 0
    sharding.write_shards(a.drop("shard"), str(tmp_path / "s"), key=["doc_id"], bytes_col=F.octet_length("text"), limit=100)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 8


# 2


@pytest.mark.parametrize("most", [0, warc.MAX_BROADCAST_GROUPS])
def test_warc_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MAX_BROADCAST_GROUPS", most)
    fake = "x WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0 y"
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/\r\nb", fake), (2, None, fake), (3, "u", None), (4, "u", ""), (5, "u", tricky), (6, "u", "é" * 5000), (7, "u", "plain"), (8, "u", "plain"), (9, "u", "plain"), (10, "u", "\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit(1))
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        p = (h or "").encode()
        top = max(j for j, _, o in rows if (o or "") == (h or ""))
        want = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if top == i else "revisit", None if top == i else top)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, warc.MAX_BROADCAST_GROUPS])
def test_warc_of_shuffled_and_repeated_rows(spark, monkeypatch, most):
    """One response a group, whatever the layout of the input; payloads are in the archives."""
    monkeypatch.setattr(warc, "MAX_BROADCAST_GROUPS", most)
    body = lambda g: f"page {g} WARC/1.1 " + hashlib.sha1(str(g).encode()).hexdigest() * (g % 7 + 1)
    df = spark.createDataFrame([(i, "u", body(i % 300)) for i in range(900)], "page_id long, url string, html string")
    ids = spark.range(900).select(F.col("id").alias("page_id"))
    for shuffled in (df.repartition(7, "page_id"), df.repartition("html").join(ids, "page_id")):
        got = warc.round_trip(shuffled).collect()
        assert len(got) == 900
        for r in got:
            top = 600 + r.page_id % 300
            want = base64.b32encode(hashlib.sha1(body(r.page_id % 300).encode()).digest()).decode()
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == top else ("revisit", top))
            assert r.payload_digest == want and r.payload_bytes == len(body(r.page_id % 300))
    rows = [(5, "a", "same"), (5, "a", "same"), (5, "b", "same"), (None, "c", "same"), (None, "d", "other"), (None, "d", "other")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == sorted(
        [(5, "response", 0), (5, "revisit", 5), (5, "revisit", 5), (0, "revisit", 5), (0, "response", 0), (0, "revisit", 0)]
    )


def test_warc_magic_in_headers(spark, tmp_path):
    ids = ["a", "WARC/1.0 id", "50%2F%", "x\r\nWARC/1.1", "last", None]
    rows = [(i, f"http://h/WARC/1.{n}?WARC/1.1\r\nContent-Length: 0", f"page {n % 4}") for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1)
    warc.write_warc(df, str(tmp_path / "w"))
    got = {r.id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert set(got) == {i or "" for i in ids} and all(r.payload_bytes == 6 for r in got.values())
    firsts = {"page 0": "last", "page 1": ids[1]}
    assert {i: r.refers_to for i, r in got.items() if r.refers_to} == {i: firsts[h] for i, _, h in rows if i is not None and firsts.get(h, i) != i} | {"": ids[1]}


def test_warc_broken_chain_is_an_error(spark, tmp_path):
    record = "WARC/1.1\r\nWARC-Record-ID: <urn:page:%d>\r\n%sContent-Length: 1\r\n\r\nz\r\n\r\n"
    (tmp_path / "w").mkdir()
    for middle, n in (("", 3), ("WARC-Target-URI: WARC/1.1\r\n", None)):
        (tmp_path / "w" / "a.txt").write_bytes("".join(record % (i, middle if i == 1 else "") for i in range(3)).encode())
        if n:
            assert warc.read_warc(spark, str(tmp_path / "w")).count() == n
        else:
            with pytest.raises(ValueError, match="breaks off"):
                warc.read_warc(spark, str(tmp_path / "w"))


def test_warc_chain_over_many_splits(spark, tmp_path):
    fake = "WARC/1.1\r\nContent-Length: 1\r\n\r\nz\r\n\r\n"
    df = spark.createDataFrame([(i, "u", (fake * (i % 3)) + "p" * (i * 37 % 900)) for i in range(200)], "page_id long, url string, html string")
    warc.write_warc(df.coalesce(1), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = warc.read_warc(spark, str(tmp_path / "w"))
        assert sorted(int(r.id) for r in got.select("id").collect()) == list(range(200))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# 3


def test_decontamination_equals_brute_force(spark, sf):
    d, b = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    rows = [(r.doc_id, (r.text or "").encode()) for r in d.collect()]
    items = [(str(r.item_id), (r.text or "").encode()) for r in b.collect()]
    want = decontaminate.brute_force([t for _, t in rows], items)
    got = {r.doc_id: r for r in decontaminate.contamination_report(d, b).collect()}
    for (i, _), (n, hit, found) in zip(rows, want, strict=True):
        assert (got[i].n_words, got[i].n_hit, got[i].items_sha256, got[i].contaminated) == (n, hit, decontaminate.sha_of_items(found), hit > 0 and 20 * hit >= n)


def test_automaton_on_random_words():
    rnd = random.Random(5)
    text = lambda n, k: " ".join(rnd.choice("abcd"[:k]) for _ in range(n)).encode()
    for trial in range(150):
        items = [(str(i), text(rnd.randint(0, 9), 3)) for i in range(6)]
        own = [text(rnd.randint(0, 40), 4) for _ in range(5)]
        for w in (1, 3, 5):
            a = decontaminate.ItemAutomaton(items, w)
            for t, (n, hit, found) in zip(own, decontaminate.brute_force(own, items, w), strict=True):
                spans, got = a.scan(decontaminate.word_list(t))
                assert (sum(e - s for s, e in spans), sorted(got)) == (hit, found), (trial, w, items, t)


def test_decontamination_in_passes_and_cuts(spark):
    b = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (None, "Short item"), (3, None), (4, "..")], "item_id long, text string")
    clean = " ".join(f"c{i}" for i in range(500))
    d = docs(spark, [(1, clean + " Short, ITEM! " + clean), (2, " ".join(f"w{i}" for i in range(3, 18))), (3, None), (4, "")])
    one = decontaminate.find_hits(d, b).orderBy("doc_id").collect()
    many = decontaminate.find_hits(d, b, max_automaton_bytes=40).orderBy("doc_id").collect()
    assert [(r.hit_spans, r.hit_items) for r in one] == [(r.hit_spans, r.hit_items) for r in many]
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(d, b, max_span=1).collect()}
    assert "ITEM" not in cut[1] and cut[1].startswith("c0") and cut[3] is None
    assert decontaminate.find_hits(awkward(spark), b.limit(0)).count() == 8


# 4


def test_structure():
    page = """<html><head><title>t</title></head><body><header>top</header><nav>menu</nav><div class="cookie-notice">we use</div>
    <article><header><h1>Title &amp; more</h1></header><p>One <b>two</b>
    three.<p>Four<br>five<script>x<y</script></p><form>send</form><div id="comments"><p>first!</p></div><aside>see also</aside></article><footer>f</footer></body></html>"""
    lines = [t for s, t in html_text.page_lines(page) if s == html_text.MAIN]
    assert lines == ["Title & more", "One two three.", "Four five"]
    assert html_text.page_lines(None) == [] and html_text.page_lines("<p>a < b &lt; c") == [(html_text.OPEN, "a < b < c")]


def test_differencing_deletes_shared_lines(spark):
    page = lambda k: f"<div>Site name</div><div>Text number {k} of this page, {'long ' * 20}</div><div>Contact us</div>"
    rows = [(i, f"http://h.example/{i:03d}", page(i)) for i in range(40)] + [(90, "http://h.example/900", page(39)), (91, None, None), (92, "x", "<p>alone</p>"), (92, "x", "<p>alone</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(df, blocks=8).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for i in range(39):
        assert text[i] == f"Text number {i} of this page, {'long ' * 20}".strip()
    assert text[91] == "" and text[92] == "alone"
    assert {r.page_id: r.text for r in html_text.extract(df, blocks=1).collect()} == text
    assert html_text.extract(df.limit(0)).count() == 0


def test_names_that_only_contain_a_name_are_kept():
    main = lambda page: [t for s, t in html_text.page_lines(page) if s == html_text.MAIN]
    assert main('<div class="layout with-sidebar"><article><p>one</p></article></div>') == ["one"]
    assert main('<article class="post hentry category-social comments-open"><p>one</p></article>') == ["one"]
    assert main('<article><p class="share-price">one</p><div class="share-buttons">tweet</div><div class="comment">nice</div></article>') == ["one"]
    assert main('<div class="sidebar"><main><p>one</p></main></div><nav><article>menu</article></nav>') == ["one"]
    assert main('<article><p>one</p></article><article class="comment">nice</article><div id="comments"><article>x</article></div>')[0] == "one"


def _lcs_left(own, other):
    """Lines of ``own`` outside a longest common subsequence, as a multiset (plain dynamic programme)."""
    n, m = len(own), len(other)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = best[i][j] + 1 if own[i] == other[j] else max(best[i][j + 1], best[i + 1][j])
    return n - best[n][m]


def test_differencing_equals_brute_force(spark):
    """Pages without an article, among copies and empty pages: what remains is what no nearest neighbour shares."""
    rnd = random.Random(11)
    rows = []
    for h in range(3):
        lines = [[f"u{h}x{i}y{k}" for k in range(rnd.randint(1, 3))] for i in range(30)]
        for i in range(30):
            own = ["menu", *lines[i], *rnd.sample(["a", "b", "c", "d"], 2), "foot"]
            html = "".join(f"<div>{x}</div>" for x in own)
            rows += [(len(rows) + k, f"http://h{h}/{i:03d}/{k}", html) for k in range(rnd.choice([1, 1, 3]))]
            if rnd.random() < 0.2:
                rows.append((len(rows), f"http://h{h}/{i:03d}/9", ""))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), blocks=1).collect()}
    parsed = [(u.split("/")[2], [t for _, t in html_text.page_lines(h)], i) for i, u, h in rows]
    for k, (host, own, i) in enumerate(parsed):
        near = []
        for way in (range(k - 1, -1, -1), range(k + 1, len(parsed))):
            near += [next((o for j in way if (o := parsed[j][1]) and parsed[j][0] == host and o != own), [])]
        text = got[i].split("\n\n") if got[i] else []
        assert [x for x in own if x.startswith("u")] == [x for x in text if x.startswith("u")]
        assert "menu" not in text and "foot" not in text
        for other in near:
            assert len(text) <= _lcs_left(own, other)


def test_very_long_page(spark):
    page = "<article>" + "".join(f"<p>line {i} {'x' * 50}</p>" for i in range(40_000)) + "</article>"
    got = html_text.extract(spark.createDataFrame([(1, "http://h/a", page), (2, "http://h/b", "<div>x</div>" * 30_000)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.n_chars for r in got}[1] > 2_000_000


def test_common_lines_is_a_longest_common_subsequence():
    rnd = random.Random(3)
    for _ in range(2000):
        x, y = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        found = html_text.common_lines(x, y)
        rest = iter(y)
        assert len(found) == best[-1][-1] and all(any(c == z for z in rest) for c in [x[i] for i in sorted(found)])


# 5


def test_fingerprints(spark):
    d = spark.createDataFrame([(1, "Straße  ﬁne"), (2, "STRASSE fine"), (3, "e\u0301t"), (4, "\u00e9t"), (5, None), (6, ""), (7, "other"), (None, "x"), (7, "other")], "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    got = [(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(d).collect()]
    by = {}
    for i, f in got:
        by.setdefault(f, []).append(i)
    assert sorted(sorted(map(str, x)) for x in by.values()) == sorted([["1", "2"], ["3", "4"], ["5", "6"], ["7", "7"], ["None"]])
    pairs = fingerprint.fingerprint_pairs(d).collect()
    assert len(pairs) == 9
    order = sorted([(i, t or "") for i, t in [(1, "Straße  ﬁne"), (2, "STRASSE fine"), (3, "e\u0301t"), (4, "\u00e9t"), (5, None), (6, ""), (7, "other"), (7, "other")]], reverse=True) + [(None, "x")]
    want = []
    for k, (i, t) in enumerate(order):
        half, following = len(t) // 2, order[(k + 1) % len(order)][1]
        want.append((str(i), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in pairs) == sorted(want)
    assert fingerprint.fingerprint_pairs(d.limit(0)).count() == 0


def test_fingerprint_pairs_equal_brute_force(spark):
    import unicodedata

    def canonical(t):
        return re.sub(r"[\s\x85\u00a0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip(" ")

    texts = ["Straße  ﬁne", "STRASSE fine", "strasse\u00a0fine ", "é", "É", None, "", "same same", "same same", "x" * 200_000, "ab", "AB", "aBc d", "Ⅷ viii"]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprint.fingerprint_pairs(docs(spark, rows).repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    whole = {}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        whole[i] = (t, t[: len(t) - half] + following[:half], following)
    forms = {}
    for i, (t, changed, following) in whole.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canonical(t) == canonical(changed)), float(canonical(t) == canonical(following)))
        assert forms.setdefault(canonical(t), r.fingerprint) == r.fingerprint and forms.setdefault(canonical(changed), r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(forms.values())) == len(forms)


def test_bytes_are_compared_in_equal_buckets(spark):
    forms = spark.createDataFrame([("h", "a"), ("h", "b"), ("k", "c "), ("k", "C")], "hash string, form string")
    shared = spark.createDataFrame([("h",), ("k",)], "hash string")
    assert [r.hash for r in fingerprint.different_forms(forms, shared).collect()] == ["h"]


# 6


def test_licenses(spark):
    text = "Intro.\nReleased under the MIT License.\nSome license of mine, quite unlike any.\nThis work is licenced under the GNU General Public License, version 3.\n" + LONG
    d = docs(spark, [(1, text), (2, None), (3, ""), (4, "x " * 400 + "Licensed under CC BY-NC 4.0. " + "y " * 400), (4, "Licensed under CC BY 4.0.")])
    got = licenses.license_report(d).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "GPL-3.0"), (1, "MIT"), (4, "CC-BY-4.0"), (4, "CC-BY-NC-4.0")]
    assert all(r.reduction > 0 for r in got)
    assert next(r.notice for r in got if r.license == "MIT") == "Released under the MIT License"
    assert licenses.find_licenses(d.limit(0)).count() == 0


def test_all_licenses_of_a_block(spark):
    text = [
        "Licensed under the MIT License. Licensed under the Apache License, Version 2.0.",
        "Released under the MIT License. All rights reserved. " + "z " * 300 + "Licensed under CC BY 4.0. All rights reserved. Licensed under CC BY 4.0.",
    ]
    got = [[(h["license"], t[h["start"] : h["end"]]) for h in licenses.Scanner().scan(t)] for t in text]
    assert got[0] == [("MIT", "Licensed under the MIT License"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0")]
    assert [name for name, _ in got[1]] == ["MIT", "proprietary", "CC-BY-4.0", "proprietary", "CC-BY-4.0"]
    many = " ".join(t for _, t in licenses.TEMPLATES)
    assert len(licenses.Scanner().scan(many)) >= len(licenses.TEMPLATES)


def test_wrapped_licenses():
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
    gpl = [
        " * This program is free software: you can redistribute it and/or modify", " * it under the terms of the GNU General Public License as published by",
        " * the Free Software Foundation, either version 3 of the License, or", " * (at your option) any later version.",
    ]
    scan = licenses.Scanner().scan
    for text, name in ((mit, "MIT"), (bsd, "BSD-3-Clause"), ("\r\n".join(gpl), "GPL-3.0"), ("// All rights\n// reserved.", "proprietary")):
        text = "before it\n\n" + text + "\n\nafter it " + "z " * 200
        assert [(h["license"], h["n_different"]) for h in scan(text)] == [(name, 0)]
    both = scan(f"{bsd}\n\n{mit}\n")
    assert [h["license"] for h in both] == ["BSD-3-Clause", "MIT"] and both[0]["end"] <= both[1]["start"]
    for i, (name, template) in enumerate(licenses.TEMPLATES):
        for k in (1, 2, 5):
            ws = template.split()
            text = "\n".join(" ".join(ws[j : j + k]) for j in range(0, len(ws), k))
            assert [h["license"] for h in scan(text)] == [h["license"] for h in scan(template)]
            assert scan(text)[0]["license"] == name


def test_scan_equals_a_scan_of_the_whole_text_as_one_block():
    """What pieces select loses nothing: edited templates among other words, against all words as one block."""
    rnd, scanner = random.Random(5), licenses.Scanner()
    stock = sorted({w for t in scanner.texts for w in t})
    for _ in range(60):
        own = []
        for _ in range(rnd.randint(1, 3)):
            own += [rnd.choice(stock) if rnd.random() < 0.2 else f"z{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 30))]
            ws = list(rnd.choice(scanner.texts))
            for _ in range(rnd.randint(0, max(1, len(ws) // 6))):
                k = rnd.randrange(len(ws))
                ws[k : k + 1] = rnd.choice([[], ["q"], [ws[k], "q"]])
            own += ws
        text = " ".join(own)
        whole = [(name, d) for _, _, name, _, d in scanner.stretches(licenses.words(text))]
        assert [(h["license"], h["n_different"]) for h in scanner.scan(text)] == whole


def _plain_notices(scanner, own):
    """All stretches of all templates by a plain edit distance; overlapping ones are settled by compression."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i] + [0] * len(b), row
            for j, y in enumerate(b, 1):
                row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
        return row[-1]

    near = []
    for k, t in enumerate(scanner.texts):
        most = int(licenses.MAX_DIFFERENCE * len(t))
        spans = [(i, j) for i in range(len(own)) for j in range(max(i + 1, i + len(t) - most), min(len(own), i + len(t) + most) + 1)]
        best = {}
        for i, j in spans:
            d = edits(own[i:j], t)
            if d <= most:
                best.setdefault(j, []).append((d, i))
        chosen = []
        for j, found in sorted(best.items(), key=lambda x: (min(x[1])[0], x[0])):
            d = min(found)[0]
            starts = {i for e, i in found if e == d}
            if all(j <= a or max(starts) >= b for a, b, _ in chosen):
                chosen.append((max(starts), j, d))
        near += [(i, j, k, d) for i, j, d in chosen]
    return near


def test_compression_decides_between_near_templates(monkeypatch):
    """Edited wordings that are as many words from several templates: size decides, and without it others are named."""
    scanner = licenses.Scanner()
    texts = {
        "This work is licensed under a Creative Commons Attribution-ShareAlike-Plus 4.0 International License": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercially 4.0 International License": "CC-BY-NC-4.0",
        "This work is licensed under the GNU Affero3 General Public License, version 3.": "AGPL-3.0",
    }
    got = {t: [h["license"] for h in scanner.scan(f"before {t} after")] for t in texts}
    assert {t: names for t, names in got.items()} == {t: [name] for t, name in texts.items()}
    monkeypatch.setattr(licenses.Scanner, "size", lambda self, own, template: 1)
    without = {t: [h["license"] for h in scanner.scan(f"before {t} after")] for t in texts}
    assert without != got


def test_licenses_equal_brute_force():
    """Random edits of near-equal templates among other words against all stretches of all templates."""
    rnd = random.Random(11)
    some = [(n, t) for n, t in licenses.TEMPLATES if len(licenses.words(t)) < 24]
    scanner, stock = licenses.Scanner(some), ["license", "the", "under", "version", "4.0", "this"]
    for _ in range(40):
        own = []
        for _ in range(rnd.randint(1, 2)):
            own += [rnd.choice(stock) if rnd.random() < 0.3 else f"z{rnd.randint(0, 9)}" for _ in range(rnd.randint(1, 6))]
            ws = list(rnd.choice(scanner.texts))
            for _ in range(rnd.randint(0, 2)):
                ws[rnd.randrange(len(ws))] = rnd.choice(["q", "sharealike", "3", "2"])
            own += ws
        near = {(j, k, d) for _, j, k, d in _plain_notices(scanner, own)}
        assert {(j, k, d) for block in scanner._candidates(own, set(range(len(some)))) for _, j, k, d in block} == near
        got = scanner.scan(" ".join(own))
        for h in got:  # what is named compresses its own block at least as well as any other template near it
            stretch = licenses.words(" ".join(own)[h["start"] : h["end"]])
            rivals = [k for k, t in enumerate(scanner.texts) if abs(len(t) - len(stretch)) <= int(licenses.MAX_DIFFERENCE * len(t)) and licenses.best_window(stretch, t)[0] <= int(licenses.MAX_DIFFERENCE * len(t))]
            mine = [k for k in rivals if scanner.names[k] == h["license"]]
            assert min(scanner.size(stretch, k) for k in mine) <= min(scanner.size(stretch, k) for k in rivals)
        assert bool(got) == bool(near)


def test_license_report_of_clashing_columns(spark):
    d = docs(spark, [(1, "Licensed under CC BY 4.0.")]).withColumns({"licenses": F.lit("mine"), "notice": F.lit(1)})
    assert licenses.find_licenses(d).columns == [*(c for c in d.columns if c != "licenses"), "licenses"]
    assert [r.license for r in licenses.license_report(d).collect()] == ["CC-BY-4.0"]


def test_near_windows_lose_none():
    rnd = random.Random(3)
    for _ in range(300):
        template = [rnd.choice("abcde") for _ in range(rnd.randint(2, 14))]
        block = [rnd.choice("abcdexyz") for _ in range(rnd.randint(1, 20))]
        at = rnd.randint(0, len(block))
        block[at:at] = [w for w in template if rnd.random() > 0.1]
        cost, start = licenses.window_ends(block, template)
        want = {(c, j) for j, c in enumerate(cost) if c <= licenses.MAX_DIFFERENCE * len(template) and j > start[j]}
        assert {(d, j) for d, _, j in licenses.near_windows(block, template, set(template))} == want


def test_best_window_is_least_edits():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i] + [0] * len(b), row
            for j, y in enumerate(b, 1):
                row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
        return row[-1]

    rnd = random.Random(1)
    for _ in range(300):
        block, template = ([rnd.choice("abc") for _ in range(rnd.randint(1, n))] for n in (9, 5))
        n, a, b = licenses.best_window(block, template)
        spans = [(i, j) for i in range(len(block) + 1) for j in range(i, len(block) + 1)]
        assert n == min(edits(block[i:j], template) for i, j in spans) == edits(block[a:b], template)


# 7


def test_toxicity_held_out(spark):
    rnd = random.Random(2)
    plain = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(900):
        bad = i % 5 == 0
        ws = [rnd.choice(plain) for _ in range(60)] + (["awfulest", "horribly"] if bad else [])
        rnd.shuffle(ws)
        rows.append((i, " ".join(ws)))
        if i < 600:
            marks.append((i, int(i % 2), int(bad)))
    d = docs(spark, rows)
    lab = spark.createDataFrame([*marks, (None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    held_out = [i for i in range(600, 900)]
    right = sum((i in left) == (i % 5 != 0) for i in held_out)
    assert right >= 0.98 * len(held_out)
    a = awkward(spark)
    assert toxicity.toxicity_report(a, lab).count() == 8
    assert toxicity.drop_toxic(a, lab.limit(0)).count() == 8 and toxicity.drop_toxic(a.limit(0), lab).count() == 0


def test_words_that_a_stem_implies_come_last():
    ranked = [(b"abcd*", 9.0), (b"abcdef*", 9.0), (b"abcdxy", 8.0), (b"abcd", 7.0), (b"mnopq", 6.0), (b"stuvwxy", 5.5), (b"stuvw*", 5.0)]
    assert toxicity.spread_out(ranked) == [b"abcd*", b"abcd", b"mnopq", b"stuvwxy", b"stuvw*", b"abcdef*", b"abcdxy"]
    assert toxicity.spread_out(ranked, 2) == [b"abcd*", b"abcd"]


def _plain_chain(values, labels, folds):
    """Gradient descent with plain loops over categories and folds: probabilities of the training rows, and what later models saw."""

    def fitted(x, y):
        x = np.hstack([x, np.ones((len(x), 1))])
        ridge = np.array([0.1] * (x.shape[1] - 1) + [1e-6])
        w, step = np.zeros(x.shape[1]), 4.0 / (np.linalg.norm(x, 2) ** 2 + 1)
        for _ in range(60_000):
            w -= step * (x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + ridge * w)
        return lambda z: 1 / (1 + np.exp(-(np.hstack([z, np.ones((len(z), 1))]) @ w)))

    earlier_in, earlier_out, result = np.zeros((len(folds), 0)), np.zeros((len(folds), 0)), []
    for x, y in zip(values, labels, strict=True):
        whole = fitted(np.hstack([x, earlier_out]), y)
        p = whole(np.hstack([x, earlier_in]))
        out = np.zeros(len(y))
        for f in set(folds.tolist()):
            rows = folds != f
            out[~rows] = fitted(np.hstack([x, earlier_out])[rows], y[rows])(np.hstack([x, earlier_out])[~rows])
        result.append(p)
        earlier_in, earlier_out = np.hstack([earlier_in, p[:, None]]), np.hstack([earlier_out, out[:, None]])
    return result


def test_chain_equals_plain_version():
    """Probabilities of a chain of three categories; later models are fitted on out-of-fold ones and score with those of the earlier models."""
    rng = np.random.default_rng(3)
    values = [rng.integers(0, 2, (60, k)).astype(float) for k in (3, 2, 1)]
    labels = [(values[0][:, 0] + rng.random(60) > 0.8).astype(int), (values[0][:, 1] + values[1][:, 0] + rng.random(60) > 1.3).astype(int), rng.integers(0, 2, 60)]
    folds = rng.integers(0, toxicity.FOLDS, 60)
    chain = toxicity.fit_chain(values, [[b"a"] * v.shape[1] for v in values], dict(zip("xyz", labels, strict=True)), folds)
    before = np.zeros((60, 0))
    for m, x, want in zip(chain.models, values, _plain_chain(values, labels, folds), strict=True):
        p = toxicity._sigmoid(m.logits(x, before))
        assert np.abs(p - want).max() < 1e-4
        before = np.hstack([before, p[:, None]])


def test_training_rows_are_bounded(spark):
    """A label row repeated many times, of a document repeated many times, is no more than the bound."""
    d = spark.range(40).select((F.col("id") % 2).alias("doc_id"), F.lit("bad words here").alias("text"))
    lab = spark.range(300).select((F.col("id") % 2).alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    rows = toxicity.training_rows(d, lab, toxicity.CATEGORIES, 50)
    assert 0 < rows.count() <= 50
    few = toxicity.training_rows(d.limit(2), lab.limit(2), toxicity.CATEGORIES, 50)
    assert few.count() == 2


def test_settings_reach_the_models(spark):
    d = docs(spark, [(i, ("vile " if i % 2 else "kind ") + f"w{i}") for i in range(40)])
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_report(d, lab).where("toxic").count() == 20
    assert toxicity.toxicity_report(d, lab, toxicity.Settings(least_docs=50)).where("toxic").count() in (0, 40)
    assert toxicity.toxicity_report(d, lab, toxicity.Settings(limit=0.0)).where("toxic").count() == 40


def test_toxicity_of_ties_long_texts_and_clashing_names(spark):
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, "vile foul" if i % 2 else "kind fair") for i in range(40)] + [(100, "vile " + LONG), (101, LONG + " foul"), (102, LONG)]
    d = docs(spark, rows).withColumns({"p_low_quality": F.lit("mine"), "toxic": F.lit(7), "__text": F.lit("t")})
    first, again = ({r.doc_id: r.p_toxic for r in toxicity.toxicity_report(d.repartition(n), lab).collect()} for n in (1, 5))
    assert first == again and first[1] > 0.5 > first[0]
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and {r.p_low_quality for r in kept.collect()} == {"mine"}


def test_chain_feeds_earlier_predictions():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 1)).astype(float)
    first = x[:, 0]
    chain = toxicity.fit_chain([x, np.zeros((400, 0))], [[b"a"], []], {"one": first, "two": first}, rng.integers(0, 5, 400))
    assert chain.models[1].earlier[0] > 1


# 8


def _near(spark, rows):
    return {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_classes(docs(spark, rows)).collect()}


def test_join_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for g in range(25):
        base = [f"g{g}w{rnd.randint(0, 80)}" for _ in range(rnd.choice([3, 8, 60, 200]))]
        for _ in range(rnd.randint(1, 8)):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = f"x{rnd.randint(0, 9)}"
            rows.append((len(rows), " ".join(own)))
    assert _near(spark, rows) == ngram_join.brute_force([(i, t.encode()) for i, t in rows])


def test_join_splits_large_buckets_and_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    shared = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(2):
            own[rnd.randrange(150)] = f"y{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, shared + " " + " ".join(f"z{i}v{j}" for j in range(120))) for i in range(80)]
    want = ngram_join.brute_force([(i, t.encode()) for i, t in rows])
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_classes(docs(spark, rows), limit=10).collect()}
    assert got == want


def _group(rnd, size, edits, name, n=300):
    """Texts that differ from one text by up to so many words each."""
    base = [f"{name}{i}" for i in range(n)]
    for i in range(size):
        own = list(base)
        for _ in range(rnd.randint(0, edits)):
            own[rnd.randrange(n)] = f"{name}x{i}y{rnd.randint(0, 9)}"
        yield " ".join(own)


@pytest.mark.parametrize("edits", [2, 8, 14])
def test_large_components_by_slack(spark, monkeypatch, edits):
    """Near a reference (few edits), around the threshold, and far from it."""
    for name, value in (("BLOCK", 12), ("REFERENCE", 5)):
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(edits)
    texts = [t for g in "abc" for t in _group(rnd, 50, edits, g)]
    rows = list(enumerate(texts + texts[:7]))
    assert _near(spark, rows) == ngram_join.brute_force([(i, t.encode()) for i, t in rows])


def test_crowded_buckets_at_the_last_level(spark, monkeypatch):
    """Buckets that no token splits any further are compared in blocks; large tables are looked up without broadcast."""
    for name, value in (("MAX_BROADCAST_MEMBERS", 3), ("HOT", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(8)
    rows = list(enumerate(t for g in "ab" for t in _group(rnd, 30, 3, g, 60)))
    want = ngram_join.brute_force([(i, t.encode()) for i, t in rows])
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_classes(docs(spark, rows), limit=4).collect()} == want


def test_sketches_tell_small_sets_apart():
    """Unrelated short texts are no candidates, however few bins they occupy."""
    rnd, shingles = random.Random(3), ngram_join.Shingler()
    sets = [shingles(" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(1, 60))).encode()) for _ in range(400)]
    sk = ngram_join._Sketches([ngram_join._sketch(s) for s in sets], np.array([len(s) for s in sets]), 0.8)
    i, j = np.triu_indices(len(sets), 1)
    assert sk.similar(i, j).sum() <= 5


def test_join_of_awkward_rows(spark):
    a = awkward(spark)
    got = ngram_join.near_classes(a).collect()
    assert len(got) == 8 and [r.n_links for r in got if r.doc_id == 3] == [1, 1]
    kept = ngram_join.keep_one(a)
    assert kept.columns == a.columns and kept.count() == 7  # of the repeated row one stays
    assert ngram_join.near_classes(a.limit(0)).count() == 0
    both = docs(spark, [(1, "a b c d e f"), (2, "q r s t u v"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "k l m"), (None, "k l m")])
    assert sorted((r.doc_id or 0, r.text) for r in ngram_join.keep_one(both).collect()) == [(0, "k l m"), (1, "a b c d e f"), (2, "q r s t u v")]
    with_copies = docs(spark, [(5, "a b c d e f"), (2, "a b c d e f"), (9, None), (8, None)])
    assert sorted(r.doc_id for r in ngram_join.keep_one(with_copies).collect()) == [2, 8, 9]


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40) if i != 20] + [("x", "x")]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{i:03d}": "000" if i <= 20 else "021" for i in range(41)}


# 9


@pytest.mark.parametrize("shapes, rules", [(url_filter.MAX_SHAPES, url_filter.MAX_BROADCAST_RULES), (0, url_filter.MAX_BROADCAST_RULES), (0, 1)])
def test_urls(spark, monkeypatch, shapes, rules):
    """Rows with their expressions beside them, and a row for each expression with and without a broadcast."""
    monkeypatch.setattr(url_filter, "MAX_SHAPES", shapes)
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", rules)
    cases = {
        "http://a.example.com/en/1": "block", "http://example.com/en/77": "allow", "http://EXAMPLE.com/en/7#x": "allow", "http://xexample.com/en/7": "block", "https://b.example.net/de/8?q": "block",
        "http://" + "a." * 20_000 + "net/de/8": "allow", "http://" + "a." * 20_000 + "example.net/de/8": "block", "ftp://net/de/": "allow", "http://example.org": "allow", "no url": "allow", "": "allow", "x://y://org/es/": "allow", "http://org/es/?a": "block",
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(99, None), (None, "http://a.org/es/1"), (0, next(iter(cases)))]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = url_filter.filter_urls(df, url_filter.production_rules(spark))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and got.count() == len(rows)
    for r in got.collect():
        assert r.verdict == cases.get(r.url, "block" if r.url else "allow"), r
    assert {r.url: (r.host, r.path) for r in got.collect()}["http://EXAMPLE.com/en/7#x"] == ("example.com", "/en/7")
    assert url_filter.filter_urls(df, url_filter.production_rules(spark).limit(0)).where("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(df.limit(0), url_filter.production_rules(spark)).count() == 0


def test_rules_of_one_expression_and_of_no_path(spark):
    rules = spark.createDataFrame([("block", "a.b", "/x"), ("allow", "a.b", "/x"), ("block", "b", None), ("allow", "", "/x"), ("block", None, "/x")], "verdict string, host string, path string")
    df = spark.createDataFrame([("http://c.a.b/xy",), ("http://q.b/",), ("http://q.c/x",), ("http:///x",)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {"http://c.a.b/xy": ("a.b/x", "allow"), "http://q.b/": ("b", "block"), "http://q.c/x": (None, "allow"), "http:///x": (None, "allow")}


# 10


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    rnd = random.Random(1)
    pool = "abzAZ019 .,'\"\n\t éèÉ\u0301ÀΣσς İıß漢字ガ한국ـ١²½Ⅳ\u200b\u3000\x1c\x1f\x85😀ﬁ<|>'s're\ufeff\x00"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + ["<|endoftext|> a<|startoftext|>b", "a" * 5000, LONG, None, ""]
    d = docs(spark, list(enumerate(texts)))
    for most in (20, bpe.MAX_TABLE_WORDS):
        got = {r.doc_id: r for r in bpe.digests(d, max_words=most).collect()}
        for i, text in enumerate(texts):
            ids = t.encode(text or "", add_special_tokens=False).ids
            digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False))), repr(text)[:200]
    both = bpe.decode(bpe.encode(d)).orderBy("doc_id").collect()
    assert [r.decoded for r in both[:50]] == [t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False) for x in texts[:50]]
    assert bpe.digests(d.limit(0)).count() == 0


# all


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_equals_its_parts(spark, sf):
    import corpus_pipeline

    d = read(spark, sf, "documents")
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    chain = toxicity.train(d, read(spark, sf, "labels"), categories=toxicity.CATEGORIES)
    mild = {r.doc_id for r in toxicity.score(d, chain).where(F.col("p_toxic") < toxicity.PRODUCTION.limit).collect()}
    rows = [(r.doc_id, (r.text or "").encode()) for r in d.orderBy("doc_id").collect() if r.doc_id in mild]
    first = {i for i, (c, _) in ngram_join.brute_force(rows).items() if i == c}
    items = [(str(r.item_id), (r.text or "").encode()) for r in read(spark, sf, "benchmark").collect()]
    own = [(i, t) for i, t in rows if i in first]
    want = {i for (i, _), (n, hit, _) in zip(own, decontaminate.brute_force([t for _, t in own], items), strict=True) if not (hit and 20 * hit >= n)}
    assert got == want
    types = {f.name: f.dataType for f in corpus_pipeline.near_duplicates_stage(spark, d, sf).schema.fields}
    assert types["doc_id"] == T.LongType() and list(types) == d.columns


def test_pipeline_of_awkward_rows(spark, sf):
    import corpus_pipeline

    out = awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
    assert out.count() == 7  # of the repeated row one stays


def test_intermediate_tables_go(spark):
    from pathlib import Path

    from tidewater.llm import common

    rows = [(i, f"a b c d e f g {i % 3}") for i in range(12)]
    before = len(common.WRITTEN)
    assert ngram_join.near_classes(docs(spark, rows)).count() == 12
    assert len(common.WRITTEN) == before + 2 and all(Path(p).exists() for p in common.WRITTEN.paths[before:])
