"""Each operator on odd rows (null, empty, repeated, very long, clashing columns), on empty tables, and against brute force."""

import base64
import collections
import hashlib
import random
import re
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from moorline.llm import chat, decontaminate, html_crf, html_extract, imatch, neardup, packing, pii, pii_model, quality, tokenfile, tokens, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, made string"
rng = random.Random(5)
WORDS = ["".join(rng.choice("bdklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]


def prose(n, seed):
    own = random.Random(seed)
    return " ".join(own.choice(WORDS) for _ in range(n))


def edited(text, every, seed):
    own = random.Random(seed)
    return " ".join(own.choice(WORDS) if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


BASE = prose(120, 1)
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, BASE), (5, BASE), (None, BASE), (6, BASE), (7, edited(BASE, 40, 2)), (8, edited(BASE, 3, 3)), (9, prose(30_000, 4)), (10, "été 東京 “x”  two\r\n\r\nspaces"), (11, prose(40, 6))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "x") for i, t in ODD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Quality ---------------------------------------------------------------------------------------------------------


def test_quality_learns_and_scores_all(spark):
    rows = [(i, prose(60, i) + ".") for i in range(120)] + [(1000 + i, " ### ".join(prose(30, i).split()[:25]).upper()) for i in range(80)] + [(5000, None), (5001, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows if i < 5000 and i % 2 == 0] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(table, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = [r.predicted == int(r.doc_id < 1000) for r in got if r.doc_id < 5000 and (r.held_out or r.doc_id % 2)]
    assert sum(right) / len(right) > 0.97
    kept = quality.accept(table, labels)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality_of_nothing(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.score(docs, labels).collect()} == {0.5}
    assert quality.score(none, labels).count() == 0


def test_quality_learns_from_a_sample_and_counts_every_label(spark, monkeypatch):
    rows = [(i, prose(60, i) + ".") for i in range(400)] + [(1000 + i, " ### ".join(prose(30, i).split()[:25]).upper()) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows] + [(3, 0), (3, 1)], "doc_id bigint, quality int")
    whole = quality.marked(labels).count()
    assert whole == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows) + 2 * (zlib.crc32(b"3") % 5 != 0)
    monkeypatch.setattr(quality, "SAMPLE", 200)
    assert 120 < quality.marked(labels).count() < 280
    got = quality.score(table, labels).collect()
    assert len(got) == len(rows) and sum(r.predicted == int(r.doc_id < 1000) for r in got) / len(got) > 0.97


def test_quality_learns_in_one_python_run_a_task(spark, monkeypatch):
    table = spark.createDataFrame([(i, prose(60, i)) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    kind, runs = type(table), []
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, own=kind.mapInArrow, **b: runs.append(a) or own(self, *a, **b))
    assert quality.fit(table, labels).means is not None and len(runs) == 1


def test_quality_matches_plain_densities():
    r = np.random.default_rng(1)
    d = len(quality.NAMES)
    x = [r.normal(size=(200, d)), r.normal(1.0, 2.0, size=(300, d))]
    sums = {c: np.concatenate([[len(x[c])], x[c].sum(axis=0), (x[c].T @ x[c]).ravel()]) for c in (0, 1)}
    model = quality.model_from(sums)
    covs = [np.cov(v.T, bias=True) for v in x]
    pooled = (200 * covs[0] + 300 * covs[1]) / 500
    logs = []
    for c, share in ((0, 0.4), (1, 0.6)):
        cov = (1 - quality.POOLED - quality.RIDGE) * covs[c] + quality.POOLED * pooled + (quality.RIDGE * np.trace(pooled) / d + 1e-9) * np.eye(d)
        gap = x[1][:5] - x[c].mean(axis=0)
        logs.append(np.log(share) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    assert model.scores(x[1][:5]) == pytest.approx(1 / (1 + np.exp(-(logs[1] - logs[0]) / quality.TEMPERATURE)), abs=1e-6)


# Decontamination -------------------------------------------------------------------------------------------------


def brute_hits(text, bench):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hit, items = set(), set()
    for item, passage in bench:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (passage or "").translate({c: c + 32 for c in range(65, 91)}))
        if item is None or not own:
            continue
        size = min(8, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                items.add(str(item))
    return len(words), len(hit), sorted(items)


@pytest.mark.parametrize("limit", [decontaminate.MAX_PATTERN_CHARS, 400])
def test_decontamination_against_brute_force(spark, limit):
    bench = [(1, prose(30, 50)), (2, prose(12, 51)), (2, prose(9, 52)), (3, "Tiny Item"), (4, None), (5, "..."), (None, prose(20, 53)), (10, prose(30, 50))]
    texts = [None, "", prose(50, 54), "x, " + bench[0][1].upper().replace(" ", " -- ") + "! y", bench[1][1] + " tiny; item " + bench[2][1], "tiny item", "etiny item", " ".join(bench[0][1].split()[3:11]), prose(20_000, 55) + " " + bench[1][1]]
    table = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7)], "doc_id bigint, text string, n_words int")
    marks = spark.createDataFrame(bench, "item_id bigint, text string")
    rows, name = decontaminate.hits(table, marks, limit=limit)
    got = rows.select("doc_id", "text", F.col(name).alias("h")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.h.n_words, r.h.n_hit, list(r.h["items"])) == brute_hits(r.text, bench)
        told = " ".join(r.text[s.start : s.end] for s in r.h.spans) if r.text else ""
        assert brute_hits(told, [])[0] == r.h.n_hit
    clean = decontaminate.clean(table, marks)
    assert clean.columns == table.columns and sorted(r.doc_id for r in clean.collect()) == [0, 1, 2, 6]


def test_decontamination_report(spark, docs, none):
    marks = spark.createDataFrame([(1, BASE)], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.report(docs, marks).collect()}
    assert got[6].n_items == 1 and not got[6].contaminated and got[6].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert got[1].items_sha256 == hashlib.sha256(b"").hexdigest() and got[1].n_words == 0
    assert decontaminate.report(none, marks).count() == 0
    assert decontaminate.report(docs, marks.limit(0)).where("n_hit > 0").count() == 0


# HTML ------------------------------------------------------------------------------------------------------------


def test_field_on_unseen_pages():
    weights, moves = html_extract.fitted()
    pages = html_crf.labelled_pages(300, seed=99)
    right = sum(html_extract.main_text(p, weights, moves) == " ".join(" ".join(k.split()) for k in kept) for p, kept in pages)
    assert right / len(pages) > 0.97


def test_viterbi_is_the_best_path():
    weights, moves = html_extract.fitted()
    own = random.Random(3)
    for _ in range(20):
        on = [sorted(own.sample(range(len(html_crf.NAMES)), 6)) for _ in range(7)]
        value = lambda y: sum(weights[f, k].sum() for f, k in zip(on, y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(([(i >> k) & 1 for k in range(7)] for i in range(128)), key=value)
        assert value(html_crf.decode(on, weights, moves)) == pytest.approx(value(best))


def test_extraction(spark):
    page = "<html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  \n part <b>bold</b>text, and<br>more of it here.<p>Second part, which is long enough, goes on.<script>var a='</p>';</script></article><div class='comments'><p>I say, that was good, and long.</p></div><footer>&copy; x</footer>"
    table = spark.createDataFrame([(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, "t"), (3, "v", "", "t"), (4, "w", "<", "t")], "page_id bigint, url string, html string, text string")
    got = sorted(html_extract.extract(table).collect(), key=lambda r: (r.page_id, r.text))
    expected = "A & B First part boldtext, and more of it here. Second part, which is long enough, goes on."
    assert [r.text for r in got[:4]] == [expected, expected, "", ""] and got[0].n_chars == len(expected)
    assert html_extract.extract(table.limit(0)).count() == 0


TALK = "Some people walked along the river in the evening, and they talked about the weather. It was late."
HEAD = "<head><title>No</title><meta charset=utf-8></head>"
#: Pages written by hand, and their articles.
HAND = [
    (f"<div><p>{TALK}</p><p>{TALK}</p></div>", [TALK, TALK]),
    (f"<div class='foo'><p>{TALK}</p><p>{TALK}</p><p>{TALK}</p></div>", [TALK] * 3),
    (f"<nav><a href=/>Home</a> <a href=/b>About us</a></nav><p>{TALK}</p><p>{TALK}</p><footer>&copy; x 2020</footer>", [TALK, TALK]),
    (TALK, [TALK]),
    (f"<html>{HEAD}<body><h1>Evening on the river</h1><p>{TALK}</p><ul><li>one thing to see</li><li>another thing</li></ul><p>{TALK}</p></body></html>", ["Evening on the river", TALK, "one thing to see", "another thing", TALK]),
    (f"<html>{HEAD}<body><div id=header><h2>Site</h2></div><div id=wrap><div><h1>On rivers</h1><p>{TALK}</p></div><div class=sidebar><h3>More</h3><p>{TALK}</p></div></div><div id=comments><p>{TALK}</p></div></body></html>", ["On rivers", TALK]),
    (f"<body><header><p>Daily news for all</p></header><main><article class=post><h2>Rivers</h2><p>{TALK}<p>{TALK}<aside><p>{TALK}</p></aside></article><section class=comments><h3>Two replies</h3><div class=comment><p>{TALK}</p></div></section></main>", ["Rivers", TALK, TALK]),
    (f"<article><p>{TALK} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><object><p>{TALK}</p></object></article>", [TALK + " x=2", TALK]),
    (f"<article><p>{TALK}</p><svg viewBox='0 0'><path d='M0'><text>no</text><p>{TALK}</p></article>", [TALK, TALK]),
    (f"<article><p>{TALK}</p><div><select><option>one<option>two</div><p>{TALK}</p></article>", [TALK, TALK]),
    (f"<article><div><template><div>no</div>nor this</div><p>{TALK}</p><video src=x><p>old browser</p></video></article>", [TALK]),
    (f"<article><p>{TALK}</p><canvas>no<p>{TALK}</canvas><p>{TALK}</p></article>", [TALK, TALK]),
]


def test_pages_written_by_hand():
    weights, moves = html_extract.fitted()
    for page, parts in HAND:
        assert html_extract.main_text(page, weights, moves) == " ".join(parts), page


def test_a_very_long_page():
    weights, moves = html_extract.fitted()
    page = f"<body><nav><a href=/>Home</a></nav><article>{f'<p>{TALK}</p>' * 8000}</article><footer>&copy; x</footer>" + "<div>" * 3000
    assert html_extract.main_text(page, weights, moves) == " ".join([TALK] * 8000)


def test_code_is_no_markup():
    article = "<article><h1>Title</h1><p>First part, long enough to be read, goes on.</p></article>"
    expected = [b[1] for b in html_extract.blocks(article)]
    assert expected == ["Title", "First part, long enough to be read, goes on."]
    code = ["for(i=0;i<n;i++){f()}", "if(a<b.length)g('", 'x="<p>a', "<!-- old", "<![CDATA[", "a</scripts b", "</p>'"]
    for c in code:
        for raw in ("<script>{}</script>", "<SCRIPT type='a'>{}</Script\n>", "<style>{}</style >", "<textarea>{}</textarea>", "<svg><style>{}</style></svg>", "<template><p>no</p><script>{}</script></template>"):
            assert [b[1] for b in html_extract.blocks(raw.format(c) + article)] == expected, (raw, c)
    assert html_extract.blocks("<script>i<n" + article) == []
    weights, moves = html_extract.fitted()
    page = "<html><head>{}</head><body>" + article + "</body></html>"
    assert html_extract.main_text(page.format("<script>for(i=0;i<n;i++){f()}</script>"), weights, moves) == html_extract.main_text(page.format(""), weights, moves)


# Near duplicates --------------------------------------------------------------------------------------------------


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        own = (t or "").encode().lower().split()
        n = min(words, len(own))
        sets[i] = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
    top = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and top[a] != top[b]:
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    return sets, top


def test_near_duplicates_against_brute_force(spark):
    rows = [(i, t) for i, t in dict(r for r in ODD if r[0] is not None and r[0] != 9).items()]
    for g in range(6):
        base = prose(80 + 30 * g, 100 + g)
        rows += [(100 * (g + 1) + k, edited(base, 6 + 7 * (k % 6), 200 + k + 31 * g) if k % 4 else base) for k in range(16)]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, kept int").repartition(4)
    for words in (2, 5):
        sets, top = brute_components(rows, words, 80)
        got = neardup.near_duplicates(table, words, 80).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), top[i], top[i] == i) for i, _ in rows}


def test_near_duplicates_of_odd_rows(spark, docs, none):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert {r.component_id for r in by[6] + by[7]} == {5} and [r.kept for r in by[5]] == [True, True]
    assert by[None][0].kept and by[1][0].n_shingles == 0 and by[1][0].kept and by[2][0].component_id == 2
    kept = neardup.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5, 8, 9, 10, 11]
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_texts_that_share_an_id(spark):
    other, third = prose(120, 51), prose(90, 52)
    rows = [(1, BASE), (1, other), (2, edited(BASE, 40, 1)), (3, edited(other, 40, 2)), (4, third), (1, BASE), (9, edited(third, 50, 3))]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (9, 4)}


def test_large_groups_of_near_copies_lose_no_link(spark, monkeypatch):
    """Chains of edits that leave a group's ends apart: links that no hub shows, over several blocks and streams."""
    monkeypatch.setattr(neardup, "BLOCK", 20)
    monkeypatch.setattr(neardup, "STREAM", 30)
    rows, now = [], prose(150, 60)
    for k in range(90):
        rows.append((k, now))
        now = edited(now, 31 if k % 7 else 14, 61 + k)
    base = prose(100, 70)
    rows += [(1000 + k, edited(base, 8 + k % 5, 300 + k)) for k in range(90)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for words in (2, 5):
        _, top = brute_components(rows, words, 80)
        assert len({t for t in top.values()}) > 3
        assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(table, words, 80).collect()} == set(top.items())


def test_sketches_estimate_similarity():
    own = np.random.default_rng(2)
    for share in (0.8, 0.9, 0.97):
        for n in (30, 300, 2000, 20_000):
            both = own.integers(0, 1 << 63, size=int(n * share), dtype=np.uint64) * 2
            alone = (n - len(both)) // 2
            gaps = []
            for _ in range(12):
                a, b = (np.unique(np.concatenate([both, own.integers(0, 1 << 63, size=alone, dtype=np.uint64) * 2 + 1])) for _ in range(2))
                x, y = (np.frombuffer(neardup.signature(s)[2], dtype=np.uint64) for s in (a, b))
                count, total = int(np.bitwise_count(x ^ y).sum()), len(a) + len(b)
                gaps.append(neardup.estimate(count, total) - len(both) / (len(both) + 2 * alone))
                assert count <= neardup.furthest(total, 0.8)
            assert abs(np.mean(gaps)) < 0.015


# WARC -------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(1, "http://a.example/x", "<p>é</p>"), (2, "https://www.a.example:443/x", "<p>é</p>"), (3, None, None), (4, "u\r\nEvil: 1", ""), (5, "http://b.example", "w" * 300_000), (6, "x", "<p>é</p>"), (6, "x", "<p>é</p>"), (None, "y", "alone")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, record_type string").repartition(3)
    got = sorted(warc.round_trip(table).collect(), key=lambda r: r.page_id or 0)
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    assert len(got) == len(rows)
    for r, (i, _, h) in zip(got, sorted(rows, key=lambda r: r[0] or 0)):
        body = (h or "").encode()
        kind = "response" if i is None or largest[h or ""] == i else "revisit"
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, largest[h or ""] if kind == "revisit" else None)
    assert warc.round_trip(table.limit(0)).count() == 0


def test_index_is_ordered_over_runs_and_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 40)
    rows = [(i, f"http://{'hot' if i % 3 else 'h' + str(i % 7)}.example/{i % 11}", f"p{i % 50}") for i in range(300)]
    runs = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5), f"file://{tmp_path}/w")
    index = sorted(warc.merge(runs).collect(), key=lambda r: (r.part, r.seq))
    keys = [(r.key, r["at"], r.page_id) for r in index]
    assert len(keys) == 300 and keys == sorted(keys) and len({r.part for r in index}) > 3


def test_index_of_more_runs_than_a_tree_takes(spark, tmp_path, monkeypatch):
    for name, value in (("RANGE_ENTRIES", 60), ("FAN_IN", 3), ("RUN_ENTRIES", 11), ("RUN_SAMPLES", 4), ("SAMPLED", 40)):
        monkeypatch.setattr(warc, name, value)
    rows = [(i, f"http://{'hot' if i % 3 else 'h' + str(i % 7)}.example/{i % 11}", f"p{i}") for i in range(400)]
    runs = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(6), f"file://{tmp_path}/w")
    # A worker has the module's own values, so the merge is also run here, over every range.
    bounds = warc.bounds_of(runs)
    listed = runs.collect()
    got = []
    for part, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
        own = warc.Merger(f"file://{tmp_path}/m{part}", low, high)
        for r in listed:
            own.add((r.uri, 0, r.size))
        got += [(e[0], e[1], e[2]) for e in own.entries()]
        assert not list((tmp_path / f"m{part}").glob("*"))
    assert len(got) == 400 and got == sorted(got) and len(bounds) > 2
    index = warc.merge(runs).collect()
    assert sorted((r.key, r["at"], r.page_id) for r in index) == got


def test_loser_tree():
    own = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        lists = [sorted((own.randint(0, 50), j) for _ in range(own.randint(0, 20))) for j in range(k)]
        assert list(warc.LoserTree(lists)) == sorted(x for of in lists for x in of)
    assert warc.url_key("HTTPS://www.Example.com:443/a?b") == "com,example)/a?b"


# Personal data ------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            x, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in x.split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and pii_model.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_spans_against_brute_force(spark):
    own = random.Random(7)
    parts = ["a@b.c", "_d@e.f", "x.y%@z", "@", ".", "..", "-", "+", "+1 (559) 555-3817", "+12", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.08.9.10", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "0" * 30, " ", "é", "東京", "\n", "12", "a", "token = \"ab12cd34ef56ab12cd34ef56ab12cd34\"", "password=135299847ac0e0f0dc", "(212) 555-0188"]
    texts = ["".join(own.choice(parts) for _ in range(own.randint(1, 14))) for _ in range(250)] + ["a" * 3000 + "@", "1" * 3000, None, "", "a@" + ".b" * 2000]
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")], "doc_id bigint, text string, spans string")
    got = pii.report(table).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
        assert set(base) <= set(r.spans.split(",")) | {""}
    assert pii.report(table.limit(0)).count() == 0


def brute_added(text):
    """The spans that the trees add, by a plain search of all candidates."""
    text = text or ""
    base = [tuple(int(x) for x in s.split(":")[1:]) for s in brute_spans(text)]
    trees, thresholds = pii_model.fitted()
    scored = []
    for kind, pattern in pii.LOOSE.items():
        for m in re.finditer(pattern, text):
            digits = sum(c in "0123456789" for c in m[0])
            if kind in pii.DIGITS and not pii.DIGITS[kind][0] <= digits <= pii.DIGITS[kind][1] or any(a < m.end() and m.start() < b for a, b in base):
                continue
            x = np.array(pii_model.describe(kind, m[0], text[max(0, m.start() - pii.BEFORE) : m.start()]))
            score = sum(pii_model.value(t, x) for t in trees)
            if score >= thresholds[kind]:
                scored.append((m.start(), -score, kind, pii_model.KINDS.index(kind), m.end()))
    kept = []
    for x in sorted(scored):
        if kept and x[0] < kept[-1][4]:
            if x[1] < kept[-1][1]:
                kept[-1] = x
        else:
            kept.append(x)
    return [f"{k}:{a}:{b}" for a, _, k, _, b in kept]


def test_all_spans_against_brute_force(spark):
    own = random.Random(17)
    parts = ["0.1.2.3", "10.0.0.0", "a@b.c", "+1 (559) 555-3817", "01 23 45 67 89", "06.12.34.56.78", "call ", "joe at example.com", "x (at) y.org", "meet at noon.", "(212) 555-0188", "212-555-0188", "order 2125550188", "12 30", "1999-2004", "fe80:0:0:1:2:3:4:5", "token = ", "ab12cd34ef56ab12cd34ef56ab12cd34", "Zz9" * 700, " ", ", ", "é東京 ", "/usr/lib/python/site-packages/x", "card 4111.1111.1111.1111", "4111 1111 1111 1111"]
    texts = ["".join(own.choice(parts) for _ in range(own.randint(1, 12))) for _ in range(200)] + parts + ["say joe at example.com now", " ".join("call 555 1234567, " for _ in range(400)), " ".join(f"mail a{k}@b.co or 212-555-0{k:03} " for k in range(300))]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    by = lambda s: (pii_model.KINDS.index(s.split(":")[0]), int(s.split(":")[1]))
    for i, text in enumerate(texts):
        assert got[i] == ",".join(sorted(brute_spans(text) + brute_added(text), key=by)), text[:200]
    alone = {texts[i]: s for i, s in got.items()}
    assert alone["01 23 45 67 89"] == "phone:0:14" and alone["joe at example.com"] == "email:0:18" and alone["meet at noon."] == ""


def test_very_many_matches_in_one_text(spark):
    text = "call 212-555-0188 or a@b.co; " * 25_000
    table = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.perf_counter()
    got = pii.report(table).first()
    assert got.n_email == 25_000 and got.spans.count("phone") == 25_000
    made = pii.redact(table).first().text
    assert made == "call [PHONE] or [EMAIL]; " * 25_000
    assert time.perf_counter() - began < 240  # the square of the matches would take many times that


def test_addresses_with_parts_of_zeros(spark):
    good = ["10.0.0.1", "0.0.0.0", "8.8.8.0", "192.168.0.1", "00.000.0.255", "1.2.3.000", "007.0.0255.10"]
    bad = ["256.0.0.0", "0.0.0.0256", "0.0.0.1000", "0.0.0"]
    texts = [f"from {x} on" for x in good + bad]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(texts):
        base = brute_spans(text)
        assert got[i].n_ip == len(base) == (i < len(good)) and got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    made = pii.redact(spark.createDataFrame([(1, "from 10.0.0.1 to 0.0.0.0")], "doc_id bigint, text string")).first()
    assert made.text == "from [IP] to [IP]"


def test_redaction_and_added_spans(spark):
    table = spark.createDataFrame([(1, "Call +1 (559) 555-3817 or a@b.co, éé token = \"ab12cd34ef56ab12cd34ef56ab12cd34ab12cd34\"", 5, "x"), (2, None, None, "x"), (3, "plain words, year 2024, nothing else", 9, "x"), (4, "commit 0123456789abcdef0123456789abcdef01234567", 1, "x")], "doc_id bigint, text string, n_chars bigint, pii_spans string")
    got = {r.doc_id: r for r in pii.redact(table).collect()}
    assert got[1].text == "Call [PHONE] or [EMAIL], éé token = \"[SECRET]\"" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "plain words, year 2024, nothing else" and got[4].text.startswith("commit 0123")
    assert pii.redact(table).columns == table.columns


def test_sql_features_equal_the_models(spark):
    rows = [(k, t, b) for k, t, b, _ in pii_model._candidates(random.Random(3), 280)]
    table = spark.createDataFrame([(i, pii_model.KINDS.index(k), t, b) for i, (k, t, b) in enumerate(rows)], "i int, rank int, match string, before string")
    features = pii._features({"match": F.col("match"), "rank": F.col("rank")}, F.col("before"))
    row = F.struct(*[features[n].alias(n) for n in pii_model.FEATURES])
    trees, _ = pii_model.fitted()
    for r in table.select("i", row.alias("row")).withColumn("score", F.expr(pii.score_sql("row"))).collect():
        expected = pii_model.describe(*rows[r.i])
        assert list(r.row) == pytest.approx(expected)
        assert r.score == pytest.approx(sum(pii_model.value(t, np.array(expected)) for t in trees))


# Packing, tokens ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoder_equals_the_library(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 500)
    own = tokens.Encoder(tokens.vocabulary(name))
    library = Tokenizer.from_file(tokens.vocabulary(name))
    assert own.known
    odd = [None, "", " ", "a  b", "<|endoftext|>", "<|startoftext|> a <|endoftext|><|ENDOFTEXT|>b<|endoftext", "\n\n x\t y ", "it's  <|endoftext|> ok\r\n", "a  b", "x　y", "\x1c a", "é éx ́ ΑΣ Σ", "...\n..", "don't 've 12345 \n", "A.b,,c !!\nD", "x" * 300]
    alphabet = ["a", "B", "é", " ", "\n", ".", ",,", "'s", "1", "\t", " ", "ß", "語", "!!\n"]
    r = random.Random(2)
    for text in odd + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 25))) for _ in range(1500)] + [prose(3000, 8)]:
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), "<u4").tolist() == expected, repr(text)


def test_released_memory_goes_back_to_the_system():
    code = """
import random, re
import pyarrow as pa
from moorline.llm import tokens

def mb():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem): +(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

path, r = tokens.vocabulary("word_bpe_49k.json"), random.Random(1)
tokens.encoder(path).ids("warm up")
tokens.release()
before = mb()
for _ in range(4):
    batch = pa.array([" ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(300)) for _ in range(100)])
    parts = [pa.concat_arrays([batch] * 40) for _ in range(4)]
    for text in batch.to_pylist():
        tokens.encoder(path).ids(text)
    del batch, parts, text
held = mb()
tokens.release()
print(held - before, mb() - before)
"""
    held, left = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert held > 60 and left < 0.6 * held, (held, left)


def test_packing(spark, docs, none, monkeypatch):
    monkeypatch.setattr(packing, "NEARLY", 0)
    library = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    whole = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in ODD}
    got = packing.pack(docs, with_ids=True).collect()
    of = collections.defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
    for i, rows in of.items():
        copies = sum(d == i for d, _ in ODD)
        assert sorted(r.start for r in rows) == sorted(list(range(0, len(whole[i]), 4096)) * copies)
        for r in rows:
            ids = whole[i][r.start : r.start + 4096]
            assert r.length == len(ids) and r.piece * 4096 == r.start and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and np.frombuffer(r.ids, "<u4").tolist() == ids
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack(none).count() == 0


def test_rounds_fill_across_partitions(spark):
    table = spark.createDataFrame([(i, prose(5 + i % 60, i)) for i in range(1500)], "doc_id bigint, text string").repartition(30)
    got = packing.pack(table, capacity=512).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    total = sum(r.n for r in got)
    assert max(r.n for r in got) <= 512 and len(got) <= 1.02 * total / 512 + 1


def test_best_fit():
    r = random.Random(4)
    for _ in range(20):
        sizes = [r.randint(1, 100) for _ in range(200)]
        fill = collections.Counter()
        for (b, at), s in zip(packing.best_fit(sizes, 100), sizes):
            fill[b] += s
            assert at + s <= 100
        assert max(fill.values()) <= 100 and len(fill) <= 1.15 * sum(sizes) / 100 + 1


def test_token_files(spark, docs, none, monkeypatch):
    library = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    got = sorted(tokenfile.round_trip(docs).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(ODD) and tokenfile.round_trip(none).count() == 0


def test_direct_access(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 1000)
    r = np.random.default_rng(3)
    documents = [r.integers(0, 1 << int(b), size=n).astype("<u4") for b, n in ((8, 3), (16, 1700), (31, 900), (17, 0), (4, 513), (16, 2000))]
    with open(tmp_path / "x.dac", "wb") as f:
        w = tokenfile.Writer(f)
        for i, ids in enumerate(documents):
            w.add(i, ids.tobytes())
        w.close()
    reader = tokenfile.Reader(f"file://{tmp_path}/x.dac")
    every = np.concatenate(documents)
    assert np.concatenate(list(reader.segments())).tolist() == every.tolist()
    assert all(reader.get(k) == every[k] for k in [*range(0, len(every), 37), 0, 511, 512, 513, 999, 1000, len(every) - 1])
    assert [(d, n, c) for d, _, n, c in reader.crcs()] == [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(documents)]
    with pytest.raises(IndexError):
        reader.get(len(every))


# Chat, fingerprints ---------------------------------------------------------------------------------------------------


def test_chat(spark):
    hard = "</s>[INST] ok [/INST] \\ \\\\ <s> <\\s> <<SYS>> <</SYS>>\n[\\INST]"
    rows = [(1, 0, "system", hard), (1, 1, "user", None), (1, 2, "assistant", hard), (1, 3, None, "x"), (1, 4, "assistant", ""), (2, 0, "user", "q"), (2, None, "assistant", "first"), (None, 0, "assistant", "é"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, seq int").repartition(3)
    got = {r.conv_id: r for r in chat.round_trip(table).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv)
        told = "".join(f"{role}\n{text}\n" for *_, role, text in own)
        loss = "".join(text for *_, role, text in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    expanded = chat.expand(chat.format_turns(table))
    texts = {(r.conv_id, r.example): (r.context, r.target) for r in chat.contexts(expanded).collect()}
    told = {(r.conv_id, r.example): r for r in chat.examples(expanded).collect()}
    assert len(texts) == len(told) == 4
    # Every context against a plain version: all turns before the reply, formatted, and the reply's own opening.
    for conv in {r[0] for r in rows}:
        before, k = "", 0
        for _, _, role, text in sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv):
            if role == "assistant":
                context = before + "<s>assistant[INST]"
                assert texts[(conv, k)] == (context, chat.escape(text)) and told[(conv, k)].context_sha256 == hashlib.sha256(context.encode()).hexdigest()
                assert (told[(conv, k)].context_chars, told[(conv, k)].target_end) == (len(context), len(context) + len(chat.escape(text)))
                k += 1
            before += chat.TURN.format(role=chat.escape(role), text=chat.escape(text))
    assert all(chat.unescape(chat.escape(t)) == t for t in (hard, "", "\\", "[/INST]\\"))
    assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", chat.escape(hard))
    assert chat.round_trip(table.limit(0)).count() == 0


def test_chat_is_parted_by_control_strings_alone():
    own = random.Random(4)
    parts = ["</s>", "[INST]", "[/INST]</s>", "<s>", "\\", "a", "[/INST", "]", "<", "/s>", "é", "\n"]
    turns = [(own.choice(["user", "assistant", "x[INST]"]), "".join(own.choice(parts) for _ in range(own.randint(0, 12)))) for _ in range(300)]
    whole = "".join(chat.TURN.format(role=chat.escape(r), text=chat.escape(t)) for r, t in turns)
    for longest in (1, 7, 100, len(whole)):
        parser, got, at = chat.Parser(), [], 0
        while at < len(whole):
            n = own.randint(1, longest)
            got += [(role, chat.unescape(text)) for role, text, start in parser.feed(whole[at : at + n]) if whole.startswith(text, start)]
            at += n
        parser.close()
        assert got == turns
    with pytest.raises(ValueError):
        list(chat.Parser().feed("<s>user" + chat.END))
    cut = chat.Parser()
    list(cut.feed(whole[:-3]))
    with pytest.raises(ValueError):
        cut.close()


def test_a_long_conversation(spark):
    n = 4000
    rows = [(8, k, "assistant" if k % 2 else "user", f"turn {k} [INST]" * (k % 5)) for k in range(n)]
    r = chat.round_trip(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)).first()
    assert r.n_turns == n and r.n_examples == n // 2 and r.loss_sha256 == hashlib.sha256("".join(t for *_, role, t in rows if role == "assistant").encode()).hexdigest()


def test_fingerprints(spark, docs, none, monkeypatch):
    monkeypatch.setattr(imatch, "TASK_CHARS", 40_000)
    got = imatch.report(docs).collect()
    order = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    expected = collections.Counter()
    for k, (i, t) in enumerate(order):
        t, follower = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        expected[(i, len(t), hashlib.sha256((t[: len(t) - half] + follower[:half]).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    prints = {r.fingerprint for r in got if r.doc_id in (5, 6, None)}
    assert len(prints) == 1
    assert imatch.report(none).count() == 0 and imatch.report(docs.where("doc_id = 4")).first().near_next == 1.0


def test_fingerprints_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RAREST", 0.05)
    monkeypatch.setattr(imatch, "COMMONEST", 0.6)
    own = random.Random(9)
    some = WORDS[:120]
    texts = [" ".join(own.choice(some) for _ in range(own.randint(0, 60))) for _ in range(60)] + ["", "nothing known", None]
    rows = list(enumerate(texts))
    held = collections.Counter(w for t in texts for w in set((t or "").split()))
    band = sorted(w for w, n in held.items() if 0.05 * len(texts) <= n <= 0.6 * len(texts))
    lots = [chance for number, chance in imatch.LEXICONS for _ in range(number)]

    def plain(text):
        mine = [w for w in band if w in set(text.split())]
        if not mine:
            return "text:" + hashlib.blake2b(text.encode(), digest_size=8).hexdigest()
        out = []
        for k, chance in enumerate(lots):
            raw = hashlib.blake2b
            kept = [w for w in mine if int.from_bytes(raw(w.encode(), person=bytes([k // 32]), digest_size=64).digest()[2 * (k % 32) : 2 * (k % 32) + 2], "little") < 65536 // chance]
            out.append(f"{xxhash.xxh3_64_intdigest(' '.join(kept).encode()) & 0xFFFFFFFF:08x}" if kept else "-")
        return ":".join(out)

    got = {r.doc_id: r for r in imatch.report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    for i, text in rows:
        text, follower = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        other = text[: len(text) - half] + follower[:half]
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (plain(text), plain(other))
        assert got[i].near_edited == imatch.likeness(plain(text), plain(other)) and got[i].near_next == imatch.likeness(plain(text), plain(follower))


def test_lexicon_is_the_band(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RAREST", 0.05)
    monkeypatch.setattr(imatch, "COUNTED", 50)
    texts = [" ".join({"all", *(["some"] if i % 10 == 0 else []), *(["rare"] if i == 3 else []), f"u{i}", *(["half"] if i % 2 else [])}) for i in range(100)]
    terms, n, _ = imatch.lexicon(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4))
    assert terms == [b"some"] and n == 100


@pytest.mark.parametrize(("parts", "counted", "held"), [(40, 300_000, 12), (1, 30, 0), (3, 30, 0), (3, 80, 3), (3, 80, 3_000_000)])
def test_lexicon_with_more_candidates_than_held(spark, monkeypatch, parts, counted, held):
    own = random.Random(3)
    texts = [" ".join({f"u{i}", f"v{i}", *(f"w{k}" for k in range(1, 40) if own.random() < 1 / k)}) for i in range(200)]
    count = collections.Counter(w for t in texts for w in t.split(" "))
    expected = sorted(w.encode() for w, k in count.items() if 0.1 * 200 <= k <= 0.25 * 200)
    monkeypatch.setattr(imatch, "RAREST", 0.1)
    monkeypatch.setattr(imatch, "COUNTED", counted)
    monkeypatch.setattr(imatch, "HELD", held)
    terms, n, chars = imatch.lexicon(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(parts))
    assert expected and terms == expected and (n, chars) == (200, sum(map(len, texts)))


def test_likeness_grows_with_common_terms():
    terms = [f"t{i}".encode() for i in range(600)]
    printer = imatch.Printer(terms)
    text = lambda a, b: printer(" ".join(f"t{i}" for i in range(a, b)))
    found = [np.mean([imatch.likeness(text(s, s + 200), text(s + gap, s + gap + 200)) for s in range(0, 150, 10)]) for gap in (0, 20, 100, 200)]
    assert found[0] == 1.0 and found[1] > found[2] > found[3]


# The pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    good = {i: prose(90, 300 + i) + "." for i in range(60)}
    bad = {100 + i: " ### ".join(prose(40, 400 + i).split()).upper() for i in range(40)}
    mark = prose(20, 999)
    special = {200: good[0], 201: edited(good[1].rstrip("."), 45, 1) + ".", 202: good[2].replace(" ", " " + mark + " ", 1), 203: prose(90, 777) + " a@b.co, so."}
    rows = [(i, t, "en", "s", len(t)) for i, t in {**good, **bad, **special}.items()]
    kind = T.StructType.fromDDL("doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in {**good, **bad}], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, mark)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert not set(texts) & set(bad) and not {200, 201, 202} & set(texts)
    assert set(good) <= set(texts) and "[EMAIL]" in texts[203]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(texts)
    # The last stage's rows by a plain version: every kept text's ids, cut and placed without gaps.
    library = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    places = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and r.start == r.piece == 0
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_pipeline_of_nulls_and_of_nothing(spark, tmp_path):
    import corpus_pipeline

    kind = T.StructType.fromDDL("doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = [(1, None, None, None, None), (2, "", None, None, 0), (None, prose(60, 5) + ".", "en", None, None), (None, None, None, None, None), (3, prose(60, 6) + ".", None, "s", None), (3, prose(60, 6) + ".", None, "s", None)]
    for name, own in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(own, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, None), (1, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        # Without labels nothing is rejected, rows of one id stay together, and a null text is packed as the end id alone.
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.length == 1) for r in got) == sorted((i is not None, i or 0, not t) for i, t, *_ in own)
