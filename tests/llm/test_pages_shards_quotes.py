"""Page differencing, compacted shards, quotation linking and the pipeline against plain versions."""

import os
import random
import re
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import html_extract as H
from lodestrata.llm import quotes, sharding, shared


def lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
    return n[len(a)][len(b)]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(1500):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 14))] for _ in range(2))
        got = H.common(a, b)
        rest = iter(b)
        assert got == sorted(set(got)) and len(got) == lcs(a, b) and all(any(a[i] == y for y in rest) for i in got)
    a, b = ([r.randint(0, 9) for _ in range(20_000)] for _ in range(2))
    for row in H._rows(a, b):
        pass
    assert len(H.common(a, b)) == len(b) - row.bit_count()  # the halved form against the length by rows alone


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>"</script></head><body>
<div class="top-menu"><a href="/">Home</a></div><h2>Daily News</h2><!-- <p>no</p> -->
<p>Story %d begins &amp; goes<br>on   with <b>bold</b>ness.</p><p>Second part of %d.<ul><li>one %d<li>two %d</ul>
<div id="comments"><p>First!</p></div><p>All rights reserved everywhere.</p><form><p>Your mail</p></form></body>"""


def test_pages(spark):
    rows = [(k, f"https://a.example/news/{k}?x=1", PAGE % (k, k, k, k)) for k in range(6)]
    rows += [(10, "https://b.example/x", "<body><nav>menu</nav><article><h1>A</h1><p>Same line.</p></article><footer>f</footer>")]
    rows += [(11, "https://b.example/y", "<body><nav>menu</nav><article><h1>B</h1><p>Same line.</p></article><footer>f</footer>")]
    rows += [(12, None, None), (13, "https://c.example/", ""), (14, "https://d.example/1", "only text & more"), (14, "https://d.example/1", "only text & more"), (None, "x", "<p>x<p>y <a href=")]
    pages = spark.createDataFrame([(i, u, h, "k") for i, u, h in rows], "page_id long, url string, html string, text string")
    out = H.extract(pages).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    text = {r.page_id: r.text for r in out}
    for k in range(6):
        assert text[k] == f"Story {k} begins & goes on with boldness.\nSecond part of {k}.\none {k}\ntwo {k}"
    assert (text[10], text[11], text[12], text[13], text[14], text[None]) == ("A\nSame line.", "B\nSame line.", "", "", "only text & more", "x\ny")
    assert H.extract(pages.limit(0)).count() == 0


def test_differencing_decides(spark):
    """Pages that mark nothing: the frame goes by what neighbours share, and only by that."""
    frame = "<body class='has-sidebar'><div class='sidebar'><p>Town news</p><p>Sport</p></div>%s<div><p>Imprint</p></div></body>"
    rows = [(k, f"https://{'ab'[k % 2]}.example/n/{k:03d}", frame % f"<h2>Head {k}</h2><p>Body of {k}.</p>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert text == {k: f"Head {k}\nBody of {k}." for k in range(40)}
    plain = {r.page_id: r.text for r in H.extract(pages, copy=0.0).collect()}  # every neighbour counts as a copy: nothing is deleted
    assert sum(text[k] != plain[k] for k in text) == 40


def test_markup_guards():
    text = lambda h: "\n".join(t for t, k in H.lines_of(h) if k != H.DROP)
    assert text("<body class='ad'><div class='share related'><article><p>in</p></article><p>out</p></div></body>") == "in"
    assert text("<div class='comments'><p>no</p></div><p>yes<div class=ad>no</div>more") == "yes\nmore"
    assert text("<main><p>a</p><div class='promo'>no</div></main><p>out</p>") == "a"
    assert text("<p title='a>b'>x</p><p title=\"un>closed>y</p><p title='c>d'>z</p>") == "x\nclosed>y\nd'>z"
    assert text("a < b <svg/><p>c<textarea>no</textarea>d<script>no") == "a < b\ncd"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


@pytest.mark.parametrize("piece", ["<script ", "<script>", "</script ", "<a \"", "<a \">\" ", "<a '>' ", "<!-- ", "<!", "< ", "<li><div>", "<b></i>", "<div><li></li>", "x=' ", "&amp", "<p>a<!-->"])
def test_reading_is_linear(piece):
    for page in (piece * 40_000, piece * 40_000 + "'>", "<p " + piece * 40_000 + ">"):
        began = time.time()
        H.lines_of(page)
        assert time.time() - began < 4


def test_shards(spark, tmp_path):
    rows = [(k, "x" * (k % 97), None if k % 9 else "s") for k in range(600)] + [(None, None, None), (7, "same", "s"), (7, "same", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    store = sharding.shard(docs, arrivals=9, target=8_000)
    got = sorted(map(repr, store.read().select(*docs.columns).collect()))
    assert got == sorted(map(repr, docs.collect()))
    runs = store.runs()
    assert len(runs) < 9 and sum(r.size for r in runs) == sum(len(t or "") for _, t, _ in rows)
    assert max(r.tier for r in runs) >= 1
    before = store.version()
    with pytest.raises(sharding.Conflict):
        store.commit(runs, before)  # a version is written once
    assert store.version() == before
    store.append(docs.limit(0))
    assert store.version() == before
    merged = [r for r in runs if r.tier]
    assert all(len(r.rows) == -(-r.size // 8_000) for r in merged)
    assert sharding.stored(docs.limit(0)).count() == 0


def test_of_two_writers_one_commits(spark, tmp_path):
    store = sharding.ShardSet(spark, f"file://{tmp_path}/set")
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    store.append(docs)
    runs, version = store.runs(), store.version()

    def attempt(_):
        try:
            store.commit(runs, version + 1)
        except sharding.Conflict:
            return 0
        return 1

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(attempt, range(24))) == 1 and store.version() == version + 1
        list(pool.map(lambda k: store.append(docs.where(f"doc_id = {k}")), (1, 2, 1, 2)))  # each starts again until it has a version
    assert store.version() == version + 5 and store.read().count() == 6
    assert [f for f in os.listdir(tmp_path / "set" / "manifests") if not f.startswith((".", "v"))] == []


def test_shards_keep_columns_of_any_name(spark):
    rows = [(k, "t" * k, k, f"s{k}", 1.5, "x") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _run int, _shard string, _arrival double, row string")
    store = sharding.shard(docs, arrivals=5, target=300)
    assert sorted(store.read().collect()) == sorted(docs.collect()) and store.read().columns == docs.columns
    wide = docs.withColumn("more", docs.doc_id)
    store.append(wide)
    assert store.read().where("more is not null").count() == 90 and store.read().count() == 180


TALK = [
    ("c", 1, "a", "We meet on Monday.\nBring the plans."),
    ("c", 2, "b", "> We meet on Monday.\nFine with me."),
    ("c", 3, "a", "Anything else?"),
    ("c", 4, "d", "On Monday, a wrote:\n> Bring the  PLANS.\nWhich plans?"),
    ("c", 5, "a", ">> Bring the plans.\n> Which plans?\nThe house plans."),
    ("c", 6, "b", "> not said by anyone\nHm."),
    ("d", 1, "a", "We meet on Monday."),
    (None, None, None, None),
    ("e", 1, "a", "twice"),
    ("e", 1, "a", "twice"),
]


def test_quotes(spark):
    rows = spark.createDataFrame([(c, t, r, x, 0) for c, t, r, x in TALK], "conv_id string, turn int, role string, text string, position int")
    out = quotes.link(rows).collect()
    c = {r.turn: r for r in out if r.conv_id == "c"}
    assert {t: r.parent_turn for t, r in c.items()} == {1: None, 2: 1, 3: 2, 4: 1, 5: 4, 6: 5}
    assert [t for t, _ in sorted(c.items(), key=lambda x: x[1].position)] == [1, 2, 3, 4, 5, 6]
    assert (c[2].text, c[4].text, c[5].text) == ("Fine with me.", "Which plans?", "The house plans.")
    assert c[6].n_linked == 0 and c[5].n_quoted_lines == 2
    assert len(out) == len(TALK) and sorted(r.position for r in out if r.conv_id == "e") == [1, 2]
    assert quotes.link(rows.limit(0)).count() == 0


def test_branches_come_after_the_run_they_leave(spark):
    talk = [("c", 1, "u", "root"), ("c", 2, "u", "next"), ("c", 3, "u", "> root\nbranch of one"), ("c", 4, "u", "> next\nbranch of two"), ("c", 5, "u", "> branch of one\ndeeper")]
    out = {r.turn: r for r in quotes.link(spark.createDataFrame(talk, "conv_id string, turn int, role string, text string")).collect()}
    assert {t: r.parent_turn for t, r in out.items()} == {1: None, 2: 1, 3: 1, 4: 2, 5: 3}
    assert sorted(out, key=lambda t: out[t].position) == [1, 2, 4, 3, 5]
    assert all(r.parent_position is None or r.parent_position < r.position for r in out.values())


def brute_link(messages):
    """(parent index, linked units, own text, place) of one conversation's messages, by the rules of the docstring."""
    plain = lambda x: re.sub(r"\s+", " ", re.sub(r"^[ \t]*(>[ \t]?)+", "", x)).strip(" ").lower()
    level = lambda x: len(re.sub(r"[ \t]", "", (re.match(r"[ \t]*(>[ \t]?)+", x) or [""])[0]))
    own, parent, count = [], [], []
    for k, text in enumerate(messages):
        lines = text.split("\n")
        levels = [level(x) for x in lines]
        kept = [x for i, x in enumerate(lines) if levels[i] == 0 and not (i + 1 < len(lines) and levels[i + 1] > 0 and re.match(r"(?i)[ \t]*\S.{0,200}(wrote|writes):[ \t]*$", x))]
        own.append(re.sub(r"(?:\n[ \t]*)+$", "", re.sub(r"^(?:[ \t]*\n)+", "", "\n".join(kept))))
        units = set()
        i = 0
        while i < len(lines):
            j = i
            while j < len(lines) and levels[j] == levels[i]:
                j += 1
            if levels[i]:
                part = [plain(x) for x in lines[i:j]]
                units |= {(levels[i], x) for x in [*part, re.sub(r"\s+", " ", " ".join(part)).strip(" ")] if x}
            i = j
        votes = {}
        n = 0
        for lv, unit in units:
            for h in range(k - 1, -1, -1):
                if unit in {plain(x) for x in [own[h], *re.split(r"\n[ \t]*\n", own[h]), *own[h].split("\n")]}:
                    votes[lv, h] = votes.get((lv, h), 0) + len(unit)
                    n += 1
                    break
        best = max(votes, key=lambda v: (-v[0], votes[v], v[1]))[1] if votes else k - 1
        parent.append(best if k else None)
        count.append(n)
    order = []

    def visit(head):
        run = [head]
        while run[-1] + 1 < len(messages) and parent[run[-1] + 1] == run[-1]:
            run.append(run[-1] + 1)
        order.extend(run)
        for at in reversed(run):
            for x in range(at + 2, len(messages)):
                if parent[x] == at:
                    visit(x)

    visit(0)
    return [(parent[k], count[k], own[k], order.index(k) + 1) for k in range(len(messages))]


def test_linking_against_brute_force(spark):
    r = random.Random(11)
    said = ["We meet on Monday.", "Bring the plans.", "Which plans?", "The  house plans.", "fine", "No.", "Fine", "See below:", "Thanks a lot,\nfriend"]
    rows, talks = [], {}
    for conv in range(40):
        messages = []
        for k in range(r.randint(1, 14)):
            lines = []
            for _ in range(r.randint(1, 4)):
                if messages and r.random() < 0.6:
                    mark = "> " if r.random() < 0.7 else r.choice([">", ">> ", "> > ", " > "])
                    quote = r.choice(messages).split("\n")
                    if r.random() < 0.3:
                        lines.append("On Monday, ann wrote:")
                    lines += [mark + (x.upper() if r.random() < 0.2 else x) for x in quote[: r.randint(1, len(quote))]]
                lines.append(r.choice([*said, f"point {k}"]) if r.random() < 0.9 else "")
            messages.append("\n".join(lines))
        talks[conv] = messages
        rows += [(conv, k, "u", m) for k, m in enumerate(messages)]
    got = {(x.conv_id, x.turn): (x.parent_turn, x.n_linked, x.text, x.position) for x in quotes.link(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    want = {(c, k): x for c, messages in talks.items() for k, x in enumerate(brute_link(messages))}
    assert got == want
    assert sum(p is not None and p != k - 1 for (_, k), (p, *_) in want.items()) > 50


def test_carried(spark):
    r = random.Random(4)
    rows = [(r.choice("aab") if r.random() > 0.1 else None, o, r.randint(0, 9) if r.random() < 0.05 else None) for o in range(600)]
    out = shared.carried(spark.createDataFrame(rows, "g string, o int, v int"), ["g"], ["o"], "v", "last").collect()
    for g in {x[0] for x in rows}:
        last = None
        for x in sorted((x for x in out if x.g == g), key=lambda x: x.o):
            last = x.v if x.v is not None else last
            assert x["last"] == last


def test_pipeline(spark):
    r = random.Random(3)
    words = "the old mill by the river was sold to a family from the town who want to grind corn again".split()
    text = lambda: " ".join(r.choice(words) for _ in range(80)) + "."
    rows = [(k, text(), r.choice(["en", "de"]), "s", 0) for k in range(60)]
    rows += [(100, rows[0][1] + " Write to me@mail.example.org", "en", "s", 0), (101, "NO!! " * 50, "en", "s", 0), (102, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "")
        if name == "quality_rules":
            assert {x.doc_id for x in docs.collect()} == set(range(60)) | {100}
        if name == "minhash_near_dedup":
            assert {x.doc_id for x in docs.collect()} == set(range(60))
        if name != names[-1]:
            assert docs.columns == before.columns
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert docs.where(F.col("n_tokens") > 0).count() == docs.count() > 0
