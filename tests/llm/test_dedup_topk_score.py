"""Near-duplicates, components, top-k, suffix tree and mixing against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import minhash, mixing, shared, suffix_tree, topk

WORD = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, n):
    w = words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i == j or a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def near_corpus():
    r = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    rows, base = [], [r.choice(vocab) for _ in range(120)]
    for _ in range(90):  # one large group of copies with a few to many edits
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 9, 14])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append(" ".join(w))
    for _ in range(40):
        w = [r.choice(vocab) for _ in range(r.randint(1, 60))]
        rows += [" ".join(w), " ".join(w).upper(), " ".join(w[:-1] + ["z"])]
    rows += [None, "", "  \n", "one", "ONE", "one two", "one  two", "one two three"]
    r.shuffle(rows)
    out = list(enumerate(rows))
    return out + [(None, rows[0]), (3, rows[3]), (5, "quite another text with its own id"), (5, "quite another text with its own id")]


def test_near_duplicates(spark):
    rows = near_corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    for n in (2, 5):
        out = minhash.near_duplicates(docs, n, 80).collect()
        want = brute_components(rows, n, 80)
        assert len(out) == len(rows)
        for r in out:
            assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
            assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
        assert sorted(r.n_shingles for r in out) == sorted(len(shingles(t, n)) for _, t in rows)
    kept = minhash.drop_duplicates(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({v for v in want.values()}) and ids.count(None) == 1
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_buckets(spark, monkeypatch):
    """Buckets of texts that share a word pair, compared in blocks."""
    monkeypatch.setattr(minhash, "PAIRED", 2)
    monkeypatch.setattr(minhash, "CROSS_ROWS", 8)
    monkeypatch.setattr(minhash, "CLOSE", 1.0)  # fewer meet in clusters, so that more meet in buckets
    r = random.Random(2)
    rows = [(k, "in the end " + " ".join(f"w{r.randrange(9000)}" for _ in range(r.randint(1, 9)))) for k in range(60)]
    rows += [(100 + k, t + " z") for k, t in rows[:30]] + [(200 + k, t.split(" ", 1)[1]) for k, t in rows[:20]]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    want = brute_components(rows, 2, 80)
    assert {x.doc_id: x.component_id for x in got} == want and len(set(want.values())) < len(want)
    sk = spark.range(50).selectExpr("1 band", "1L key", "50L n", "id h0", "10L n_shingles", "id % 5 s0", "0L s1", "id component", "id % 7 cluster")
    pairs = {(x.a, x.b) for x in minhash.large_buckets(sk, 80).collect()}
    assert pairs == {(a, b) for a in range(50) for b in range(a + 1, 50) if a % 7 != b % 7}


def test_near_duplicates_refuses_what_it_would_drop():
    with pytest.raises(ValueError, match="80"):
        minhash.near_duplicates(None, 5, 79)


def test_overlaps():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 9000, r.integers(0, 300))) for _ in range(40)]
    got = minhash.overlaps(sets[:25], sets[25:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]).all()


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90}


def test_in_order(spark):
    r = random.Random(4)
    rows = [(r.choice("aab") if r.random() > 0.1 else None, r.randint(0, 50), k) for k in range(400)]
    out = shared.in_order(spark.createDataFrame(rows, "g string, o int, k int"), ["g"], ["o", "k"], ["k"]).collect()
    for g in {x[0] for x in rows}:
        want = [k for _, k in sorted((o, k) for x, o, k in rows if x == g)]
        mine = sorted((x for x in out if x.g == g), key=lambda x: x.position)
        assert [x.k for x in mine] == want and [x.position for x in mine] == list(range(1, len(want) + 1))
        assert [x.prev_k for x in mine] == [None, *want[:-1]] and [x.next_k for x in mine] == [*want[1:], None]


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(int(k), (r.standard_normal(8) * r.choice([0.1, 1, 3])).tolist()) for k in range(300)]
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 8), (460, [float("inf")] + [0.0] * 7), (480, [0.0] * 8), (500, rows[20][1]), (500, rows[20][1]), (None, rows[0][1])]
    got = topk.search(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")).collect()
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q in {i for i, _ in fine if i % 20 == 0}:
        a = next(v for i, v in fine if i == q)
        want = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in fine if i != q)[:20]
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)
        assert [(-x.score, x.vec_id) for x in mine] == want and [x.rank for x in mine] == list(range(1, len(want) + 1))
    assert {x.query_id for x in got} == {i for i, _ in fine if i % 20 == 0}
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_tree(train):
    d, grams = suffix_tree.DEPTH, Counter()
    for s in train:
        grams.update(s[p - d : p + 1] for p in range(d, len(s)))
    levels, eff = [], {}
    for k in range(d + 1):
        c, whole, types, gain = Counter(), Counter(), Counter(), Counter()
        for s, n in grams.items():
            c[s[d - k :]] += n
        for s, n in c.items():
            whole[s[:-1]] += n
            types[s[:-1]] += 1
        below = {s: eff[s[1:]] if k else 1 / 256 for s in c}
        p = {s: max(n - 0.8, 0) / whole[s[:-1]] + 0.8 * types[s[:-1]] / whole[s[:-1]] * below[s] for s, n in c.items()}
        for s, n in c.items():
            gain[s[:-1]] += n * math.log(p[s] / below[s])
        keep = {x for x in types if gain[x] >= suffix_tree.THETA * types[x]}
        eff = {s: p[s] if s[:-1] in keep else below[s] for s in c}
        levels.append((keep, p, {x: 0.8 * types[x] / whole[x] for x in types}))
    return levels


def brute_score(levels, s):
    total = 0.0
    for at in range(suffix_tree.DEPTH, len(s)):
        for k in range(suffix_tree.DEPTH, -1, -1):
            keep, p, rest = levels[k]
            if s[at - k : at] in keep:
                if s[at - k : at + 1] in p:
                    total += math.log10(p[s[at - k : at + 1]])
                    break
                total += math.log10(rest[s[at - k : at]])
        else:
            total += math.log10(1 / 256)
    return total


def test_suffix_tree(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "MOST_WORDS", 12)  # so that rare words go by the join
    r = random.Random(8)
    syllables = ["ta", "ri", "Mo", "ne", "éa", "ku"]
    text = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(k, text(r.randint(5, 120))) for k in range(60)] + [(61, None), (62, ""), (63, "\t ta  \n"), (None, text(9)), (1, text(4)), (1, text(4))]
    got = suffix_tree.score(spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    stream = lambda t: b"\n" * suffix_tree.DEPTH + b"".join(w.encode() + b" " for w in words(t)) + b"\r"
    levels = brute_tree([stream(t) for i, t in rows if not held(i)])
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want[i, held(i), len(tokens), sum(c[w] > 0 for w in tokens), n, round(base, 6), round(brute_score(levels, stream(t)), 6)] += 1
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in got) == want
    assert suffix_tree.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_tree_keeps_every_state_that_passes(spark, monkeypatch):
    """With room for far fewer entries than the tree has, nothing is dropped: the rest comes by the join."""
    monkeypatch.setattr(suffix_tree, "MOST_GRAMS", 20, raising=False)
    monkeypatch.setattr(suffix_tree, "MOST_ENTRIES", 20, raising=False)  # the cap as it was
    r = random.Random(9)
    rows = [(k, " ".join(r.choice(["tari", "mone", "kuta", "rimo", "nexa"]) + r.choice("abcdeé") for _ in range(r.randint(3, 60)))) for k in range(50)] + [(51, None), (52, "Ω unseen Ωω")]
    got = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    stream = lambda t: b"\n" * suffix_tree.DEPTH + b"".join(w.encode() + b" " for w in words(t)) + b"\r"
    levels = brute_tree([stream(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1])
    assert sum(s[:-1] in keep for keep, p, _ in levels for s in p) > 100
    assert {x.doc_id: round(x.score, 6) for x in got} == {i: round(brute_score(levels, stream(t)), 6) for i, t in rows}


def test_mixing_in_both_ways_and_any_columns(spark, monkeypatch):
    r = random.Random(7)
    rows = [(k, " ".join(["wörd", "TWO", "#x"][r.randint(0, 2)] for _ in range(r.randint(0, 40))), r.choice(["en", "de", "fr"]), r.choice("aab"), "mine", k) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _tokens string, _mix long")
    one = {x.doc_id: x for x in mixing.mix(docs).collect()}
    assert {i: x["_tokens"] for i, x in one.items()} == {i: len(re.findall(WORD, t)) for i, t, *_ in rows}
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and {x["_tokens"] for x in kept.collect()} == {"mine"}
    assert {x.doc_id for x in kept.collect()} == {i for i, x in one.items() if x["_kept"]}
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 2)  # so that cells are raked and joined without a broadcast
    monkeypatch.setattr(mixing, "CLOSE", 1e-4)
    two = {x.doc_id: x for x in mixing.mix(docs).collect()}
    assert all(abs(two[i]["_probability"] - one[i]["_probability"]) < 1e-2 for i in one)


def test_raking_meets_the_targets(spark):
    r = random.Random(6)
    rows = [(k, " ".join(["w"] * r.randint(0, 300)), r.choice(["en", "de", None]), r.choice("sssst")) for k in range(800)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"_source": {"s": 0.5, "t": 0.5}, "_lang": {"en": 0.2, "de": 0.5, "": 0.3}}
    out = mixing.mix(docs, targets).toPandas()
    out["w"] = out["_tokens"] * out["_probability"]
    for axis, want in targets.items():
        share = out.groupby(axis)["w"].sum() / out["w"].sum()
        for value, x in want.items():
            assert abs(share[value] - x) < 1e-8
    assert out["_probability"].max() == 1.0
    kept = mixing.sample(docs, targets)
    assert kept.columns == docs.columns and kept.count() == out["_kept"].sum()
    assert mixing.mix(docs.limit(0)).count() == 0
