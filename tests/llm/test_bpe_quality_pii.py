"""Encoding against the tiktoken library, quality counts and personal data against plain versions."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

from lodestrata.llm import bpe, pii, quality

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = r"[^\x20\x09-\x0D]+"
ODD = ["", " ", "\n\n", "a" * 700, "ab" * 400 + "c", "\x1c\x1d x", "\x85  z", "I'LL we'll   \n\n  x ", "123456" * 60, "!@#" * 200, "\U0001f600" * 50, "中文字" * 60, "'s't 're  's\n've"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, public_tokenizers.PATTERN + "|x{99}"])
def test_codec_equals_library(reference, pattern):
    r = random.Random(3)
    parts = ["'s", "'re", "'", "s", "ll", " ", "  ", "\n", " ", "a", "é", "1", "٣", "!", "'d", "the", "中"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(1, 16))) for _ in range(800)]
    table = bpe.PairTable(bpe.read_ranks(PATH), pattern)
    codec = bpe.Codec(table)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert table.decode(ids) == text.encode()


def test_tokenize_rows(spark, reference):
    rows = [(1, "hello  world", 7), (None, None, 8), (1, "hello  world", 9), (2, "x" * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").withColumnRenamed("n_tokens", "extra")
    out = bpe.tokenize(docs, PATH, public_tokenizers.PATTERN, ["doc_id"], keep_ids=True).collect()
    for r, (i, t, _) in zip(out, rows, strict=True):
        ids = reference.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens, r.token_ids) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.tokenize(docs.limit(0), PATH, public_tokenizers.PATTERN, ["doc_id"]).count() == 0
    again = bpe.decode_ids(spark.createDataFrame([(reference.encode_ordinary("Zoë!"),), (None,)], "token_ids array<int>"), PATH)
    assert [r.text for r in again.collect()] == ["Zoë!", None]


def plain_counts(text):
    t = text or ""
    w = re.findall(WORD, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


CLEAN = "This is a plain sentence about the sea and its ships, written by a calm hand. It goes on for a while, as such texts do, and then it ends."


def corpus():
    r = random.Random(1)
    words = CLEAN.split()
    clean = [" ".join(r.choice(words) for _ in range(r.randint(30, 90))) + "." for _ in range(150)]
    shout = [" ".join(w.upper() + "!!" for w in r.choices(words, k=60)) for _ in range(12)]
    junk = [" ".join(w + "***" for w in r.choices(words, k=60)) for _ in range(12)]
    same = ["la la la\nla la la\n" * 40, "x " * 300]
    return clean, shout + junk, same + [None, "", " \t\n", "too short", "a b c d e f g h\n" * 2 + " ".join(map(str, range(60)))]


def test_quality(spark):
    clean, bad, odd = corpus()
    rows = [(k, t) for k, t in enumerate(clean + bad + odd)] + [(None, clean[0]), (0, clean[0])]
    docs = spark.createDataFrame([(i, t, "k", 1.5) for i, t in rows], "doc_id long, text string, kept string, n_words double")
    out = quality.assess(docs.select("doc_id", "text"), ["doc_id"]).collect()
    for r, (i, t) in zip(out, rows, strict=True):
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (i, *plain_counts(t))
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert all(r.kept for r in out[: len(clean)])
    assert not any(r.kept for r in out[len(clean) : len(clean) + len(bad)])
    left = quality.keep_good(docs)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in out)
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_rates_are_estimated():
    """Votes drawn from known accuracies, good ones with bad votes among them: the estimate finds the accuracies."""
    r, k = np.random.default_rng(5), len(quality.RULES)
    on_good, on_bad, abstain = r.uniform(0.01, 0.15, k), r.uniform(0.3, 0.95, k), r.uniform(0, 0.3, k)
    good = r.random(60_000) < 0.8
    bad = r.random((len(good), k)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(r.random(bad.shape) < abstain, quality.NONE, np.where(bad, quality.BAD, quality.GOOD))
    found, where, counts = np.unique(votes @ 3 ** np.arange(k), return_inverse=True, return_counts=True)
    posterior, rates = quality.fit(found, counts)
    assert np.abs(rates["bad_on_good"] - on_good).max() < 0.01 and np.abs(rates["bad_on_bad"] - on_bad).max() < 0.03
    verdict = (posterior >= 0.5)[where]
    assert (verdict == good).mean() > 0.95 > 0.7 > (~(votes == quality.BAD).any(1) == good).mean()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/labels.parquet"), reason="no tables")
def test_estimates_agree_with_labels():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas()
    labels = docs[["doc_id"]].merge(pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas(), how="left")["quality"].to_numpy()
    parts = [x for _, _, x in quality.measure(pa.array(docs["text"]))]
    x = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    fine = ~quality.base_failed(x)
    votes = quality.patterns(x)
    found, counts = np.unique(votes[fine], return_counts=True)
    posterior, rates = quality.fit(found, counts)
    kept = posterior[np.searchsorted(found, votes[fine])] >= 0.5
    bad = (votes[fine][:, None] // 3 ** np.arange(len(quality.RULES))) % 3 == quality.BAD
    good, poor = labels[fine] == 1, labels[fine] == 0
    assert kept[good].mean() > 0.99 and kept[poor].mean() < 0.05
    assert np.abs(rates["bad_on_good"] - bad[good].mean(0)).max() < 0.02
    assert (kept == bad.any(1)).sum() >= 10  # documents on which the verdict is not that of "all must pass"


def plain_spans(t):
    digits = lambda x: re.sub(r"[^0-9]", "", x)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("ab1.@+- 2.5 ()") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("a" * 200_000 + " " + "1" * 200_000 + " x@" + "b" * 100_000) == []


def test_gradients():
    t = pii.Tagger(hidden=3, embed=2, seed=1)
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, 120, (4, 9)), r.integers(0, pii.TAGS, (4, 9))
    for k in t.p:
        t.p[k] = t.p[k].astype(np.float64) + 0.1 * r.standard_normal(t.p[k].shape)
    _, g = t.gradients(ids, tags)
    for k in ("T", "S", "O", "Xf", "Hf", "cb", "Hb"):
        at = tuple(0 for _ in t.p[k].shape)
        kept, h = t.p[k][at], 1e-3
        t.p[k][at] = kept + h
        up = t.gradients(ids, tags)[0]
        t.p[k][at] = kept - h
        down = t.gradients(ids, tags)[0]
        t.p[k][at] = kept
        assert abs((up - down) / (2 * h) - g[k][at]) < 2e-3


WORDS = "the quiet river runs past old stone houses and a small mill on its way down to".split()


def say(r, n=30):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark):
    return pii.fit(spark.createDataFrame([(k, t) for k, t, _ in mail()], "doc_id long, text string"))


def mail():
    r = random.Random(2)
    rows = [(k, f"{say(r)} write to ann{k}@mail.example.org or call +49 30 123456{k:02d} {say(r)}") for k in range(30)]
    rows += [(97, None), (98, ""), (None, say(r)), (99, say(r) * 40)]
    return [(i, t, len(t or "")) for i, t in rows]


def test_pii_end_to_end(spark, made):
    rows = mail()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = pii.find(docs, ["doc_id"], made).collect()
    for got, (i, t, _) in zip(out, rows, strict=True):
        base = plain_spans(t or "")
        assert got.doc_id == i and got.n_email == sum(s[0] == "email" for s in base)
        assert got.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert set(pii.listed(base).split(",")) <= set(got.spans.split(","))
    masked = {x.doc_id: x for x in pii.redact(docs, made).collect()}
    assert "[EMAIL]" in masked[3].text and "@" not in masked[3].text and masked[3].n_chars == len(masked[3].text)
    assert masked[97].text is None and masked[99].text == rows[-1][1]
    named = docs.withColumn("n_chars", docs.n_chars.cast("string"))
    assert {x.doc_id: x.n_chars for x in pii.redact(named, made).collect()} == {i: str(n) for i, _, n in rows}
    assert pii.redact(docs.limit(0)).count() == 0 and pii.find(docs.limit(0), ["doc_id"]).count() == 0


def test_written_around_forms_are_found(made):
    """Recall and precision of find() on forms that no base pattern takes, with values never seen in training."""
    r, examples = random.Random(77), pii.Examples(4321)
    tagger, hit, total, wrong = pii.Tagger(made), 0, 0, 0
    forms = [examples.email() for _ in range(200)] + [f"{a} at {b} dot {c}" for a, b, c in zip(["ann", "j.smith", "kurt7"] * 20, ["mail", "example", "post"] * 20, ["org", "com", "de"] * 20, strict=True)]
    forms += [examples.phone() for _ in range(150)] + [examples.ip() for _ in range(100)] + [examples.card() for _ in range(100)]
    forms = [f for f in forms if not pii.base_spans(f)]
    texts = [f"{say(r)} {f} {say(r)}" for f in forms]
    for f, t, (_, spans) in zip(forms, texts, pii.spans_of(tagger, texts), strict=True):
        a = t.index(f)
        total += 1
        hit += any(x < a + len(f) and a < y for _, x, y in spans)
        wrong += sum(y <= a or x >= a + len(f) for _, x, y in spans)
    assert total > 250 and hit / total > 0.9 and wrong / total < 0.02
    plain = [say(r, 200) + f" at the mill, {r.randint(1, 99)} of them. " + say(r, 200) for _ in range(60)]
    assert sum(len(x) for _, x in pii.spans_of(tagger, plain)) <= 1


def test_read_equals_emissions():
    t = pii.Tagger(seed=4)
    ids = np.random.default_rng(0).integers(0, 128, (5, 40))
    slow, _ = t.emissions(ids)
    assert np.abs(t.read(ids).transpose(0, 2, 1) - slow).max() < 1e-4


def test_the_path_is_the_best_of_the_whole_text():
    """Stretches and windows change nothing: one Viterbi over each whole text's emissions gives the same runs."""
    made, examples, r = pii.Tagger(seed=3), pii.Examples(12), random.Random(6)
    windows = [examples.placed("some words of a plain text go here and on and on, then more of the same until the window is full"[: pii.TRAIN]) for _ in range(400)]
    ids = np.array([np.r_[pii.encode(w), np.zeros(pii.TRAIN - len(w), int)] for w, _ in windows])
    made.train(ids, np.array([y for _, y in windows]), epochs=5, batch=64)
    texts = ["", "a", "x" * pii.WINDOW, "y" * (pii.STRIDE + pii.OVERLAP), "z" * (pii.STRIDE + pii.OVERLAP + 1)]
    texts += ["".join(r.choice([examples.email(), examples.ip(), examples.phone(), examples.card(), examples.none(), examples.letters(20, 90), " plain words "]) + r.choice(" \n") for _ in range(r.randint(0, 60))) for _ in range(40)]
    points = [pii.encode(t) for t in texts]
    offsets = np.cumsum([0, *map(len, points)])
    e = pii.blended(made, np.concatenate(points), offsets)
    runs = pii.tagged_runs(made, np.concatenate(points), offsets)
    assert len(runs) > 100
    for k in range(len(texts)):
        x = e[offsets[k] : offsets[k + 1]]
        if len(x):
            whole = made.path(x[None], np.array([len(x)]), np.array([True]), np.array([True]))[0]
            got = score_of(made, x, read_tags(whole, runs, k))
            assert abs(got - score_of(made, x, whole)) < 1e-2


def read_tags(whole, runs, k):
    """The tags of the runs of text k, each with the first tag of the whole path there."""
    out = np.zeros(len(whole), int)
    for i, kind, a, b, _ in runs:
        if i == k:
            out[a:b] = 2 + 2 * kind
            out[a] = whole[a] if (whole[a] - 1) // 2 == kind and whole[a] else 1 + 2 * kind
    return out


def score_of(tagger, e, tags):
    return float(tagger.p["S"][tags[0]] + e[np.arange(len(tags)), tags].sum() + tagger.steps[tags[:-1], tags[1:]].sum())
