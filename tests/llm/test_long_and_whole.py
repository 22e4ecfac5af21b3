"""Very long texts in every kernel, and the whole pipeline against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from lodestrata.llm import bpe, html_extract, minhash, mixing, pii, quality, suffix_tree

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = r"[^\x20\x09-\x0D]+"


def long_text():
    r = random.Random(3)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(120_000)) + " " + "z" * 300_000


def test_very_long_texts():
    text = long_text()
    words = re.findall(WORD, text)
    column = pa.array(["short text", text, None, ""])
    x = {c: np.concatenate([p[2][c] for p in quality.measure(column)]) for c in ("n_words", "word_chars", "n_repeat_words")}
    assert x["n_words"].tolist() == [2, len(words), 0, 0] and x["word_chars"][1] == sum(map(len, words)) and x["n_repeat_words"][1] == 0
    sets = [s for _, _, part in minhash.row_sets(column, 2) for s in part]
    assert [len(s) for s in sets] == [1, len(set(zip(words, words[1:], strict=False))), 0, 0]
    assert mixing.measured(column).field("tokens").to_pylist() == [2, len(words), 0, 0]
    n = sum(len(h) - 1 for _, _, _, heads, h, rows in suffix_tree.streams(pa.array([text])))
    assert n == len(words)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    codec = bpe.Codec(bpe.PairTable(bpe.read_ranks(PATH), public_tokenizers.PATTERN))
    some = text[:200_000] + " " + "z" * 20_000
    assert codec.encode([some])[0].tolist() == reference.encode_ordinary(some)
    spans = list(pii.spans_of(pii.Tagger(seed=2), [text[:60_000] + " ann@mail.example.org"]))[0][0]
    assert spans == [("email", 60_001, 60_001 + len("ann@mail.example.org"))]
    lines = html_extract.lines_of("<article>" + "".join(f"<p>{w}</p>" for w in words[:40_000]) + "</article>")
    assert [t for t, _ in lines] == words[:40_000]


def plain_draw(docs):
    """The documents that raking to the tables' own shares keeps, by a plain loop."""
    import hashlib

    def cell(t, lang, source):
        n = len(re.findall(WORD, t or ""))
        kind = "symbols" if 10 * len(re.findall(r"[#*$%&|<>]", t or "")) > n else "capitals" if 3 * len(re.findall("[A-Z]", t or "")) > len(t or "") else "short prose" if n < 100 else "prose" if n < 500 else "long prose"
        return (source or "", lang or "", kind), n

    own, factor = Counter(), Counter()
    for _, t, lang, source in docs:
        c, n = cell(t, lang, source)
        own[c] += n
    own = {c: n for c, n in own.items() if n}
    factor = dict.fromkeys(own, 1.0)
    whole = sum(own.values())
    for _ in range(300):
        for axis in range(3):
            have, base = Counter(), Counter()
            for c, n in own.items():
                have[c[axis]] += n * factor[c] / whole
                base[c[axis]] += n
            norm = sum(v**mixing.ALPHA for v in base.values())
            for c in own:
                factor[c] *= base[c[axis]] ** mixing.ALPHA / norm / have[c[axis]]
    top = max(factor.values())
    draw = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) / 2**32
    return [d for d in docs if draw(d[0]) < factor.get(cell(*d[1:])[0], top) / top]


def test_pipeline_against_plain_versions(spark, tmp_path):
    r = random.Random(8)
    words = "the old mill by the river was sold to a family from the town who want to grind corn again".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    good = [(k, say(r.choice([60, 150])), r.choice(["en", "de"]), r.choice("aab")) for k in range(80)]
    copies = [(200 + k, t + " Truly.", lang, s) for k, t, lang, s in good[:20]] + [(300 + k, t, lang, s) for k, t, lang, s in good[:10]]
    bad = [(400 + k, "NO!! *** " * 60, "en", "a") for k in range(5)] + [(500, None, None, None), (501, "", "en", "a"), (502, "too short", "en", "a")]
    rows = good + copies + bad + [good[3]]
    r.shuffle(rows)
    spark.createDataFrame([(*x, len(x[1] or ""), "kept") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((x.doc_id, x.n_tokens) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # quality: the good texts; near-duplicates: the least id of each group of the same words up to one more; no personal data in any
    left = {}
    for i, t, lang, s in sorted(x for x in rows if x[1] and len(x[1].split()) >= 20 and "!!" not in x[1]):
        left.setdefault(tuple(t.removesuffix(" Truly.").split()), (i, t, lang, s))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    want = Counter((i, len(reference.encode_ordinary(t))) for i, t, *_ in plain_draw(list(left.values())))
    assert got == want and 0 < len(got) < 80
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
