"""Words that a polynomial hash cannot tell apart: each operator tells them apart by their bytes."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken

from lodestrata.llm import bpe, minhash, quality, suffix_tree
from lodestrata.llm import textkernel as tk

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


ONE, TWO = thue_morse(1024)


def hashed(words):
    data, offsets = tk.column_bytes(pa.array(words))
    return tk.word_hashes(data, offsets[:-1], offsets[1:])


def test_word_hashes_are_of_the_bytes():
    r = random.Random(1)
    words = ["".join(r.choice("ab\0é") for _ in range(n)) for n in range(140) for _ in range(20)] + list(thue_morse(16)) + list(thue_morse(64)) + [ONE, TWO]
    h = hashed(words)
    assert len(set(h.tolist())) == len(set(words))
    assert (hashed(words[::-1])[::-1] == h).all()
    data, offsets = tk.column_bytes(pa.array(words))
    for hashes in (h, h & np.uint64(3), h * np.uint64(0)):  # however bad the hashes, numbers follow the bytes
        ids = tk.exact_ids(data, offsets[:-1], offsets[1:], hashes)
        assert len(set(zip(ids.tolist(), words, strict=True))) == len(set(ids.tolist())) == len(set(words))


def test_encoding(monkeypatch):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    codec = bpe.Codec(bpe.PairTable(bpe.read_ranks(PATH), public_tokenizers.PATTERN))
    texts = [ONE, TWO, f"{TWO} {ONE}", "plain words, plain", "other words"]
    for _ in range(2):
        assert [x.tolist() for x in codec.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(tk, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    codec.clear()
    for _ in range(2):  # nearly all hashes collide
        assert [x.tolist() for x in codec.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_near_duplicates_of_alike_words(spark):
    docs = spark.createDataFrame([(1, f"{ONE} one"), (2, f"{TWO} one"), (3, f"{ONE}  ONE")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2).collect()} == {1: 1, 2: 2, 3: 1}


def test_classes_of_one_name_are_kept_apart(spark):
    """Two sets whose 64-bit names are the same are two classes, in the sketches and in the full sets."""
    rows = spark.createDataFrame([(1, 7, 21, 2), (2, 7, 22, 2), (3, 8, 23, 2), (4, 7, 21, 2), (5, 0, 0, 0)], "doc_id long, h0 long, h1 long, n_shingles long")
    out, clash = minhash.named_apart(rows)
    assert clash == [7] and {r.doc_id: r.h0 for r in out.collect()} == {1: 21, 2: 22, 3: 8, 4: 21, 5: 0}
    texts = spark.createDataFrame([("a b c d",), ("e f g h i",)], "text string")
    names = [r.h0 for r in minhash.full_sets(texts, 2, []).collect()]
    again = [r.h0 for r in minhash.full_sets(texts, 2, names[:1]).collect()]
    sketched = [(r.h0, r.h1) for r in minhash.sketches(texts.selectExpr("1L doc_id", "text"), 2).collect()]
    assert [h for h, _ in sketched] == names and again == [sketched[0][1], names[1]]


def test_known_words(spark):
    rows = [(i, ONE) for i in range(12)] + [(100 + i, TWO) for i in range(12) if zlib.crc32(str(100 + i).encode()) % 5 == 1]
    out = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.n_known for r in out if r.doc_id >= 100} == {1} and {r.n_known for r in out if r.doc_id < 100} == {2}


def test_repeated_windows(monkeypatch):
    one = [ONE, *"bcdefgh"]
    text = " ".join([*one, "x", TWO, *"bcdefgh", "y", *one])
    count = lambda: next(quality.measure(pa.array([text])))[2]["n_repeat_words"][0]
    assert count() == 16
    monkeypatch.setattr(tk, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    assert count() == 16
