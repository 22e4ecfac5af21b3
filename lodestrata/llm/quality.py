"""Quality rules as weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of vote patterns, from a soft
majority on, estimates how often each rule votes bad on good and on bad documents (its two accuracies); a document's
posterior probability of being good then replaces the filter that all rules must pass: a bad vote of a rule that often errs
is outvoted. The patterns are at most 3^len(RULES) = 59,049 whatever
the corpus, counted over all documents, so their counts may go to the driver and the posteriors back.

Words are runs of characters other than 0x20 and 0x09-0x0D. Null texts have no words; documents under 20 words or with
over 30 % of their words in repeated 8-word windows fail at once. Rows are judged one by one: null ids, repeated rows
and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textkernel as tk

WINDOW = 8
#: (name, measure, votes bad from, votes good below, words below which it abstains); between the two it abstains too.
#: Thresholds are set so that each rule alone votes bad on at most some per cent of the documents that `labels` calls good;
#: how far each is to be trusted is left to the estimate. The README compares estimated and labelled rates.
RULES = [
    ("symbols", "symbols", 0.10, 0.03, 1),
    ("capitals", "capitals", 0.30, 0.12, 1),
    ("exclamations", "exclaims", 0.10, 0.04, 1),
    ("repeated windows", "repeats", 0.10, 0.03, 20),
    ("duplicate lines", "dup_lines", 0.20, 0.10, 20),
    ("stutter", "stutter", 0.05, 0.03, 20),
    ("separators", "no_letters", 0.10, 0.03, 1),
    ("word length", "odd_length", 0.52, 0.40, 20),
    ("short words", "few_short", 0.92, 0.88, 30),
    ("sentence ends", "few_ends", 0.98, 0.96, 40),
]
GOOD, BAD, NONE = 1, 2, 0


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL = _flags(b"#*$%&|<>")
_UPPER = _flags(bytes(range(65, 91)))
_CASED = _UPPER + _flags(bytes(range(97, 123)))
_SENSE = _CASED + _flags(bytes(range(48, 58))) + _flags(bytes(range(128, 256)))
_LEAD = 1 - _flags(bytes(range(128, 192)))  # begins a code point
_END = _flags(b".?!:;")


def repeated_words(hashes: np.ndarray, exact: Callable[[], np.ndarray]) -> int:
    """Words in windows of WINDOW words that occur twice or more, the first occurrence included.

    Window hashes propose; where two agree the windows' words, as exact() numbers them, decide.
    """
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    s = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        s = tk.mix(s ^ hashes[j : j + n])
    order = np.argsort(s, kind="stable")
    t = s[order]
    same = t[1:] == t[:-1]
    if not same.any():
        return 0
    ids = exact()
    twice = np.zeros(n, np.int64)
    a, b = order[:-1][same], order[1:][same]
    if all((ids[a + j] == ids[b + j]).all() for j in range(WINDOW)):
        twice[a] = twice[b] = 1
    else:
        count = Counter(ids[k : k + WINDOW].tobytes() for k in range(n))
        twice[:] = [count[ids[k : k + WINDOW].tobytes()] > 1 for k in range(n)]
    total = np.zeros(len(hashes) + WINDOW, np.int64)
    total[WINDOW : WINDOW + n] = np.cumsum(twice)
    total[WINDOW + n :] = total[WINDOW + n - 1]
    return int((total[WINDOW:] > total[:-WINDOW]).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measure(column: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(from, to, counts of each row) through a string column."""
    for lo, hi in tk.pieces(column):
        part = column.slice(lo, hi - lo)
        data, offsets = tk.column_bytes(part)

        def by_row(flag: np.ndarray, data: np.ndarray = data, offsets: np.ndarray = offsets) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flag[data], dtype=np.int64)])
            return np.diff(sums[offsets])

        starts, ends, firsts = tk.words(data, offsets)
        hashes = tk.word_hashes(data, starts, ends)
        lead = np.concatenate([[0], np.cumsum(_LEAD[data])])
        sense = np.concatenate([[0], np.cumsum(_SENSE[data])])
        length = lead[ends] - lead[starts]

        def by_word(flag: np.ndarray, firsts: np.ndarray = firsts) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
            return np.diff(sums[firsts])

        def exact(a: int, b: int, data: np.ndarray = data, starts: np.ndarray = starts, ends: np.ndarray = ends, hashes: np.ndarray = hashes) -> np.ndarray:
            return tk.exact_ids(data, starts[a:b], ends[a:b], hashes[a:b])

        again = np.zeros(len(hashes), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again[firsts[:-1][firsts[:-1] < len(again)]] = False
        last = data[ends - 1] if len(ends) else data[:0]
        texts = [t or "" for t in part.to_pylist()]
        yield lo, hi, {
            "n_words": np.diff(firsts),
            "word_chars": by_word(length),
            "n_symbols": by_row(_SYMBOL),
            "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
            "n_lines": np.array([t.count("\n") + 1 for t in texts], np.int64),
            "n_repeat_words": np.array([repeated_words(hashes[a:b], partial(exact, a, b)) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)], np.int64),
            "upper": by_row(_UPPER),
            "cased": by_row(_CASED),
            "exclaim": by_word(last == ord("!")),
            "ended": by_word(_END[last]),
            "empty": by_word(sense[ends] == sense[starts]),
            "short": by_word(length <= 3),
            "again": by_word(again),
        }


def base_failed(x: dict[str, np.ndarray]) -> np.ndarray:
    return (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])


def patterns(x: dict[str, np.ndarray]) -> np.ndarray:
    """The votes of all rules on each row as one number in base 3."""
    n = np.maximum(x["n_words"], 1)
    mean = x["word_chars"] / n
    values = {
        "symbols": x["n_symbols"] / n,
        "capitals": x["upper"] / np.maximum(x["cased"], 1),
        "exclaims": x["exclaim"] / n,
        "repeats": x["n_repeat_words"] / n,
        "dup_lines": x["n_dup_lines"] / np.maximum(x["n_lines"], 1),
        "stutter": x["again"] / n,
        "no_letters": x["empty"] / n,
        "odd_length": np.abs(np.log(np.maximum(mean, 0.1) / 5.0)) / np.log(2.4),
        "few_short": 1 - x["short"] / n,
        "few_ends": 1 - x["ended"] / n,
    }
    out = np.zeros(len(n), np.int64)
    for k, (_, name, bad, good, least) in enumerate(RULES):
        v = values[name]
        vote = np.where(x["n_words"] < least, NONE, np.where(v >= bad, BAD, np.where(v < good, GOOD, NONE)))
        out += vote * 3**k
    return out


def fit(found: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior probability of good for each pattern, and the estimated rates.

    EM starts from the share of good among the votes cast (a soft majority, all rules alike) and runs until no posterior
    moves. Pseudo-counts (a rule votes bad on 5 % of good and on 30 % of bad documents, each worth 20 documents) hold a
    rule that rarely votes near its prior.
    """
    votes = (found[:, None] // 3 ** np.arange(len(RULES))) % 3
    cast, bad = votes != NONE, votes == BAD
    good = (1 + (cast & ~bad).sum(1)) / (2 + cast.sum(1))
    weight = counts.astype(float)
    rates = np.zeros((2, len(RULES)))
    share = 0.5
    for _ in range(rounds):
        for c, r in ((0, good), (1, 1 - good)):
            w = (weight * r)[:, None]
            prior = (0.05, 0.30)[c]
            rates[c] = ((w * bad).sum(0) + 20 * prior) / ((w * cast).sum(0) + 20)
        share = ((weight * good).sum() + 8) / (weight.sum() + 10)
        log = [np.log(s) + (bad * np.log(p) + (cast & ~bad) * np.log1p(-p)).sum(1) for s, p in ((share, rates[0]), (1 - share, rates[1]))]
        before, good = good, 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))
        if np.abs(good - before).max(initial=0) < 1e-9:
            break
    return good, {"bad_on_good": rates[0], "bad_on_bad": rates[1], "good_share": np.array([share])}


def learn(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(patterns, their posteriors, rates) from all documents that pass the base test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, x in measure(batch.column("text")):
                p, n = np.unique(patterns(x)[~base_failed(x)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], names=["pattern", "n"])

    rows = docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    found, counts = rows["pattern"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    return (found, *fit(found, counts))


def judge(x: dict[str, np.ndarray], found: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good, kept) of each row; the posterior is 0 where the base test failed."""
    failed = base_failed(x)
    p = np.zeros(len(failed))
    if len(found):
        at = np.minimum(np.searchsorted(found, patterns(x)), len(found) - 1)
        p = np.where(failed, 0.0, good[at])
    return p, p >= 0.5


def assess(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of docs with the counts, base_failed, the posterior and kept."""
    found, good, _ = learn(docs)
    frame = docs.select(*columns, docs["text"].alias("_text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in measure(batch.column("_text")):
                p, kept = judge(x, found, good)
                own = [batch.column(c).slice(lo, hi - lo) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [*own, *[pa.array(x[c]) for c in counts], pa.array(base_failed(x)), pa.array(kept), pa.array(p)],
                    names=[*columns, *counts, "base_failed", "kept", "posterior"],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.drop("_text").schema)
    return frame.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, posterior double")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the documents that fail; texts are read twice (to learn, to judge) and never shuffled."""
    found, good, _ = learn(docs)
    judged: Callable = judge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in measure(batch.column("text")):
                yield batch.slice(lo, hi - lo).filter(pa.array(judged(x, found, good)[1]))

    return docs.mapInArrow(run, docs.schema)
