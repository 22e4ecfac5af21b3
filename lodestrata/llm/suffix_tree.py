"""Language-model scoring by a probabilistic suffix tree.

Symbols are the bytes of a text's words, lower-cased (A-Z), each word closed by a blank, then one end sign; a text of no
words is the end sign alone. Contexts are the last 0 to DEPTH symbols. Counts of all contexts cover all training texts.
Level by level a context is retained if its next-symbol counts diverge from what the longest retained shorter context
predicts: their log-likelihood gain must reach THETA nats for each distinct next symbol. A retained state's distribution
is smoothed by taking DISCOUNT off every count and giving that mass to the shorter state's distribution (at the root, to
the even distribution over 256 symbols). Each symbol of a text is scored in its longest suffix state.

THETA is fixed: every context that reaches it is retained, however many there are, and the retained states stay in tables
joined by key. Each distinct context with next symbol of all texts, held-out ones too, gets its log-probability there. Those
of greatest count, at most MOST_GRAMS, are broadcast; the other ones' come by a join on those alone. Word counts for the base
score go the same way, with MOST_WORDS. Both bounds say what is sent, not what is counted, and change no result.

Training texts are those whose crc32(doc_id as text) mod 5 is not 1 (null ids train). Null texts are empty. Rows are
scored one by one, repeated rows alike; with no training texts N and V are 0 and the tree is the even distribution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textkernel as tk
from lodestrata.llm.shared import stash

DEPTH, DISCOUNT, THETA = 5, 0.8, 2.0
MOST_GRAMS, MOST_WORDS = 2_000_000, 1_000_000
START, BLANK, END = 0x0A, 0x20, 0x0D
END_WORD = np.uint64(1)
#: Counts up to this go by their own value, larger ones by steps of an eighth of a doubling, to find what to broadcast.
STEPS = 8


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def streams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, symbols, start of each row among them, word hashes with END_WORD after each row, start of each row among those).

    Each row's symbols are DEPTH start signs, its words each with a blank, the end sign.
    """
    for lo, hi in tk.pieces(column, 2 * tk.STEP):
        data, offsets = tk.column_bytes(column.slice(lo, hi - lo))
        data = tk.LOWER[data]
        starts, ends, firsts = tk.words(data, offsets)
        hashes = np.insert(tk.word_hashes(data, starts, ends), firsts[1:], END_WORD)
        rows = firsts[:-1] + np.arange(hi - lo)
        # segments: for each row its start signs, its words, its end sign
        at = np.concatenate([firsts[:-1], firsts[1:]])
        kind = np.concatenate([np.full(hi - lo, 1), np.full(hi - lo, 2)])
        order = np.lexsort((np.tile(np.arange(hi - lo), 2) * 2 + (kind == 2), at))
        at, kind = at[order], kind[order]
        size = np.insert(ends - starts + 1, at, np.where(kind == 1, DEPTH, 1))
        begin = np.insert(starts, at, 0)
        kinds = np.insert(np.zeros(len(starts), np.int64), at, kind)
        last = np.cumsum(size)
        index = np.repeat(begin - (last - size), size) + np.arange(int(last[-1]) if len(last) else 0)
        padded = np.append(data, np.zeros(DEPTH + 1, np.uint8))
        symbols = padded[np.minimum(index, len(padded) - 1)]
        symbols[last[kinds == 0] - 1] = BLANK
        symbols[last[kinds == 2] - 1] = END
        heads = (last - size)[kinds == 1]
        symbols[(heads[:, None] + np.arange(DEPTH)[None, :]).ravel()] = START
        yield lo, hi, symbols, heads, hashes, rows


def contexts(symbols: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (DEPTH symbols, then the next) of the scored places, and which places those are: all but the start signs."""
    keys = np.zeros(len(symbols), np.uint64)
    for j in range(DEPTH + 1):
        d = DEPTH - j
        keys[d:] |= symbols[: len(symbols) - d].astype(np.uint64) << np.uint64(8 * d)
    scored = np.ones(len(symbols), bool)
    scored[(heads[:, None] + np.arange(DEPTH)[None, :]).ravel()] = False
    return keys[scored], scored


class Sums:
    """Counts by 64-bit key; merged whenever they have doubled."""

    def __init__(self) -> None:
        self.keys, self.counts, self.loose, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        codes, unique = pd.factorize(keys)
        self.loose.append((unique, np.bincount(codes, minlength=len(unique))))
        self.n += len(unique)
        if self.n > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.loose]])
        counts = np.concatenate([self.counts, *[c for _, c in self.loose]])
        self.keys, where = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(where, weights=counts, minlength=len(self.keys)).astype(np.int64)
        self.loose, self.n = [], 0


def counted(docs: DataFrame) -> DataFrame:
    """kind (0: words of training texts, 1: contexts with next symbol of all texts), key, n in training texts, m in all counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, others = Sums(), Sums(), Sums()
        for batch in batches:
            held = batch.column("held").to_numpy(zero_copy_only=False)
            for lo, hi, symbols, heads, hashes, rows in streams(batch.column("text")):
                apart = held[lo:hi]
                words.add(hashes[~np.repeat(apart, np.diff(np.append(rows, len(hashes))))])
                keys, scored = contexts(symbols, heads)
                apart = np.repeat(apart, np.diff(np.append(heads, len(symbols))))[scored]
                grams.add(keys[~apart])
                others.add(keys[apart])
        for kind, s, train in (0, words, 1), (1, grams, 1), (1, others, 0):
            s.merge()
            for lo in range(0, len(s.keys), 1 << 16):
                k, m = s.keys[lo : lo + (1 << 16)], s.counts[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(m * train), pa.array(m)], names=["kind", "key", "n", "m"]
                )

    texts = docs.select("text", held_out(F.col("doc_id")).alias("held"))
    return texts.mapInArrow(run, "kind byte, key long, n long, m long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def low(key: str, size: int) -> Column:
    """The last `size` symbols of a key."""
    return F.col(key).bitwiseAND(F.lit((1 << (8 * size)) - 1).cast("long"))


def grow(grams: DataFrame, theta: float) -> list[DataFrame]:
    """The tree from (key, n, m): for each level all its contexts with next symbol, the context `ctx` and whether it is retained.

    key, ctx, m, p, rest, keep: p the probability of key's last symbol in its longest retained state up to this level, rest the
    mass that ctx passes on.
    """
    levels: list[DataFrame] = []
    for level in range(DEPTH + 1):
        rows = grams.groupBy(low("key", level + 1).alias("key")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        rows = rows.withColumn("ctx", F.shiftright("key", 8))
        if not levels:
            rows = rows.withColumn("base", F.lit(1.0 / 256))
        else:
            rows = rows.withColumn("short", low("key", level)).join(levels[-1].select(F.col("key").alias("short"), F.col("p").alias("base")), "short")
        rows = stash(rows.select("key", "ctx", "n", "m", "base"), f"level{level}")
        whole = rows.groupBy("ctx").agg(F.sum("n").alias("whole"), F.count("*").alias("types"))
        rows = rows.join(whole, "ctx").withColumn("rest", F.lit(DISCOUNT) * F.col("types") / F.col("whole"))
        rows = rows.withColumn("q", F.greatest(F.col("n") - F.lit(DISCOUNT), F.lit(0.0)) / F.col("whole") + F.col("rest") * F.col("base"))
        gains = rows.groupBy("ctx").agg((F.sum(F.col("n") * F.log(F.col("q") / F.col("base"))) >= theta * F.max("types")).alias("keep"))
        rows = rows.join(gains, "ctx").withColumn("p", F.when(F.col("keep"), F.col("q")).otherwise(F.col("base")))
        levels.append(stash(rows.select("key", "ctx", "m", "p", "rest", "keep"), f"level{level}"))
    return levels


def logs(grams: DataFrame) -> DataFrame:
    """key, m, log: log10 probability of the last symbol of each key of (key, n, m); n is 0 for keys no training text has."""
    levels = grow(grams.where("n > 0"), THETA)
    # a key of the training texts has all its suffixes there, so the last level has its probability
    seen = levels[DEPTH].select("key", "m", F.log10("p").alias("log"))
    out = grams.where("n = 0").select("key", "m", F.lit(0.0).alias("log"), F.lit(None).cast("double").alias("p"))
    for level in range(DEPTH, -1, -1):
        small = F.broadcast if level < 2 else (lambda t: t)  # at most 65,536 rows
        if level < DEPTH:
            entries = levels[level].select(F.col("key").alias("_key"), F.col("p").alias("_p"))
            out = out.join(small(entries), low("key", level + 1) == F.col("_key"), "left").withColumn("p", F.coalesce("p", "_p")).drop("_key", "_p")
        states = levels[level].where("keep").groupBy(F.col("ctx").alias("_ctx")).agg(F.first("rest").alias("_rest"))
        out = out.join(small(states), F.shiftright(low("key", level + 1), 8) == F.col("_ctx"), "left")
        passed = F.when(F.col("p").isNull() & F.col("_rest").isNotNull(), F.log10("_rest")).otherwise(0.0)
        out = out.withColumn("log", F.col("log") + passed).drop("_ctx", "_rest")
    out = out.select("key", "m", (F.col("log") + F.log10(F.coalesce("p", F.lit(1.0 / 256)))).alias("log"))
    return seen.unionByName(out)


def common(rows: DataFrame, count: str, most: int) -> Column:
    """Which rows are of the greatest counts, at most `most` of them."""
    n = F.col(count)
    step = F.when(n <= 16, n).otherwise(16 + F.floor(STEPS * F.log2(n / 16.0))).cast("int")
    sizes = rows.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    least, held = None, 0
    for r in sizes:  # some hundred steps at most
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    return step >= F.lit(least if least is not None else 1 << 30)


def fetched(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, and their values."""
    part = rows.select("key", value).toArrow()
    keys, values = part["key"].to_numpy(), part[value].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each key, 0 if it is not known, and whether it is."""
    if not len(known):
        return np.zeros(len(keys), values.dtype), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return np.where(hit, values[at], 0), hit


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    counts = stash(counted(docs), "counts")
    grams = stash(logs(counts.where("kind = 1").select("key", "n", "m")), "logs")
    words = counts.where("kind = 0").select("key", "n")
    total = words.agg(F.sum("n"), F.count("*")).first()
    n_all, v_all = int(total[0] or 0), int(total[1])
    often, often_grams = common(words, "n", MOST_WORDS), common(grams, "m", MOST_GRAMS)
    bottom = n_all + 0.5 * (v_all + 1)
    shipped = docs.sparkSession.sparkContext.broadcast((*fetched(words.where(often), "n"), *fetched(grams.where(often_grams), "log")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_known, known_grams, log_grams = shipped.value
        for batch in batches:
            for lo, hi, symbols, heads, hashes, rows in streams(batch.column("text")):
                keys, scored = contexts(symbols, heads)
                codes, unique = pd.factorize(keys.view(np.int64))
                value, hit = looked_up(unique, known_grams, log_grams)
                log = np.zeros(len(symbols))
                log[scored] = value[codes]
                lost = np.flatnonzero(~hit[codes])
                rare_grams = unique[codes[lost]]
                cut_grams = np.searchsorted(np.flatnonzero(scored)[lost], np.append(heads, len(symbols)))
                codes, unique = pd.factorize(hashes.view(np.int64))
                c, hit = looked_up(unique, known, n_known)
                base = np.where(hit, np.log10((c + 0.5) / bottom), 0.0)[codes]
                found = hit[codes]
                rare = np.flatnonzero(~found)
                cut = np.searchsorted(rare, np.append(rows, len(hashes)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.diff(np.append(rows, len(hashes)))),
                        pa.array(np.add.reduceat(found.astype(np.int64), rows)),
                        pa.array(np.add.reduceat(base, rows)),
                        pa.array(np.add.reduceat(log, heads)),
                        tk.nested([hashes[rare[a:b]].view(np.int64) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.int64()),
                        tk.nested([rare_grams[a:b] for a, b in zip(cut_grams[:-1].tolist(), cut_grams[1:].tolist(), strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "base", "score", "rare", "rare_grams"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    part = docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base double, score double, rare array<long>, rare_grams array<long>")
    part = stash(part.withColumn("row", F.monotonically_increasing_id()), "scored")  # written once, so the numbers hold
    rare = part.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("m"))
    rare = rare.join(words.where(~often), "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("more_known"),
        F.sum(F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(bottom))).alias("more"),
    )
    tail = part.select("row", F.explode("rare_grams").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    tail = tail.join(grams.where(~often_grams).select("key", "log"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    out = part.drop("rare", "rare_grams").join(rare, "row", "left").join(tail, "row", "left")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
