"""Byte-level BPE encoding and decoding.

The text is split by the tokenizer's pattern; each distinct piece of a batch is a row of a padded matrix, rows of like
length together. Each round every row merges its leftmost pair of least rank: pairs are looked up in a hash table of
all pairs of tokens that join to a token, only the two pairs beside a merge are looked up again, and rows that are done
leave the matrix. Distinct pieces are found by hash and each is compared with the remembered piece. Pieces over LONG bytes form a matrix of one row in which a round merges all places of the least
pair, from the left, up to the first merge that makes a pair of lower rank; the result is the same.

Null texts count as empty: no tokens, hashes of the empty string. The ranks (a fixed vocabulary of a few MB whatever the
data) are read on the driver and broadcast. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestrata.llm import textkernel as tk
from lodestrata.llm.textkernel import pieces

NONE = np.iinfo(np.int32).max
LONG = 128
#: Distinct pieces a worker remembers (and 16 characters for each); then it starts anew.
CACHE = 600_000
#: Fixed value: the pattern that has a vectorised splitter here; another pattern goes through the regex module.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the characters of Unicode's White_Space property.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Ranks as arrays: token ids of the 256 bytes, and an open-addressing hash of (left id, right id) -> joined id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, to = [], [], []
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(i)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 4))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        todo, at, vals = keys, self.slot(keys), np.array(to, np.int32)
        while len(todo):  # those that find their slot free and are first there settle; the rest move one on
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(at), bool)
            take[first] = True
            take &= free
            self.keys[at[take]], self.vals[at[take]] = todo[take], vals[take]
            todo, vals, at = todo[~take], vals[~take], (at[~take] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id (it is its rank) that each pair makes, NONE for no token; an id below zero is padding."""
        keys = left.astype(np.int64).view(np.uint64) << np.uint64(32) | right.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
        out = np.full(len(keys), NONE, np.int32)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        at = self.slot(keys[live])
        while len(live):
            found = self.keys[at]
            hit = found == keys[live]
            out[live[hit]] = self.vals[at[hit]]
            on = ~hit & (found != np.uint64(2**64 - 1))
            live, at = live[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_rows(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all byte strings on end, and how many each has."""
        counts = np.zeros(len(rows), np.int64)
        sizes = np.array([len(r) for r in rows], np.int64)
        whole = np.array([self.ranks.get(r, -1) for r in rows], np.int64)
        done = [(np.flatnonzero(whole >= 0), np.ones(int((whole >= 0).sum()), np.int64), whole[whole >= 0])]
        for i in np.flatnonzero((whole < 0) & (sizes > LONG)).tolist():
            ids = self.encode_long(rows[i])
            done.append((np.array([i]), np.array([len(ids)]), ids))
        bucket = np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
        open_ = (whole < 0) & (sizes > 0) & (sizes <= LONG)
        for b in np.unique(bucket[open_]).tolist():
            members = np.flatnonzero(open_ & (bucket == b))
            step = max(1, (1 << 19) >> b)
            for k in range(0, len(members), step):
                done += self.encode_matrix(rows, members[k : k + step], 1 << b)
        for at, n, _ in done:
            counts[at] = n
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for at, n, ids in done:
            flat[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def encode_matrix(self, rows: list[bytes], members: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their numbers of ids, the ids on end) of the rows `members`, none over `width` bytes, as they are done."""
        n, done = len(members), []
        ids = np.full((n, width + 1), -1, np.int32)
        size = np.array([len(rows[i]) for i in members.tolist()])
        ids[np.arange(width + 1)[None, :] < size[:, None]] = self.byte[np.frombuffer(b"".join([rows[i] for i in members.tolist()]), np.uint8)]
        rank = np.full((n, width + 1), NONE, np.int32)
        rank[:, :-1] = self.join(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        live, place = members, np.arange(width + 1)
        while len(live):
            at = rank.argmin(axis=1)  # the leftmost of the least
            best = rank[np.arange(len(live)), at]
            stop = best == NONE
            if stop.any():  # compaction: rows with nothing left to merge go
                left = ids[stop]
                done.append((live[stop], size[stop], left[left >= 0]))
                on = ~stop
                live, ids, rank, size, at, best = live[on], ids[on], rank[on], size[on], at[on], best[on]
                if not len(live):
                    break
                w = int(size.max())
                if w + 1 < ids.shape[1]:
                    ids, rank, place = ids[:, : w + 1], rank[:, : w + 1], np.arange(w + 1)
            row = np.arange(len(live))
            source = np.minimum(place[None, :] + (place[None, :] > at[:, None]), len(place) - 1) + row[:, None] * len(place)
            ids = np.take(np.ascontiguousarray(ids), source)
            rank = np.take(np.ascontiguousarray(rank), source)
            ids[:, -1], rank[:, -1] = -1, NONE
            ids[row, at] = best
            size = size - 1
            after = np.minimum(at + 1, len(place) - 1)
            rank[row, at] = self.join(best, ids[row, after])
            b = np.flatnonzero(at > 0)
            rank[b, at[b] - 1] = self.join(ids[b, at[b] - 1], best[b])
        return done

    def encode_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        rank = self.join(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            if len(at) > 1:  # of overlapping places, every second from the left
                run = np.cumsum(np.r_[True, np.diff(at) > 1]) - 1
                at = at[(at - at[np.r_[True, np.diff(at) > 1]][run]) % 2 == 0]
            merged = ids.copy()
            merged[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new, where = merged[keep], np.cumsum(keep)[at] - 1
            around = self.join(new[:-1], new[1:]) if len(new) > 1 else np.zeros(0, np.int32)
            lower = np.zeros(len(at), bool)
            for d in (-1, 0):
                ok = (where + d >= 0) & (where + d < len(around))
                lower[ok] |= around[where[ok] + d] < best
            if lower.any():  # a merge that opens a lower rank ends the round
                at = at[: int(np.argmax(lower)) + 1]
                merged = ids.copy()
                merged[at] = best
                keep = np.ones(len(ids), bool)
                keep[at + 1] = False
                new = merged[keep]
                around = self.join(new[:-1], new[1:]) if len(new) > 1 else np.zeros(0, np.int32)
            ids, rank = new, around
        return ids

    @cached_property
    def tables(self) -> tuple[np.ndarray, ...]:
        """For each id: where its decimal digits with a blank, and its bytes, lie in one array, and their lengths."""
        out = []
        n = max(self.token) + 1
        for parts in ([b" %d" % i for i in range(n)], [self.token.get(i, b"") for i in range(n)]):
            sizes = np.array([len(x) for x in parts], np.int64)
            out += [np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes]
        return tuple(out)

    def decimal(self, ids: np.ndarray) -> bytes:
        data, start, size = self.tables[:3]
        return gather(data, start[ids], size[ids])[1:].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        data, start, size = self.tables[3:]
        return gather(data, start[ids], size[ids]).tobytes()


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of data from each start, on end."""
    total = int(sizes.sum())
    return data[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)] if total else data[:0]


@lru_cache(1)
def classes() -> np.ndarray:
    """For each code point 1 for letters, 2 for numbers, 3 for white space, 0 for the rest."""
    kind = np.zeros(0x110000, np.uint8)
    first = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    kind[first == ord("L")] = 1
    kind[first == ord("N")] = 2
    kind[[ord(c) for c in WHITE]] = 3
    return kind


def split_points(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the matches of PATTERN begin in the code points of texts on end; no match crosses a text's start.

    A match is a run of letters, numbers or other signs, with one blank before it if there is one; white space before
    such a run gives up its last character; an apostrophe that begins a match takes a contraction's letters.
    """
    n = len(points)
    kind = classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[doc_starts[doc_starts < n]] = True
    new = begins[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    white = kind == 3
    solid = np.flatnonzero(new & ~white)  # a run that may take the blank before it
    start = new.copy()
    before = solid[(solid > 0) & ~begins[solid]] - 1
    before = before[white[before]]
    start[before] = True  # the last white space goes with the run, or alone
    blank = before[points[before] == 32]
    start[blank + 1] = False
    # contractions: a lone apostrophe that no blank was joined to, and the letters after it
    quote = np.flatnonzero(start & (points == 39))
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == 1) & ~begins[quote + 1]]
    one = np.isin(points[quote + 1], [ord(c) for c in "stmd"])
    two = np.zeros(len(quote), bool)
    far = np.flatnonzero(quote + 2 < n)
    far = far[~begins[quote[far] + 2]]
    for a, b in ("re", "ve", "ll"):
        two[far] |= (points[quote[far] + 1] == ord(a)) & (points[quote[far] + 2] == ord(b))
    start[quote[one | two] + 1] = False
    for at, size in ((quote[one], 2), (quote[two & ~one], 3)):
        after = at + size
        after = after[after < n]
        start[after[(kind[after] == 1)]] = True
    return np.flatnonzero(start)


class Codec:
    """Encodes texts; each distinct piece once while it is remembered."""

    def __init__(self, table: PairTable):
        self.table = table
        self.regex = None if table.pattern == PATTERN else regex.compile(table.pattern).finditer
        self.clear()

    def clear(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.points, self.at, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.counts) > CACHE or len(self.points) > 16 * CACHE:
            self.clear()
        whole = "".join(texts)
        offsets = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return [np.zeros(0, np.int32) for _ in texts]
        if self.regex is None:
            starts = split_points(points, offsets[:-1])
            ends = np.append(starts[1:], len(points))
        else:
            spans = [(m.start() + o, m.end() + o) for t, o in zip(texts, offsets.tolist(), strict=False) for m in self.regex(t) if m.end() > m.start()]
            starts, ends = np.array(spans, np.int64).reshape(-1, 2).T
        sizes = ends - starts
        unique, first, code = np.unique(tk.word_hashes(points.view(np.uint8), 4 * starts, 4 * ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        numbers = np.empty(len(unique), np.int64)
        numbers[known] = self.numbers[at[known]]
        fresh = first[~known]
        if len(fresh):
            numbers[~known] = self.remember(whole, points, starts[fresh], ends[fresh])
            spot = np.searchsorted(self.hashes, unique[~known])
            self.hashes = np.insert(self.hashes, spot, unique[~known])
            self.numbers = np.insert(self.numbers, spot, numbers[~known])
        codes = numbers[code]
        # a hash only proposes a piece: each is compared with the remembered one, and the others are encoded by themselves
        wrong = self.sizes[codes] != sizes
        fine = np.flatnonzero(~wrong)
        wrong[fine] = ~tk.same_bytes(points, starts[fine], self.points, self.at[codes[fine]], sizes[fine])
        if wrong.any():
            codes[wrong] = self.remember(whole, points, starts[wrong], ends[wrong])
        begin = np.cumsum(self.counts) - self.counts
        cut = np.searchsorted(starts, offsets)
        return [gather(self.flat, begin[codes[a:b]], self.counts[codes[a:b]]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def remember(self, whole: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode these pieces, whatever their hashes, and keep them; returns their numbers."""
        flat, counts = self.table.encode_rows([whole[s:e].encode("utf-8", "surrogatepass") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        numbers = len(self.counts) + np.arange(len(starts))
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        sizes = ends - starts
        self.at = np.concatenate([self.at, len(self.points) + np.cumsum(sizes) - sizes])
        self.points, self.sizes = np.concatenate([self.points, gather(points, starts, sizes)]), np.concatenate([self.sizes, sizes])
        return numbers


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, columns: list[str], texts: str = "text", keep_ids: bool = False) -> DataFrame:
    """`columns` of docs with n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids themselves."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((read_ranks(ranks_path), pattern))
    frame = docs.select(*columns, docs[texts].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(PairTable(*shipped.value))
        for batch in batches:
            column = batch.column("_text")
            for lo, hi in pieces(column):
                part = batch.slice(lo, hi - lo)
                n, ids_hash, text_hash, kept = [], [], [], []
                for ids in codec.encode([t or "" for t in part.column("_text").to_pylist()]):
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(codec.table.decimal(ids)).hexdigest())
                    text_hash.append(hashlib.sha256(codec.table.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                out = [part.column(c) for c in columns] + [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = [*columns, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.drop("_text").schema)
    return frame.mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids)


def decode_ids(docs: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """docs with `out`: the text of the token ids (null ids give null; bytes that aren't UTF-8 become U+FFFD)."""
    shipped = docs.sparkSession.sparkContext.broadcast({i: t for t, i in read_ranks(ranks_path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shipped.value
        for batch in batches:
            texts = [None if r is None else b"".join([token[i] for i in r]).decode("utf-8", "replace") for r in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{out}` string")
