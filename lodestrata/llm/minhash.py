"""MinHash near-duplicates with circulant signatures.

One permutation (sigma) of the 64-bit shingle hashes, of which the upper 32 bits are kept, spreads a document's shingles
over 2^32 places; a second (pi), of those places, shifted circularly by k = 1, 2, ..., K, gives all K coordinates: min over
v of pi(sigma(v) - k mod 2^32). Both are computed by multiply and xor-shift. Bands of R coordinates nominate pairs; every
pair is confirmed on the full shingle sets before it links.

Shingles are told apart by keyed 64-bit hashes of their words' bytes (two sets of 10^5 shingles share one falsely with
probability 10^-9); whole sets by 128 bits, so that no two texts count as copies by chance in a corpus of any size.

No bucket is expanded into all its pairs. Documents with the same set are one class first. Then each bucket draws a leader
that the others are compared with (a star); as each document meets another leader in each of its buckets, this joins
nearly all of a large group. What remains are pairs of different components in one bucket. Where they lie in one cluster
(joined by stars at half the similarity), the members outside the cluster's largest component are compared with all its
members, in blocks of bounded size over as many tasks as there are blocks, and only links leave a block; pairs of
different clusters whose one-bit sketches agree enough (in large buckets compared in blocks, too) are confirmed one by one.
So all that could change a component is tested. A pair at similarity 0.8 shares no band with probability
(1 - 0.8^4)^32 < 5e-8.

Short sets fill buckets with what they do not share, and need none: at 0.8 or more, a set of up to 7 shingles links only
with its own copies and with sets of one shingle more that contain it. Those are found by an equi-join on the names of
sets with one shingle left out, exactly; bands are for sets of 8 and more.

Documents without words (null or empty text, only white space) have an empty set, link with nothing and stay. Rows with
the same doc_id share a component. Rows of null doc_id have a null component and stay. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textkernel as tk
from lodestrata.llm.shared import components, stash

BANDS, ROWS = 32, 4
#: Stars from this part of the wanted similarity on make clusters.
CLOSE = 0.6
#: A block of a cluster holds about so many rows and shingles at most.
BLOCK_ROWS, BLOCK_ITEMS = 1024, 400_000
#: Of 128 one-bit coordinates, those that agree at similarity s number 64 (1 + s) on average; 5 deviations below that.
SKETCH_AGREE = 64 * (1 + 0.8) - 5 * (128 * 0.9 * 0.1) ** 0.5
#: Sets of fewer shingles go without bands; buckets of more rows than PAIRED are compared in blocks of about CROSS_ROWS.
SHORT, PAIRED, CROSS_ROWS = 8, 64, 4096
#: A cluster's rows are dealt to so many tasks where they meet what is known of the cluster.
SALTS = 16


def _pi(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """The (len(sets), size) circulant signatures of non-empty sets of 64-bit shingles."""
    out = np.empty((len(sets), size), np.uint32)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= 1 << 16):
            n += len(sets[to])
            to += 1
        part = sets[at:to]
        starts = np.cumsum([0] + [len(p) for p in part[:-1]])
        sigma = (tk.mix(np.concatenate(part) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)
        for k in range(size):
            out[at:to, k] = np.minimum.reduceat(_pi(sigma - np.uint32(k + 1)), starts)
        at = to
    return out


def row_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(from, to, shingle sets of the rows) through a string column."""
    for lo, hi in tk.pieces(column):
        data, offsets = tk.column_bytes(column.slice(lo, hi - lo))
        data = tk.LOWER[data]
        starts, ends, firsts = tk.words(data, offsets)
        yield lo, hi, tk.shingles(tk.word_hashes(data, starts, ends), firsts, n)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, h0 and h1 that name the set, band keys, names with one shingle left out, and the one-bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            for lo, hi, sets in row_sets(batch.column("text"), n):
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes >= SHORT)
                sig = signatures([sets[i] for i in full])
                bands = np.zeros((len(full), BANDS), np.uint64)
                for j in range(BANDS):
                    h = np.full(len(full), np.uint64(j + 1))
                    for c in range(ROWS):
                        h = tk.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, j * ROWS + c])
                    bands[:, j] = h
                bits = np.packbits((sig & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64) if len(full) else np.zeros((0, 2), np.int64)
                own, less = [none] * len(sets), [none] * len(sets)
                sk = np.zeros((len(sets), 2), np.int64)
                for r, i in enumerate(full.tolist()):
                    own[i] = bands[r].view(np.int64)
                    sk[i] = bits[r]
                for i in np.flatnonzero((sizes > 1) & (sizes <= SHORT)).tolist():
                    less[i] = np.array([set_name(np.delete(sets[i], j))[0] for j in range(len(sets[i]))], np.uint64).view(np.int64)
                names = names_of(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(sizes),
                        *[pa.array(names[:, k]) for k in (0, 1)],
                        tk.nested(own, pa.int64()),
                        tk.nested(less, pa.int64()),
                        *[pa.array(sk[:, k]) for k in (0, 1)],
                    ],
                    names=["doc_id", "n_shingles", "h0", "h1", "bands", "less", "s0", "s1"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, h0 long, h1 long, bands array<long>, less array<long>, s0 long, s1 long")


def set_name(items: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that name a set, given as its sorted items."""
    return tuple(np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.uint64))


def names_of(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([set_name(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)


def full_sets(texts: DataFrame, n: int, clash: list[int]) -> DataFrame:
    """h0, the name of each row's set, and its whole shingle set."""
    twice = np.array(clash, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in row_sets(batch.column("text"), n):
                names = names_of(sets)
                h0 = np.where(np.isin(names[:, 0], twice), names[:, 1], names[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(h0), tk.nested([s.view(np.int64) for s in sets], pa.int64())], names=["h0", "items"])

    return texts.select("text").mapInArrow(run, "h0 long, items array<long>")


def named_apart(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """rows, where sets that share h0 but not h1 take h1 for their h0, and those h0: in 10^11 texts some hundred, by chance."""
    clash = rows.where("n_shingles > 0").groupBy("h0").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("h0")
    clash = [r.h0 for r in clash.collect()]
    return (rows.withColumn("h0", F.when(F.col("h0").isin(clash), F.col("h1")).otherwise(F.col("h0"))) if clash else rows), clash


def sets_of(docs: DataFrame, classes: DataFrame, need: DataFrame, n: int, clash: list[int]) -> DataFrame:
    """h0 and the full set of the classes in `need` (h0)."""
    ids = classes.select("h0", F.col("rep").alias("doc_id")).join(need, "h0").select("doc_id").distinct()
    sets = full_sets(docs.join(ids, "doc_id", "left_semi"), n, clash)
    return stash(sets.groupBy("h0").agg(F.first("items").alias("items")), "sets")  # a doc_id may have rows of other sets


def compare(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int, clash: list[int]) -> DataFrame:
    """The pairs (a, b) of classes with linked: 100 * common >= percent * union of the full sets, and close: CLOSE of that."""
    need = pairs.select(F.col("a").alias("h0")).union(pairs.select(F.col("b").alias("h0"))).distinct()
    sets = sets_of(docs, classes, need, n, clash)
    both = pairs.join(sets.select(F.col("h0").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("h0").alias("b"), F.col("items").alias("y")), "b"
    )
    both = both.select("a", "b", F.size("x").alias("p"), F.size("y").alias("q"), F.size(F.array_intersect("x", "y")).alias("c"))
    union = F.col("p") + F.col("q") - F.col("c")
    return stash(both.select("a", "b", (100 * F.col("c") >= percent * union).alias("linked"), (100 * F.col("c") >= CLOSE * percent * union).alias("close")), "pairs")


def cluster_links(docs: DataFrame, classes: DataFrame, placed: DataFrame, n: int, percent: int, clash: list[int]) -> DataFrame:
    """Links (a, b) within clusters, between members of different components; placed: h0, n_shingles, component, cluster."""
    parts = placed.groupBy("cluster", "component").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("items"))
    whole = parts.groupBy("cluster").agg(
        F.max_by("component", F.struct("rows", "component")).alias("core"), F.max(F.struct("rows", "component", "items")).alias("top"), F.sum("rows").alias("rows"), F.sum("items").alias("items"), F.count("*").alias("parts")
    )
    blocks = lambda rows, items: F.greatest(F.ceil(rows / F.lit(BLOCK_ROWS)), F.ceil(items / F.lit(BLOCK_ITEMS)), F.lit(1)).cast("int")
    whole = whole.where("parts > 1").select(
        "cluster", "core", blocks(F.col("top.rows"), F.col("top.items")).alias("core_blocks"), blocks(F.col("rows") - F.col("top.rows"), F.col("items") - F.col("top.items")).alias("rest_blocks")
    )
    whole = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = placed.withColumn("salt", F.pmod(F.xxhash64("h0"), F.lit(SALTS)).cast("int"))
    rows = rows.join(whole, ["cluster", "salt"]).withColumn("rest", F.col("component") != F.col("core"))
    own = F.pmod(F.xxhash64("h0"), F.when(F.col("rest"), F.col("rest_blocks")).otherwise(F.col("core_blocks"))).cast("int")
    rows = rows.withColumn("block", own)
    rows = stash(rows.select("cluster", "h0", "component", "rest", "block", "core_blocks", "rest_blocks"), "blocks")
    sets = sets_of(docs, classes, rows.select("h0"), n, clash)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    core = rows.where("not rest").withColumn("j", upto("rest_blocks")).select("h0", "cluster", "component", F.lit(0).alias("kind"), F.col("block").alias("i"), "j", F.lit(0).alias("side"))
    rest = rows.where("rest")
    against = rest.withColumn("i", upto("core_blocks")).select("h0", "cluster", "component", F.lit(0).alias("kind"), "i", F.col("block").alias("j"), F.lit(1).alias("side"))
    among = rest.withColumn("x", upto("rest_blocks")).select(
        "h0", "cluster", "component", F.lit(1).alias("kind"), F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), (F.col("block") > F.col("x")).cast("int").alias("side")
    )
    tasks = core.union(against).union(among).join(sets, "h0")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        side = group["side"].to_numpy()
        one = bool(group["kind"].iloc[0] == 1 and group["i"].iloc[0] == group["j"].iloc[0])
        left, right = (np.arange(len(group)), np.arange(len(group))) if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        items = [np.asarray(v, np.int64) for v in group["items"]]
        h0, component = group["h0"].to_numpy(), group["component"].to_numpy()
        size = np.array([len(v) for v in items])
        common = overlaps([items[k] for k in left], [items[k] for k in right])
        linked = (100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)) & (component[left][:, None] != component[right][None, :])
        a, b = np.nonzero(linked)
        return pd.DataFrame({"a": h0[left[a]], "b": h0[right[b]]})

    return tasks.groupBy("cluster", "kind", "i", "j").applyInPandas(run, "a long, b long").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many items each set on the left has in common with each on the right, by products of 0/1 matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    marks = []
    for sets in (left, right):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        marks.append((row[hit][order], at[hit][order]))
    for lo in range(0, len(both), 4096):
        parts = []
        for (row, at), sets in zip(marks, (left, right), strict=True):
            a, b = np.searchsorted(at, [lo, lo + 4096])
            m = np.zeros((len(sets), min(4096, len(both) - lo)), np.float32)
            m[row[a:b], at[a:b] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def large_buckets(keys: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different clusters and components in a bucket whose sketches agree enough, found block against block."""
    rows = keys.withColumn("blocks", F.ceil(F.col("n") / F.lit(CROSS_ROWS)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h0"), "blocks").cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", "key", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), (F.col("block") > F.col("x")).alias("right"), "h0", "n_shingles", "s0", "s1", "component", "cluster")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        one = group["i"].iloc[0] == group["j"].iloc[0]
        right = group["right"].to_numpy()
        left, right = (np.arange(len(group)),) * 2 if one else (np.flatnonzero(~right), np.flatnonzero(right))
        x = {c: group[c].to_numpy() for c in ("h0", "n_shingles", "s0", "s1", "component", "cluster")}
        found = [(np.zeros(0, np.int64),) * 2]
        for lo in range(0, len(left), 256):
            p, q = left[lo : lo + 256, None], right[None, :]
            differ = np.bitwise_count(x["s0"][p] ^ x["s0"][q]).astype(np.int16) + np.bitwise_count(x["s1"][p] ^ x["s1"][q])
            fit = 128 - differ >= SKETCH_AGREE
            a, b = np.nonzero(fit)
            a, b = left[lo + a], right[b]
            small, large = np.minimum(x["n_shingles"][a], x["n_shingles"][b]), np.maximum(x["n_shingles"][a], x["n_shingles"][b])
            ok = (x["cluster"][a] != x["cluster"][b]) & (x["component"][a] != x["component"][b]) & (100 * small >= percent * large)
            found.append((x["h0"][a[ok]], x["h0"][b[ok]]))
        a, b = (np.concatenate(z) for z in zip(*found, strict=True))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return rows.groupBy("band", "key", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept.

    `docs` needs doc_id and text; shingles are `words` words long; documents link at similarity percent / 100 or more.
    """
    if percent < 80:
        raise ValueError(f"percent is {percent}; bands and sketches are set for 80 or more and would drop pairs below")
    docs = docs.select("doc_id", "text")
    rows, clash = named_apart(stash(sketches(docs, words), "sketches"))
    known = rows.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("h0").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "less", "s0", "s1")])
    classes = stash(classes, "classes")
    same_id = known.select("doc_id", "h0").groupBy("doc_id").agg(F.min("h0").alias("a"), F.max("h0").alias("z")).where("a <> z")
    same_id = known.select("doc_id", F.col("h0").alias("b")).join(same_id, "doc_id").select("a", "b").distinct()

    keys = classes.select("h0", "n_shingles", F.posexplode("bands").alias("band", "key"))
    # each bucket draws its own leader, so a document meets as many leaders as it has buckets
    drawn = F.struct(F.xxhash64("h0", "band").alias("draw"), "h0", "n_shingles")
    heads = keys.groupBy("band", "key").agg(F.min(drawn).alias("head"), F.count("*").alias("n")).where("n > 1")
    stars = keys.join(heads, ["band", "key"]).where("h0 <> head.h0").where(_sizes("n_shingles", "head.n_shingles", percent))
    inside = classes.select("h0", (F.col("n_shingles") - 1).alias("size"), F.explode("less").alias("inner"))
    inside = inside.join(classes.where(F.col("n_shingles") < SHORT).select(F.col("h0").alias("inner"), F.col("n_shingles").alias("size")), ["inner", "size"])
    stars = stars.select(F.least("head.h0", "h0").alias("a"), F.greatest("head.h0", "h0").alias("b"))
    stars = stars.union(inside.select(F.least("inner", "h0"), F.greatest("inner", "h0")))
    stars = stash(stars.distinct(), "pairs")
    tested = compare(docs, classes, stars, words, percent, clash)
    links = stash(tested.where("linked").select("a", "b").union(same_id), "links")
    found = components(links).withColumnsRenamed({"node": "h0"})
    near = components(tested.where("close").select("a", "b")).withColumnsRenamed({"node": "h0", "component": "cluster"})
    placed = classes.join(found, "h0", "left").join(near, "h0", "left")
    placed = stash(placed.withColumn("component", F.coalesce("component", "h0")).withColumn("cluster", F.coalesce("cluster", "h0")), "placed")
    inner = cluster_links(docs, classes, placed.select("h0", "n_shingles", "component", "cluster"), words, percent, clash)

    keys = placed.select("h0", "n_shingles", "s0", "s1", "component", "cluster", F.posexplode("bands").alias("band", "key"))
    mixed = keys.groupBy("band", "key").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("band", "key", "n")
    keys = stash(keys.join(mixed, ["band", "key"]), "open")
    x, y = keys.where(F.col("n") <= PAIRED).alias("x"), keys.where(F.col("n") <= PAIRED).alias("y")
    agree = 128 - F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) - F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")))
    cross = x.join(
        y,
        (F.col("x.band") == F.col("y.band"))
        & (F.col("x.key") == F.col("y.key"))
        & (F.col("x.h0") < F.col("y.h0"))
        & (F.col("x.cluster") != F.col("y.cluster"))
        & (F.col("x.component") != F.col("y.component"))
        & _sizes("x.n_shingles", "y.n_shingles", percent)
        & (agree >= SKETCH_AGREE),
    ).select(F.col("x.h0").alias("a"), F.col("y.h0").alias("b"))
    cross = cross.union(large_buckets(keys.where(F.col("n") > PAIRED), percent))
    cross = stash(cross.distinct().join(stars, ["a", "b"], "left_anti"), "pairs")
    outer = compare(docs, classes, cross, words, percent, clash).where("linked").select("a", "b")
    more = stash(inner.union(outer), "links")
    if not more.isEmpty():
        found = components(links.union(more)).withColumnsRenamed({"node": "h0"})

    labelled = classes.select("h0", "rep").join(found, "h0", "left").select("h0", "rep", F.coalesce("component", "h0").alias("component"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = labelled.join(least, "component").select("h0", "component_id")
    out = rows.join(of_class, "h0", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sizes(p: str, q: str, percent: int):
    """Two sets of such sizes can reach the similarity."""
    return (100 * F.least(p, q)) >= (percent * F.greatest(p, q))


def drop_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents of a group beyond its smallest doc_id; of repeated rows of that id one stays.

    Only the ids that go are joined; rows of null doc_id stay.
    """
    found = stash(near_duplicates(docs, words, percent), "near")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1")
    if twice.isEmpty():
        return rest
    again = rest.join(twice.select("doc_id"), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return rest.join(twice.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).unionByName(again)
