"""Exact top-k inner products by norm-bucketed retrieval.

Components become integers floor(64 * x). The queries travel in blocks of a fixed size (a broadcast bounded by
QUERY_BLOCK vectors, whatever the data, written, searched and freed one by one); the candidates stay where they are. The
SEEDS longest vectors, broadcast once, give each query a threshold on the executors: its k-th best score so far. In every
task the vectors are sorted by length and cut into
buckets of like length. For a bucket of longest length l a query q needs a cosine of at least threshold / (|q| l):

* over 1: the bucket is skipped for q;
* from COSINE on: coordinate pruning. By Cauchy-Schwarz on the other coordinates, a vector of that cosine has its
  coordinate along q's largest one in a known interval; those outside are dropped;
* below COSINE: length pruning. Vectors shorter than threshold / |q| are dropped.

The rest is verified by exact products, and thresholds rise as buckets are done. Each task returns at most k rows a
query, all at or above the query's first threshold; a grouped top-k joins them.

Vectors that are null or hold null or non-finite components take no part; vectors of other lengths count as filled up
with zeros. A query's own row is the candidate of the same vec_id; rows of null vec_id take no part. Ties go to the
smaller vec_id; repeated rows of another id are repeated candidates, and an id with several vectors asks with the least.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import stash

K, SEEDS, QUERY_BLOCK, BUCKET, RATIO, COSINE = 20, 4096, 32_768, 4096, 0.9, 0.6


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of long) and n2 (squared length, double) of the vectors that take part."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.where(F.col("vec_id").isNotNull() & fine)
    out = out.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double"))).alias("v"))
    return out.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    row = np.repeat(np.arange(len(vectors)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Queries:
    """A block of queries with the best k scores so far, of which `floor` must be reached."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        self.real = vectors.astype(np.float64)
        self.norm = np.sqrt((self.real**2).sum(1))
        self.floor = np.full(len(ids), -np.inf)
        self.most = float(np.abs(self.real).max(initial=0))

    def product(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact scores of queries q and vectors x: in doubles while those hold every sum exactly."""
        if self.most * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) < 2**53:
            return (self.real[q] @ x.T.astype(np.float64)).astype(np.int64)
        return self.v[q] @ x.T

    def scan(self, ids: np.ndarray, x: np.ndarray, best: "Best") -> None:
        """Search one set of vectors, longest first, raising `best` and using its thresholds."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norm, kind="stable")
        ids, x, norm = ids[order], x[order], norm[order]
        at = 0
        while at < len(ids):
            to = min(len(ids), at + BUCKET, max(at + 1, int(np.searchsorted(-norm, -norm[at] * RATIO, "right"))))
            self.bucket(ids[at:to], x[at:to], norm[at:to], best)
            at = to

    def bucket(self, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, best: "Best") -> None:
        top = norm[0]
        need = np.maximum(best.threshold(), self.floor)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.norm * top > 0, need / (self.norm * top), np.where(need > 0, 2.0, -1.0))
        alive = cosine <= 1 + 1e-9
        by_coordinate = alive & (cosine >= COSINE)
        by_length = np.flatnonzero(alive & ~by_coordinate)
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(self.norm[by_length] > 0, need[by_length] / self.norm[by_length], -1).min()
            n = int(np.searchsorted(-norm, -(least - 1e-9 * abs(least)), "right")) if least > 0 else len(ids)
            for k in range(0, len(by_length), 512):
                part = by_length[k : k + 512]
                scores = self.product(part, x[:n])
                q, c = np.nonzero(scores >= need[part][:, None])
                best.add(part[q], ids[c], scores[q, c], self.ids)
        if by_coordinate.any():
            unit = x / np.maximum(norm, 1e-300)[:, None]
            found = []
            for q in np.flatnonzero(by_coordinate).tolist():
                u = self.real[q] / self.norm[q]
                f = int(np.abs(u).argmax())
                t = min(1.0, cosine[q])
                spread = np.sqrt(max(0.0, 1 - u[f] ** 2) * max(0.0, 1 - t * t)) + 1e-9
                lo = u[f] * t - spread if u[f] > 0 else -1 - 1e-9
                hi = u[f] * t + spread if u[f] < 0 else 1 + 1e-9
                c = np.flatnonzero((unit[:, f] >= lo) & (unit[:, f] <= hi))
                if len(c):
                    scores = self.product(np.array([q]), x[c])[0]
                    hit = scores >= need[q]
                    found.append((np.full(int(hit.sum()), q), ids[c[hit]], scores[hit]))
            if found:
                best.add(*[np.concatenate(p) for p in zip(*found, strict=True)], self.ids)


class Best:
    """The best k (score, smaller id first) of each query among what was added."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.rows = [np.zeros(0, np.int64)] * 3

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        other = own[q] != ids
        q, ids, scores = (np.concatenate([a, b[other]]) for a, b in zip(self.rows, (q, ids, scores), strict=True))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.rows = [a[rank < self.k] for a in (q, ids, scores)]

    def threshold(self) -> np.ndarray:
        """The k-th best score of each query, minus infinity where there are fewer."""
        out = np.full(self.n, -np.inf)
        q, _, scores = self.rows
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        out[q[last]] = scores[last]
        return out


def search(vectors: DataFrame, queries_where: str = "vec_id % 20 = 0", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates among all other rows."""
    context = vectors.sparkSession.sparkContext
    rows = stash(integers(vectors), "vectors")
    width = int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    asked = rows.where(queries_where).groupBy("vec_id").agg(F.min("v").alias("v"))
    first = rows.orderBy(F.desc("n2"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
    seeds = context.broadcast((first["vec_id"].to_numpy(), matrix(first["v"], width)))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = seeds.value
        for batch in batches:
            q = Queries(batch["vec_id"].to_numpy(), matrix(batch["v"], width), k)
            best = Best(len(q.ids), k)
            if len(q.ids):
                q.scan(ids, v, best)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(best.threshold())], names=["vec_id", "v", "floor"])

    asked = stash(asked.mapInArrow(thresholds, "vec_id long, v array<long>, floor double"), "asked")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        shipped = context.broadcast((block["vec_id"].to_numpy(), matrix(block["v"], width), block["floor"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, v, floor = shipped.value
            q = Queries(ids, v, k)
            q.floor = floor
            best = Best(len(ids), k)
            for batch in batches:
                if batch.num_rows and len(ids):
                    q.scan(batch["vec_id"].to_numpy(), matrix(batch["v"], width), best)
            n, vec, score = best.rows
            yield pa.RecordBatch.from_arrays([pa.array(ids[n]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

        part = rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
        found.append(stash(part, "found"))
        shipped.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v)::bigint as score
  from rows q join rows c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored
qualify rank <= 20
"""
