"""Sharding by size-tiered compaction, in DataFrame operations only.

A shard set is a folder with immutable runs and versioned manifests. append() writes arrivals as a run of small shards and
commits a manifest that lists it. compact() takes runs of like size (each within a factor of SIMILAR of the group's mean,
or all of under SMALL bytes), and where at least FAN_IN are alike merges the oldest FAN_IN into one run of shards of about
`target` bytes; it repeats until no group is full, so every row is rewritten a number of times that grows with the
logarithm of the set. A manifest is written aside and then published under its version's name by a step that fails if the
name is taken (a hard link on a local file system, FileContext's rename without overwrite elsewhere, which HDFS does in one
step): of two writers of a version one commits and the other starts again, and readers see one whole version or another. A
store whose rename is not one step (plain object stores) allows one writer at a time. Runs that no manifest of the last KEEP
versions lists are removed after a commit.

Which shard of a run a row goes to is a hash of its id and text: even in size whatever the ids, the source or the copies
are, and the same on a retry; each shard is written by a task of its own. Sizes are bytes of text. A row is stored as one
struct, so columns of any name and type are kept; null ids and texts and repeated rows are rows like others; an empty
arrival commits nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.shared import hadoop_path, new_folder

TARGET = 256 << 20
FAN_IN, SIMILAR, SMALL, KEEP, ARRIVALS = 4, 2.0, 1 << 20, 2, 8


@dataclass
class Run:
    """An immutable group of shards: its folder, the version it (or its oldest part) came with, its bytes, rows of each shard."""

    name: str
    born: int
    tier: int
    size: int
    rows: list[int] = field(default_factory=list)


class Conflict(Exception):
    """Another writer has committed this version."""


def row_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shard_of(shards: int, key: str = "doc_id", text: str = "text") -> Column:
    """The shard of a row among so many: a hash of id and text, the same in any engine."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(shards)).cast("int")


class ShardSet:
    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET):
        self.spark, self.folder, self.target = spark, folder.rstrip("/"), target

    # manifests

    def version(self) -> int:
        fs, p = hadoop_path(self.spark, f"{self.folder}/manifests")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if not version:
            return []
        fs, p = hadoop_path(self.spark, f"{self.folder}/manifests/v{version:08d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, runs: list[Run], version: int) -> None:
        """Make `runs` the set's content as `version`, or raise Conflict if that version is there."""
        fs, aside = hadoop_path(self.spark, f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        _, final = hadoop_path(self.spark, f"{self.folder}/manifests/v{version:08d}.json")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps({"version": version, "runs": [asdict(r) for r in runs]}).encode()))
        stream.close()
        if not self.publish(fs, aside, final):
            fs.delete(aside, False)
            raise Conflict(version)
        self.sweep(version)

    def publish(self, fs, aside, final) -> bool:
        """Give the file its final name, unless there is one of that name."""
        jvm = self.spark._jvm
        try:
            if fs.getUri().getScheme() == "file":
                local = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
                jvm.java.nio.file.Files.createLink(local(final), local(aside))
                fs.delete(aside, False)
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, none)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def sweep(self, version: int) -> None:
        """Remove runs that none of the last KEEP versions lists."""
        live = {r.name for v in range(max(1, version - KEEP + 1), version + 1) for r in self.runs(v)}
        old = {r.name for r in self.runs(version - KEEP)} if version > KEEP else set()
        for name in old - live:
            fs, p = hadoop_path(self.spark, f"{self.folder}/runs/{name}")
            fs.delete(p, True)

    # data

    def write(self, rows: DataFrame, size: int, tier: int, born: int) -> Run:
        """One run of rows (row, _shard): one file for each shard and task."""
        run = Run(f"run-{uuid.uuid4().hex}", born, tier, size)
        path = f"{self.folder}/runs/{run.name}"
        rows.write.partitionBy("_shard").parquet(path)
        run.rows = [r["count"] for r in self.spark.read.parquet(path).groupBy("_shard").count().orderBy("_shard").collect()]
        return run

    def append(self, rows: DataFrame, size: int | None = None) -> None:
        """Commit arrivals, unmoved: each task's rows are a small shard. `size` is their bytes, if known."""
        size = rows.agg(F.sum(row_bytes())).first()[0] if size is None else size
        if size is not None:
            self.add(self.write(packed(rows).withColumn("_shard", F.spark_partition_id()), size, 0, 0))

    def arrive(self, rows: DataFrame, arrival: Column) -> Iterator[None]:
        """Commit rows as one run for each value of `arrival`, from the least on: one pass writes them all."""
        rows = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), row_bytes().alias("_n"), arrival.alias("_arrival"))
        name = f"run-{uuid.uuid4().hex}"
        path = f"{self.folder}/runs/{name}"
        rows.withColumn("_shard", F.spark_partition_id()).write.partitionBy("_arrival", "_shard").parquet(path)
        if rows.isEmpty():
            return
        found = self.spark.read.parquet(path).groupBy("_arrival", "_shard").agg(F.count("*").alias("rows"), F.sum("_n").alias("size"))
        runs: dict[int, Run] = {}
        for r in found.orderBy("_arrival", "_shard").collect():  # a row for each task and arrival
            run = runs.setdefault(r["_arrival"], Run(f"{name}/_arrival={r['_arrival']}", 0, 0, 0))
            run.rows.append(r["rows"])
            run.size += r["size"]
        for k in sorted(runs):
            self.add(runs[k])
            yield

    def add(self, run: Run) -> None:
        while True:
            version = self.version()
            run.born = version + 1
            try:
                return self.commit([*self.runs(version), run], version + 1)
            except Conflict:
                continue  # the shards stay as they are; only the manifest is made anew

    def full_group(self, runs: list[Run]) -> list[Run]:
        """The FAN_IN oldest of the first group of like size that has so many, smallest sizes first."""
        groups: list[list[Run]] = []
        for r in sorted(runs, key=lambda r: (r.size, r.born)):
            for g in groups:
                mean = sum(x.size for x in g) / len(g)
                if max(r.size, mean) <= SMALL or mean / SIMILAR <= r.size <= mean * SIMILAR:
                    g.append(r)
                    break
            else:
                groups.append([r])
        return next((sorted(g, key=lambda r: r.born)[:FAN_IN] for g in groups if len(g) >= FAN_IN), [])

    def compact(self) -> None:
        while True:
            version = self.version()
            runs = self.runs(version)
            group = self.full_group(runs)
            if not group:
                return
            size = sum(r.size for r in group)
            names = {r.name for r in group}
            shards = max(1, -(-size // self.target))
            rows = self.rows_of(group).select("row", shard_of(shards, "row.doc_id", "row.text").alias("_shard")).repartitionById(shards, "_shard")
            merged = self.write(rows, size, 1 + max(r.tier for r in group), min(r.born for r in group))
            while True:
                try:
                    self.commit([r for r in runs if r.name not in names] + [merged], version + 1)
                    break
                except Conflict:
                    version = self.version()
                    runs = self.runs(version)
                    if not names <= {r.name for r in runs}:
                        break  # another writer has merged some of these

    def rows_of(self, runs: list[Run]) -> DataFrame:
        """(row, _run, _shard) of these runs, numbered from the oldest on, from 0."""
        out = None
        for k, r in enumerate(sorted(runs, key=lambda r: r.born)):
            part = self.spark.read.parquet(f"{self.folder}/runs/{r.name}").select("row", F.lit(k).alias("_run"), "_shard")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame | None:
        """All rows of the last version as they came; None for an empty set."""
        runs = self.runs()
        return self.rows_of(runs).select("row.*") if runs else None


def packed(rows: DataFrame) -> DataFrame:
    """(row): all columns as one struct."""
    return rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"))


def shard(docs: DataFrame, arrivals: int = ARRIVALS, target: int = TARGET) -> ShardSet:
    """Commit docs in so many arrivals (by a hash of the id), compacting after each."""
    out = ShardSet(docs.sparkSession, new_folder(docs.sparkSession, "shards"), target)
    for _ in out.arrive(docs, arrival_of(arrivals)):
        out.compact()
    return out


def arrival_of(arrivals: int, key: str = "doc_id") -> Column:
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(arrivals)).cast("int")


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, arrival, n_bytes, text_md5, run, shard of each row, read from the shards after the last commit."""
    store = shard(docs)
    runs = store.runs()
    rows = store.rows_of(runs) if runs else packed(docs).withColumns({"_run": F.lit(0), "_shard": F.lit(0)})
    rows = rows.select("row.doc_id", "row.text", "_run", "_shard")
    return rows.select(
        "doc_id", arrival_of(ARRIVALS).alias("arrival"), row_bytes().alias("n_bytes"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), F.col("_run").cast("int").alias("run"), F.col("_shard").cast("int").alias("shard")
    )


#: With arrivals of like size, every FAN_IN of them make one run; its shards follow from its bytes.
ORACLE = f"""
with d as (
  select doc_id, coalesce(text, '') as text, strlen(coalesce(text, ''))::bigint as n_bytes,
         (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::ubigint % {ARRIVALS})::int as arrival
  from documents),
r as (select *, (arrival // {FAN_IN})::int as run from d),
s as (select *, greatest(1, ceil(sum(n_bytes) over (partition by run) / {TARGET}.0))::ubigint as shards from r)
select doc_id, arrival, n_bytes, md5(text) as text_md5, run,
       (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || text), 1, 8))::ubigint % shards)::int as shard
from s
"""
