"""Helpers the operators share: tables in the cluster's shared folder, connected components, global order."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder they share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a URI in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; the folder goes with the cluster's clean-up
            return


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again, so that a lost executor costs no recount."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds, each a grouped minimum and an equi-join, until no link moves; the
    number of rounds grows with the logarithm of the longest chain. No link leaves the executors.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = stash(links, "links")
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = stash(small.where("a <> b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def in_order(df: DataFrame, group: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """Each row with its 1-based `position` in its group by `order` and, as prev_* and next_*, its neighbours' `carry`.

    A window over the group would sort a hot group in one task. Here the rows are range-partitioned by (group, order),
    numbered within each range, and the ranges are stitched by one edge row for each end of a range: data as small as
    the number of partitions. Rows equal in all of `order` need a tie-break in `order` to get a defined place.
    """
    keys = [*group, *order]
    parts = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("_part", F.spark_partition_id())
    parts = stash(parts, "ordered")
    within = Window.partitionBy("_part", *group).orderBy(*[F.col(k).asc_nulls_first() for k in order])
    packed = F.struct(*carry)
    rows = (
        parts.withColumn("_n", F.row_number().over(within))
        .withColumn("_prev", F.lag(packed).over(within))
        .withColumn("_next", F.lead(packed).over(within))
    )
    # one row for each (range, group) that touches an end of its range: at most two groups a range can be split
    spans = parts.groupBy("_part", *group).agg(
        F.count("*").alias("_size"),
        F.min(F.struct(*[F.col(o) for o in order], packed.alias("_c"))).getField("_c").alias("_first"),
        F.max(F.struct(*[F.col(o) for o in order], packed.alias("_c"))).getField("_c").alias("_last"),
    )
    ends = Window.partitionBy(*group).orderBy("_part")
    split = spans.withColumn("_ranges", F.count("*").over(Window.partitionBy(*group))).where("_ranges > 1")
    split = (
        split.withColumn("_before", F.coalesce(F.sum("_size").over(ends.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_at_prev", F.lag("_last").over(ends))
        .withColumn("_at_next", F.lead("_first").over(ends))
        .select("_part", *[F.col(g).alias(f"_g_{g}") for g in group], "_size", "_before", "_at_prev", "_at_next")
    )
    on: Column = rows["_part"] == split["_part"]
    for g in group:
        on = on & rows[g].eqNullSafe(split[f"_g_{g}"])
    out = rows.join(split.drop("x"), on, "left").drop(split["_part"])
    prev = F.when(F.col("_n") == 1, F.col("_at_prev")).otherwise(F.col("_prev"))
    nxt = F.when(F.col("_n") == F.col("_size"), F.col("_at_next")).otherwise(F.col("_next"))
    out = out.withColumn("_prev", prev).withColumn("_next", nxt)
    return out.select(
        *df.columns,
        (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("long").alias("position"),
        *[F.col("_prev").getField(c).alias(f"prev_{c}") for c in carry],
        *[F.col("_next").getField(c).alias(f"next_{c}") for c in carry],
    )


def carried(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: the last non-null `value` up to each row, itself included, in its group by `order`.

    As in in_order(), a hot group is spread over ranges, and what the ranges before hold comes from one row a range.
    """
    keys = [F.col(k).asc_nulls_first() for k in [*group, *order]]
    parts = stash(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "carried")
    within = Window.partitionBy("_part", *group).orderBy(*[F.col(k).asc_nulls_first() for k in order]).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn(name, F.last(value, ignorenulls=True).over(within))
    spans = parts.groupBy("_part", *group).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    spans = spans.withColumn("_ranges", F.count("*").over(Window.partitionBy(*group))).where("_ranges > 1")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_part", *[F.col(g).alias(f"_g_{g}") for g in group], F.last("_last", ignorenulls=True).over(before).alias("_before"))
    on: Column = rows["_part"] == spans["_part"]
    for g in group:
        on = on & rows[g].eqNullSafe(spans[f"_g_{g}"])
    out = rows.join(spans, on, "left").withColumn(name, F.coalesce(name, "_before"))
    return out.select(*df.columns, name)
