"""Content-hash incremental processing, in batch and as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed(current: DataFrame, previous: DataFrame, path: str, sha: str) -> DataFrame:
    """Rows of current that are new or whose hash differs."""
    return current.join(previous.select(path, sha), [path, sha], "left_anti")


def removed(current: DataFrame, previous: DataFrame, path: str) -> DataFrame:
    """Rows of previous whose path is gone."""
    return previous.join(current.select(path), path, "left_anti")


def plan(current: DataFrame, previous: DataFrame, path: str, sha: str) -> DataFrame:
    """path and action for every path of either side: add, change, keep or remove."""
    a, b = current.select(path, F.col(sha).alias("_a")), previous.select(path, F.col(sha).alias("_b"))
    both = a.join(b, path, "full_outer")
    action = F.when(F.col("_b").isNull(), "add").when(F.col("_a").isNull(), "remove").when(F.col("_a") == F.col("_b"), "keep").otherwise("change")
    return both.select(path, action.alias("action"))


def two_tier(members: DataFrame, state: DataFrame, key: str, brief_hash: str, signature: str) -> DataFrame:
    """members with reason to do the costly work: all if the corpus signature changed, else those whose brief changed or is new."""
    s = state.select(key, F.col(brief_hash).alias("_old"), F.col("signature").alias("_sig"))
    out = members.join(s, key, "left")
    why = F.when(F.col("_sig").isNull(), "new").when(F.col("_sig") != F.lit(signature), "corpus").when(F.col("_old") != F.col(brief_hash), "brief").otherwise("skip")
    return out.withColumn("reason", why).drop("_old", "_sig")


def stream(files: DataFrame, state: Callable[[], DataFrame], work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run `work` on each micro-batch's changed rows; `state` gives the hashes stored so far."""

    def each(batch: DataFrame, number: int) -> None:
        work(changed(batch.dropDuplicates(["path"]), state(), "path", "sha256"), number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
