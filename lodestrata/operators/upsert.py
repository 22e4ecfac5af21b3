"""Keyed merges: later non-null values win; set semantics for everything derived."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(rows: DataFrame, key: list[str], sequence: str, columns: list[str], keep_first: list[str] = ()) -> DataFrame:
    """One row a key: each column's last non-null value by `sequence`, or its first for those in keep_first. Null keys equal ''."""
    keys = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in key]
    pick = lambda c: (F.min_by if c in keep_first else F.max_by)(c, F.when(F.col(c).isNotNull(), F.col(sequence)))
    return rows.groupBy(*keys).agg(*[pick(c).alias(c) for c in columns])


def last_writer(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The rows that win their key: first by `order`."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_unseen(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """state with those rows of new whose key it lacks."""
    return state.unionByName(new.join(state.select(key), key, "left_anti"))


def purge(facts: DataFrame, gone: DataFrame, owner: str, references: list[str] = ()) -> DataFrame:
    """facts without those owned by a member that is gone; references to such members become null."""
    g = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
    out = facts.join(g, facts[owner] == g["_gone"], "left_anti")
    for c in references:
        hit = g.select(F.col("_gone").alias(f"_{c}"))
        out = out.join(hit, out[c] == hit[f"_{c}"], "left").withColumn(c, F.when(F.col(f"_{c}").isNull(), F.col(c))).drop(f"_{c}")
    return out
