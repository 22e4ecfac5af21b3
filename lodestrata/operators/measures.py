"""Aggregates over facts: access matrix, coverage metrics, quality gates, histograms, rates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(column: str | Column) -> Column:
    """The distinct values, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def crud_matrix(accesses: DataFrame, member: str, entity: str, crud: str, verb: str, line: str) -> DataFrame:
    """member x entity: the crud letters, verbs, hits and first line."""
    return accesses.groupBy(member, entity).agg(listed(crud).alias("crud"), listed(verb).alias("verbs"), F.count("*").alias("hits"), F.min(line).alias("first_line"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def coverage(frames: Mapping[str, tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """One row of all metrics: each frame is aggregated once, and the single rows are put side by side."""
    out = None
    for frame, metrics in frames.values():
        row = frame.agg(*[c.alias(name) for name, c in metrics.items()])
        out = row if out is None else out.join(row, how="cross")  # one row each
    return out


def as_rows(metrics: DataFrame) -> DataFrame:
    """(metric, value) of a one-row frame."""
    names = metrics.columns
    pairs = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    return metrics.select(F.expr(f"stack({len(names)}, {pairs}) as (metric, value)"))


def gate(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """metric, kind (min or max), threshold, value, passed, shortfall for each configured rule; a missing metric counts as 0."""
    wanted = metrics.sparkSession.createDataFrame(rules, "metric string, kind string, threshold double")
    out = wanted.join(metrics, "metric", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    passed = F.when(F.col("kind") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    short = F.when(F.col("kind") == "min", F.col("threshold") - F.col("value")).otherwise(F.col("value") - F.col("threshold"))
    return out.withColumn("passed", passed).withColumn("shortfall", F.greatest(short, F.lit(0.0)))


def histogram(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


SEVERITY = {"high": 0, "medium": 1, "low": 2}


def by_severity(severity: str = "severity") -> Column:
    """Rank of a severity, the highest first."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col(severity)), F.lit(len(SEVERITY)))


def calibrate(lines: DataFrame, text: str, order: list[str], top: int = 30) -> DataFrame:
    """The commonest first tokens of lines, with the first line that has each; ties by token."""
    token = F.regexp_extract(text, r"(?U)^[\s\x1c-\x1f]*([^\s\x1c-\x1f]+)", 1)
    rows = lines.withColumn("_token", F.upper(token)).where("_token <> ''")
    out = rows.groupBy(F.col("_token").alias("token")).agg(F.count("*").alias("n"), F.min_by(text, F.struct(*order)).alias("sample"))
    return out.orderBy(F.desc("n"), "token").limit(top)


def agreement(left: DataFrame, right: DataFrame, key: str, verdict: str) -> DataFrame:
    """One row: pairs judged by both, and the share that agrees (null when there is none)."""
    both = left.select(key, F.col(verdict).alias("_l")).join(right.select(key, F.col(verdict).alias("_r")), key)
    return both.agg(F.count("*").alias("pairs"), F.avg((F.col("_l") == F.col("_r")).cast("double")).alias("agreement"))


def batch_cost(results: DataFrame, price_in: float | None, price_out: float | None, tokens_in: str, tokens_out: str, status: str) -> DataFrame:
    """Totals by status and the cost, null unless both prices are known."""
    cost = F.sum(F.col(tokens_in) * F.lit(price_in) / 1e6 + F.col(tokens_out) * F.lit(price_out) / 1e6) if price_in is not None and price_out is not None else F.lit(None).cast("double")
    return results.groupBy(status).agg(F.count("*").alias("n"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"), cost.alias("cost"))
