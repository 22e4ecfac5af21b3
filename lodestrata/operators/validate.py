"""Checking documents against facts: citations, logical units, uncited assertions, scenario references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import CITATION

#: How an assertion begins, and the words that make a sentence a hedge.
OPENERS = r"(?i)^(?:the|this|it|when|if|each|all|every|a|an)\s+\S+"
HEDGES = r"(?i)\b(?:unknown|unclear|not determined|to be confirmed|assumption|open question|sme)\b"


def check_citations(claims: DataFrame, lines: DataFrame, members: DataFrame, name: str = "name", member: str = "member", line_no: str = "line_no") -> DataFrame:
    """claims (member, from_line, to_line) with valid, note and range_reversed.

    members has one row a member; lines gives each member's last line, summed up before the join.
    """
    last = lines.groupBy(F.upper(member).alias("_u")).agg(F.max(line_no).alias("last_line"))
    holders = members.groupBy(F.upper(name).alias("_v")).agg(F.count("*").alias("holders"))
    out = claims.join(holders, F.upper(claims["member"]) == holders["_v"], "left").join(last, F.upper(claims["member"]) == last["_u"], "left")
    low, high = F.least("from_line", "to_line"), F.greatest("from_line", "to_line")
    note = (
        F.when(F.col("holders").isNull(), "unknown member")
        .when(F.col("holders") > 1, "ambiguous")
        .when(F.col("from_line").isNotNull() & ((high > F.coalesce("last_line", F.lit(0))) | (low < 1)), "out of range")
    )
    out = out.withColumn("note", note).withColumn("valid", F.col("note").isNull())
    return out.withColumn("range_reversed", F.coalesce(F.col("from_line") > F.col("to_line"), F.lit(False))).drop("_u", "_v", "holders")


def logical_units(text: Column) -> Column:
    """List items and sentences of a markdown body; fenced code, tables, quotes and headings are left out."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?ms)^```.*?^```[ \t]*$", "")
    kept = F.filter(F.split(plain, "\n"), lambda x: ~x.rlike(r"^\s*(?:[|>#]|$)"))
    joined = F.array_join(F.transform(kept, lambda x: F.regexp_replace(F.trim(x), r"^(?:[-*+]|[0-9]+[.)])\s+", "\u0001")), " ")
    return F.filter(F.transform(F.split(joined, "\u0001|(?<=[.!?])\\s+(?=[A-Z\\[])"), lambda x: F.trim(x)), lambda x: x != "")


def uncited(units: Column) -> Column:
    """Units that assert and neither cite nor hedge, cut to 140 characters for the report."""
    bad = F.filter(units, lambda u: u.rlike(OPENERS) & ~u.rlike(CITATION) & ~u.rlike(HEDGES))
    return F.transform(bad, lambda u: F.substring(u, 1, 140))


def front_matter(text: Column, required: list[str]) -> tuple[Column, Column]:
    """(keys, missing required keys) of a leading --- block."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    keys = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][A-Za-z0-9_]*)\s*:"), F.lit(1))
    return keys, F.filter(F.array(*[F.lit(r) for r in required]), lambda r: ~F.array_contains(keys, r))


def scenario_refs(text: Column) -> Column:
    """Scenario ids MEMBER:BR-n that no name character precedes."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9#@$_-])([A-Za-z0-9#@$_-]+:BR-[0-9]+)"), F.lit(1)))


def rollup(results: DataFrame) -> DataFrame:
    """One row of documents, valid documents, citations and bad citations, from (doc, valid) rows."""
    by_doc = results.groupBy("doc").agg(F.count("*").alias("c"), F.sum((~F.col("valid")).cast("long")).alias("bad"))
    return by_doc.agg(F.count("*").alias("documents"), F.sum((F.col("bad") == 0).cast("long")).alias("ok"), F.sum("c").alias("citations"), F.sum("bad").alias("bad"))
