"""Scenarios from branch rows, their mocks and status, and how testable a member is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constructs that branch, and review states that let an overlay's status count.
BRANCHES = r"^(?:IF.*|ELSE|WHEN|CASE|ON ERROR|AT BREAK.*)$"
PROMOTED = ("in_review", "sme_approved", "signed_off")
STATUSES = ("characterization", "confirmed", "rejected")
INTERNAL = ("INCLUDE", "PERFORM_INTERNAL")


def scenarios(rules: DataFrame, member: str, order: list[str], construct: str, condition: str) -> DataFrame:
    """One scenario a branch row: its id over all rules of the member, and given, when and then."""
    w = Window.partitionBy(member).orderBy(*order)
    out = rules.withColumn("_n", F.row_number().over(w)).where(F.upper(construct).rlike(BRANCHES))
    name = F.format_string("%s:BR-%03d", F.col(member).cast("string"), F.col("_n"))
    return out.select(
        member, name.alias("scenario"), F.col(construct).alias("construct"),
        F.struct(F.col(condition).alias("condition")).alias("given"), F.struct(F.col(member).cast("string").alias("calls")).alias("when"), F.struct(F.lit(None).cast("string").alias("expects")).alias("then"),
    )


def mock_targets(accesses: DataFrame, calls: DataFrame, member: str, entity: str, callee: str, kind: str) -> DataFrame:
    """member with the entities and callees to stand in for, sorted and joined."""
    e = accesses.where(F.col(entity).isNotNull()).select(member, F.lit("e").alias("_k"), F.col(entity).cast("string").alias("_t"))
    c = calls.where(~F.col(kind).isin(*INTERNAL)).select(member, F.lit("c").alias("_k"), F.col(callee).cast("string").alias("_t"))
    pick = lambda k: F.array_join(F.array_sort(F.collect_set(F.when(F.col("_k") == k, F.col("_t")))), ",")
    return e.unionByName(c).groupBy(member).agg(pick("e").alias("entities"), pick("c").alias("callees"))


def overlay_status(cases: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """cases with the overlay's status where it is promoted and known, else characterization."""
    out = cases.join(overlay.select(key, "review_status", F.col("status").alias("_s")), key, "left")
    fine = F.col("review_status").isin(*PROMOTED) & F.col("_s").isin(*STATUSES)
    return out.withColumn("status", F.when(fine, F.col("_s")).otherwise("characterization")).drop("_s", "review_status")


def merge_overlay(current: DataFrame, drafts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Drafts join the overlay, and replace entries that nobody has promoted."""
    c = current.select(key, *[F.col(x).alias(f"_c_{x}") for x in columns], F.lit(True).alias("_in"))
    d = drafts.select(key, *[F.col(x).alias(f"_d_{x}") for x in columns], F.lit(True).alias("_new"))
    both = c.join(d, key, "full_outer")
    keep = F.col("_in").isNotNull() & (F.coalesce(F.col("_c_review_status").isin(*PROMOTED), F.lit(False)) | F.col("_new").isNull())
    return both.select(key, *[F.when(keep, F.col(f"_c_{x}")).otherwise(F.col(f"_d_{x}")).alias(x) for x in columns])


def classify(members: DataFrame, dynamic: Column, unresolved: Column, most_entities: Column, targets: Column) -> DataFrame:
    """members with testability: a gap outweighs a scope of several entities, which outweighs a need for mocks."""
    kind = F.when(dynamic | unresolved, "untestable-gap").when(most_entities > 1, "integration-only").when(targets > 0, "needs-mock").otherwise("pure")
    return members.withColumn("testability", kind)


def seams(calls: DataFrame, member: str, target: str, line: str, dynamic: str) -> DataFrame:
    """The first call of each distinct target of a member; dynamic calls are no seams."""
    known = calls.where(~F.col(dynamic))
    return known.groupBy(member, target).agg(F.min(line).alias("first_line"))


def gap_text(target: Column, dynamic: Column, resolved: Column) -> Column:
    return F.when(dynamic, F.format_string("target %s is set at run time", target)).when(~resolved, F.format_string("%s has no source here", target))
