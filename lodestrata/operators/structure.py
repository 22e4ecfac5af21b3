"""Order within a member: numbering, nesting, branch bodies, header comments, ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_ids(rules: DataFrame, member: str, order: list[str]) -> DataFrame:
    """rules with rule_id MEMBER:BR-nnn, numbered from 1 in the member; the number is padded to 3 digits and never cut."""
    w = Window.partitionBy(member).orderBy(*order)
    return rules.withColumn("rule_id", F.format_string("%s:BR-%03d", F.col(member).cast("string"), F.row_number().over(w)))


def nesting(rows: DataFrame, member: str, order: list[str], step: str) -> DataFrame:
    """rows with depth before each row, where step is +1, -1 or 0 and a close at depth 0 has no effect.

    The floor at zero has a closed form over prefix sums S: S(i) - min(0, least S up to i). Two window sums, no state.
    """
    w = Window.partitionBy(member).orderBy(*order)
    out = rows.withColumn("_s", F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    low = F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("depth", (F.col("_s") - F.least(low, F.lit(0))).cast("long")).drop("_s")


def branch_ends(rules: DataFrame, member: str, ordinal: str, depth: str, header: str) -> DataFrame:
    """Header rows with body_end: the ordinal before the first later row that is shallower, or a header at the same depth.

    Null where the body runs to the member's end. Members are read backwards in order, and a stack holds only the rows
    that can still end a body, so the work is linear in a member and the state is as deep as its nesting.
    """
    rows = rules.select(member, F.col(ordinal).cast("long").alias(ordinal), F.col(depth).cast("long").alias(depth), header)
    rows = rows.repartition(member).sortWithinPartitions(member, F.desc(ordinal))
    kind = dict(rows.dtypes)[member]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no member yet
        stack: list[tuple[int, int]] = []  # (least depth that the row ends, ordinal), the nearest last
        for batch in batches:
            out = []
            for m, o, d, h in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if m != now:
                    now, stack = m, []
                if h:
                    while stack and stack[-1][0] > d:
                        stack.pop()
                    out.append((m, o, d, stack[-1][1] - 1 if stack else None))
                ends = d if h else d + 1
                while stack and stack[-1][0] >= ends:
                    stack.pop()
                stack.append((ends, o))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], batch.schema.field(0).type), *[pa.array([r[k] for r in out], pa.int64()) for k in (1, 2, 3)]], names=[member, ordinal, depth, "body_end"]
            )

    return rows.mapInArrow(run, f"`{member}` {kind}, `{ordinal}` long, `{depth}` long, body_end long")


def branch_excerpts(ends: DataFrame, lines: DataFrame, member: str, ordinal: str, line_no: str, text: str) -> DataFrame:
    """The source of each body (member, ordinal, body_end), joined by line ends; empty for a body without lines."""
    span = ends.where(F.col("body_end") > F.col(ordinal)).select(member, ordinal, F.explode(F.sequence(F.col(ordinal) + 1, F.col("body_end"))).alias(line_no))
    body = span.join(lines.select(member, line_no, text), [member, line_no]).groupBy(member, ordinal)
    body = body.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line_no, text))), lambda x: x[text]), "\n").alias("excerpt"))
    return ends.join(body, [member, ordinal], "left").withColumn("excerpt", F.coalesce("excerpt", F.lit("")))


def leading_comments(lines: DataFrame, member: str, order: str, is_comment: Column) -> DataFrame:
    """The comment lines before a member's first other line."""
    w = Window.partitionBy(member).orderBy(order)
    return lines.withColumn("_code", F.sum((~is_comment).cast("int")).over(w)).where("_code = 0").drop("_code")


def forward_fill(rows: DataFrame, member: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the last non-null value so far in the member."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(member).orderBy(*order)))


def segments(lines: DataFrame, file: str, pos: str, is_banner: Column, count_banner: bool = True) -> DataFrame:
    """lines with segment (0 before the first banner) and line_no, which starts anew in each segment."""
    w = Window.partitionBy(file).orderBy(pos)
    out = lines.withColumn("_banner", is_banner).withColumn("segment", F.sum(F.col("_banner").cast("int")).over(w).cast("long"))
    if not count_banner:
        out = out.where("not _banner")
    within = Window.partitionBy(file, "segment").orderBy(pos)
    return out.withColumn("line_no", F.row_number().over(within).cast("long")).drop("_banner")


def merge_preambles(lines: DataFrame, file: str, pos: str, is_code: Column) -> DataFrame:
    """lines (from segments) where a segment 0 without code joins segment 1, renumbered."""
    whole = Window.partitionBy(file)
    out = lines.withColumn("_code0", F.max(F.when(F.col("segment") == 0, is_code.cast("int")).otherwise(0)).over(whole))
    out = out.withColumn("_more", F.max("segment").over(whole))
    out = out.withColumn("segment", F.when((F.col("segment") == 0) & (F.col("_code0") == 0) & (F.col("_more") > 0), F.lit(1)).otherwise(F.col("segment")).cast("long"))
    within = Window.partitionBy(file, "segment").orderBy(pos)
    return out.withColumn("line_no", F.row_number().over(within).cast("long")).drop("_code0", "_more")
