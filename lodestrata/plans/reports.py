"""Reports as ordered rows: (section, ord, text). render() puts one report's rows on end; the rest stays distributed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import cite, escape_cell

#: Members that documents are generated for.
BATCH_DIALECTS, BATCH_TYPES = ("natural", "mantis"), ("program", "subprogram", "subroutine", "copycode")


def section(number: int, title: str, rows: DataFrame, order: list, text: Column, key: str | None = None) -> DataFrame:
    """The rows of one section, under its title where there are any; `key` makes one report for each of its values."""
    w = Window.partitionBy(*([key] if key else [F.lit(0)])).orderBy(*order)
    body = rows.select(*([F.col(key).alias("report")] if key else [F.lit("").alias("report")]), F.row_number().over(w).alias("ord"), text.alias("text"))
    heads = body.select("report").distinct().select("report", F.lit(0).alias("ord"), F.lit(f"## {title}").alias("text"))
    return heads.unionByName(body).withColumn("section", F.lit(number))


def report(*sections: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sections)


def whole(rows: DataFrame) -> DataFrame:
    """report, text: each report's lines in order, joined."""
    packed = F.array_sort(F.collect_list(F.struct("section", "ord", "text")))
    return rows.groupBy("report").agg(F.array_join(F.transform(packed, lambda x: x["text"]), "\n").alias("text"))


def batchable(members: DataFrame) -> DataFrame:
    return members.where(F.col("dialect").isin(*BATCH_DIALECTS) & F.col("object_type").isin(*BATCH_TYPES))


def rules_register(rules: DataFrame, member: str, order: list[str], construct: str, condition: str, line: str) -> DataFrame:
    """report (the member), section, ord, text: one table row a rule, with its id and citation."""
    w = Window.partitionBy(member).orderBy(*order)
    name = F.col(member).cast("string")
    rows = rules.withColumn("_n", F.row_number().over(w))
    cells = [F.format_string("%s:BR-%03d", name, F.col("_n")), F.col(construct), escape_cell(F.coalesce(F.col(condition), F.lit(""))), cite(name, F.col(line))]
    return rows.select(name.alias("report"), F.lit(1).alias("section"), F.col("_n").alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("text"))


def output_path(dialect: Column, library: Column, name: Column, ambiguous: Column) -> Column:
    folder = F.when(ambiguous, "_ambiguous").when(dialect.isNull(), "_unknown").otherwise(F.concat(dialect, F.when(library.isNotNull() & (library != ""), F.concat(F.lit("/"), library)).otherwise("")))
    return F.concat(folder, F.lit("/"), name, F.lit(".md"))
