"""Column functions over text: citations, redaction, ids, units, code fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: [[MEMBER]], [[MEMBER:LINE]] or [[MEMBER:FROM-TO]].
CITATION = r"\[\[([A-Za-z0-9#@$_.-]+)(?::([0-9]+)(?:-([0-9]+))?)?\]\]"


def citations(text: Column) -> Column:
    """All citations of a text as written."""
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))


def cited(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, citation, member, from_line, to_line: one row a citation; the lines are null where not given."""
    rows = docs.select(key, F.posexplode(citations(F.col(text))).alias("_ord", "citation")).withColumn("ord", F.col("_ord").cast("long"))
    number = lambda g: F.try_to_number(F.nullif(F.regexp_extract("citation", CITATION, g), F.lit("")), F.lit("999999999")).cast("int")
    first = number(2)
    return rows.select(key, "ord", "citation", F.upper(F.regexp_extract("citation", CITATION, 1)).alias("member"), first.alias("from_line"), F.coalesce(number(3), first).alias("to_line"))


def cite(member: Column, first: Column, last: Column | None = None) -> Column:
    one = F.format_string("[[%s:%d]]", member, first)
    return one if last is None else F.when(last.isNull() | (last == first), one).otherwise(F.format_string("[[%s:%d-%d]]", member, first, last))


def redact(text: Column, patterns: list[str], enabled: bool = True, mark: str = "[REDACTED]") -> Column:
    """Each pattern's matches replaced in turn; the text itself where not enabled or without patterns."""
    for p in patterns if enabled else []:
        text = F.regexp_replace(text, p, mark)
    return text


def sample_id(*parts: Column) -> Column:
    """16 hex digits that name a (document, claim, citation): the same on every run."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[p.cast("string") for p in parts]), 256), 1, 16)


def hash_sample(rows: DataFrame, group: str, identity: Column, seed: str, n: int) -> DataFrame:
    """At most n rows of each group, those of least sha256(seed, identity)."""
    w = Window.partitionBy(group).orderBy("_h")
    out = rows.withColumn("_h", F.sha2(F.concat(F.lit(seed), identity.cast("string")), 256)).withColumn("_n", F.row_number().over(w))
    return out.where(F.col("_n") <= n).drop("_h", "_n")


def signature(rows: DataFrame, parts: list[str], extra: list[str] = ()) -> DataFrame:
    """One row: sha256 over the rows' parts in order, and the extras; the same for the same set of rows.

    Rows are hashed where they lie; only sorted digests are gathered, grouped by their first two digits before the end.
    """
    each = F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)
    groups = rows.select(each.alias("h")).groupBy(F.substring("h", 1, 2).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    whole = groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "").alias("h"))
    return whole.select(F.sha2(F.concat_ws("\u0000", F.col("h"), *[F.lit(e) for e in extra]), 256).alias("signature"))


def escape_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def only_fence(text: Column, language: str = r"[A-Za-z0-9_+-]*") -> Column:
    """The body of the text's code fence if it has exactly one, else null."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)```{language}[ \t]*\n(.*?)\n?```"), F.lit(1))
    return F.when(F.size(found) == 1, found[0])


def verdict(text: Column) -> Column:
    """Whether the first line says ACCURATE."""
    return F.upper(F.trim(F.split(F.coalesce(text, F.lit("")), "\n")[0])).startswith("ACCURATE")


def format_parts(text: Column) -> tuple[Column, Column]:
    """Letter and length of a field format like (A10) or P9.3."""
    pattern = r"^\(?([A-Za-z])([0-9]+(?:[.,][0-9]+)?)?\)?$"
    plain = F.trim(text)
    return F.upper(F.nullif(F.regexp_extract(plain, pattern, 1), F.lit(""))), F.nullif(F.replace(F.regexp_extract(plain, pattern, 2), F.lit(","), F.lit(".")), F.lit(""))


def condition_facts(condition: Column, noise: list[str]) -> tuple[Column, Column]:
    """Distinct identifiers (noise words aside) and literals and numbers of a condition, each in order of appearance."""
    bare = F.regexp_replace(condition, r"'[^']*'|\"[^\"]*\"", " ")
    words = F.transform(F.regexp_extract_all(bare, F.lit(r"[#+&A-Za-z][A-Za-z0-9_#.-]*"), F.lit(0)), lambda w: F.upper(w))
    names = F.array_distinct(F.filter(words, lambda w: ~w.isin(noise)))
    literals = F.array_distinct(F.regexp_extract_all(condition, F.lit(r"'[^']*'|\"[^\"]*\"|[0-9]+(?:\.[0-9]+)?"), F.lit(0)))
    return F.array_join(names, ","), F.array_join(literals, ",")


#: File endings of the generated code's languages.
ENDINGS = {"java": ".java", "python": ".py", "csharp": ".cs", "javascript": ".js"}


def sidecar_path(path: Column, language: Column) -> Column:
    """The document's path with the language's ending; the path itself for an unknown language."""
    ending = F.try_element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), language)
    return F.when(ending.isNull(), path).otherwise(F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), ending))
