"""Markdown documents against the fact store: claims, validation, sampling of citations and judges' verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import CITATION, cited, hash_sample, sample_id
from lodestrata.operators import measures, resolve, validate
from lodestrata.plans.derive import FactStore, set_metric

#: Front matter that a document needs, and what a register needs.
REQUIRED = ["title", "doc_type", "module", "status"]
REGISTER = ["title", "doc_type"]


def read_docs(spark: SparkSession, folder: str) -> DataFrame:
    """doc (path), text of the .md files under a folder, READMEs left out."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    return files.select(F.input_file_name().alias("doc"), F.col("value").alias("text")).where(~F.col("doc").rlike(r"(?i)/README\.md$"))


def claim_pairs(docs: DataFrame) -> DataFrame:
    """doc, ord, claim, citations: each logical unit that cites, with its citations (joined by blanks) as written."""
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
    units = docs.select("doc", F.posexplode(validate.logical_units(body)).alias("ord", "unit"))
    cites = F.regexp_extract_all("unit", F.lit(CITATION), F.lit(0))
    claim = F.trim(F.regexp_replace(F.regexp_replace("unit", CITATION, ""), r"\s+", " "))
    return units.where(F.size(cites) > 0).select("doc", F.col("ord").cast("long").alias("ord"), claim.alias("claim"), F.array_join(cites, " ").alias("citations"))


def check(store: FactStore, docs: DataFrame) -> DataFrame:
    """doc, citations, invalid, missing (front matter), uncited, ok for each document; claims go to doc_claim."""
    claims = cited(docs, "doc", "text")
    found = validate.check_citations(claims, store["source_line"], store["member"])
    store["doc_claim"] = found.select("doc", "ord", "citation", "member", "from_line", "to_line", "valid", "note", "range_reversed")
    keys, missing = validate.front_matter(F.col("text"), REQUIRED)
    _, missing_register = validate.front_matter(F.col("text"), REGISTER)
    register = F.col("text").rlike(r"(?m)\A---\n(?:.*\n)*?doc_type:\s*register\s*$")
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
    rows = docs.select("doc", F.when(register, missing_register).otherwise(missing).alias("missing"), validate.uncited(validate.logical_units(body)).alias("uncited"))
    by_doc = store["doc_claim"].groupBy("doc").agg(F.count("*").alias("citations"), F.count_if(~F.col("valid")).alias("invalid"))
    out = rows.join(by_doc, "doc", "left").fillna({"citations": 0, "invalid": 0})
    return out.withColumn("ok", (F.col("invalid") == 0) & (F.size("missing") == 0) & (F.size("uncited") == 0))


def check_tests(store: FactStore, docs: DataFrame) -> DataFrame:
    """doc, scenario of references to scenarios that no test case has."""
    refs = docs.select("doc", F.explode(validate.scenario_refs(F.col("text"))).alias("scenario")).withColumn("_u", F.upper("scenario"))
    return refs.join(store["test_case"].select(F.upper("scenario").alias("_u")), "_u", "left_anti").select("doc", "scenario")


def sample_citations(store: FactStore, docs: DataFrame, n: int = 3, seed: str = "1") -> DataFrame:
    """Add at most n claims a document to citation_sample, each with the source it cites; samples taken before stay as they are."""
    pairs = hash_sample(claim_pairs(docs), "doc", F.concat_ws("\u0000", "doc", "ord"), seed, n)
    pairs = pairs.withColumn("id", sample_id(F.col("doc"), F.col("claim"), F.col("citations")))
    spots = cited(pairs, "id", "citations").where("from_line is not null")
    spots = spots.select("id", "member", F.explode(F.sequence(F.least("from_line", "to_line").cast("long"), F.greatest("from_line", "to_line").cast("long"))).alias("line_no"))
    lines = store["source_line"].select(F.upper("member").alias("member"), "line_no", "line")
    source = spots.distinct().join(lines, ["member", "line_no"]).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member", "line_no", "line"))), lambda x: x["line"]), "\n").alias("source"))
    none = F.lit(None).cast("boolean")
    new = pairs.join(source, "id", "left").select("id", "doc", "claim", "citations", "source", none.alias("human"), none.alias("llm"))
    if store.has("citation_sample"):
        old = store["citation_sample"]
        new = old.unionByName(new.join(old.select("id"), "id", "left_anti"))
    store["citation_sample"] = new
    return store["citation_sample"]


def record_verdicts(store: FactStore, verdicts: DataFrame, judge: str) -> None:
    """Put the verdicts (id, accurate) of a judge into citation_sample. A model's count only once a human has judged some.

    The share that humans call accurate becomes the metric citation_accuracy_rate.
    """
    rows = store["citation_sample"]
    if judge == "llm" and rows.where("human is not null").isEmpty():
        raise ValueError("no human verdicts yet")
    store["citation_sample"] = rows.join(verdicts.select("id", F.col("accurate").alias("_v")), "id", "left").withColumn(judge, F.coalesce("_v", judge)).drop("_v")
    rate = store["citation_sample"].agg(F.avg(F.col("human").cast("double"))).first()[0]
    if judge == "human" and rate is not None:
        set_metric(store, "citation_accuracy_rate", rate)


def rates(store: FactStore) -> DataFrame:
    """One row: samples, accuracy by each judge, and how often both agree (null where there is nothing to go by)."""
    rows = store["citation_sample"]
    one = rows.agg(F.count("*").alias("samples"), F.avg(F.col("human").cast("double")).alias("human"), F.avg(F.col("llm").cast("double")).alias("llm"))
    return one.join(measures.agreement(rows.where("human is not null").select("id", F.col("human").alias("v")), rows.where("llm is not null").select("id", F.col("llm").alias("v")), "id", "v"), how="cross")  # one row each


def scenario_differences(manifest: DataFrame, code: DataFrame, key: str = "scenario") -> DataFrame:
    """Scenario ids that only the manifest or only the code has."""
    return resolve.differences(manifest, code, key)
