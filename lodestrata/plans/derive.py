"""From files to derived facts: ingest, derive, coverage and gates as one DAG of DataFrames.

FactStore maps table names to DataFrames, kept as Parquet under one folder. Every derived table is overwritten, never
appended, so running again gives the same store; gaps of extraction and of derivation are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import measures, resolve, scanners, upsert
from lodestrata.sources import corpus
from lodestrata.streaming import incremental

FACTS = {
    "call": "call_edge", "access": "data_access", "rule": "rule_candidate", "transaction": "transaction_marker", "interaction": "interaction", "message": "message_ref",
    "variable": "variable", "field": "entity_field", "entity": "entity", "link": "entity_link", "step": "job_step", "dd": "job_dd", "resource": "resource", "gap": "gap",
    "view": "view", "metric": "metric",
}
#: Kinds of entities whose fields a source describes.
DEFINED = ("sql_table", "adabas_file", "ddm", "supra_dataset")
NOT_INVOKED = ("INCLUDE", "PERFORM_INTERNAL")


class FactStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def __setitem__(self, name: str, rows: DataFrame) -> None:
        """Rows may come from the table itself: they are written aside and then take its place."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}.next")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        now, after = path(f"{self.folder}/{name}"), path(f"{self.folder}/{name}.next")
        fs = now.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(now, True)
        fs.rename(after, now)

    def has(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def names(self) -> Iterator[str]:
        return (n for n in ["source_file", "member", "source_line", *FACTS.values(), "derived_gap", "transaction_scope", "crud", "test_case", "testability", "doc_claim", "citation_sample", "metric_value"] if self.has(n))


def ingest(store: FactStore, path: str | list[dict], glob: str = "*", library: str | None = None) -> DataFrame:
    """Read files, and write members, lines and facts; returns the plan (path, action) of added, changed, kept and removed files.

    `path` is a folder, or source sets as corpus.source_sets() takes them. Only added and changed files are split and scanned;
    of kept files the members and facts stay, of changed and removed ones nothing does.
    """
    spark = store.spark
    sets = path if isinstance(path, list) else [{"path": path, "glob": glob, "library": library}]
    files = corpus.source_sets(spark, sets)
    key = F.sha2(F.concat_ws("\u0000", "sha256", *[F.coalesce(c, F.lit("")) for c in ("dialect", "library", "system", "sequence")]), 256)
    files = files.withColumn("state", key)  # the content and how it is to be read
    before = store["source_file"].select("path", "state") if store.has("source_file") else files.select("path", "state").limit(0)
    store["plan"] = incremental.plan(files.select("path", "state"), before, "path", "state")
    plan = store["plan"]
    todo = plan.where(F.col("action").isin("add", "change")).select("path")
    kept = plan.where("action = 'keep'").select("path")
    name, hint = corpus.member_name(F.col("path"))
    fresh = files.where("not too_large").join(todo, "path", "left_semi").withColumns({"name": name, "hint": F.coalesce("dialect", hint)}).drop("dialect")
    fresh = corpus.detect_dialect(fresh, "text", "hint")
    members = corpus.split_members(fresh.select("path", "name", "dialect", "sequence", "text"))
    members = members.join(fresh.select("path", "library", "system", "dialect", "ambiguous"), "path")
    members = members.withColumn("object_type", corpus.infer_type(F.col("text"), F.col("path"), F.col("dialect"), F.col("code")))
    members = members.select("name", "library", "system", "dialect", "object_type", "path", "first_line", "ambiguous", "text")
    stay = lambda name: store[name].join(kept, "path", "left_semi") if store.has(name) else None
    plus = lambda old, new: new if old is None else new.unionByName(old)
    store["read_member"] = plus(stay("read_member"), members)
    store["facts"] = plus(stay("facts"), scanners.scan(store["read_member"].join(todo, "path", "left_semi"), ("path",)))
    store["source_file"] = files.select("path", "sha256", "state", "size", "encoding", "too_large")
    store["member"] = upsert.last_writer(store["read_member"], ["name", "library", "dialect"], [F.desc("path"), F.desc("first_line")])
    own = store["member"].select("path", F.col("name").alias("member"))
    store["source_line"] = corpus.lines(store["member"].withColumnRenamed("name", "member"), "member", "text")
    facts = store["facts"].join(own.distinct(), ["path", "member"], "left_semi")  # of members that another file replaced, none
    for fact, name_ in FACTS.items():
        store[name_] = scanners.facts_of(facts, fact)
    gaps = store["member"].where("ambiguous").select(F.col("name").alias("member"), F.lit("ambiguous_dialect").alias("kind"), F.lit("medium").alias("severity"))
    large = store["source_file"].where("too_large").select(F.lit(None).cast("string").alias("member"), F.lit("source_too_large").alias("kind"), F.lit("high").alias("severity"))
    store["ingest_gap"] = gaps.unionByName(large)
    return plan


def named_files(store: FactStore) -> tuple[DataFrame, DataFrame]:
    """(mapping, gaps) of placeholder files FILE-nnn of a data definition to the one file of that number that is described."""
    said = store["entity"].where(F.col("kind").isin("adabas_file", "database")).groupBy("member")
    value = lambda verb: F.max(F.when(F.col("verb") == verb, F.col("name")))
    named = said.agg(value("NUMBER").alias("number"), value("NAME").alias("id"), value("DATABASE").alias("base")).where("id is not null")
    asked = store["entity_link"].where("verb = 'implements'").select(F.regexp_replace("kind", "^FILE-", "").alias("number"), F.col("detail").alias("base")).distinct()
    asked = asked.withColumn("id", F.concat_ws("@", F.concat(F.lit("FILE-"), F.col("number")), "base"))
    found = resolve.reconcile(asked, named, "number", "base", "id")
    return found, found.where("candidates > 1").select("placeholder")


def derive(store: FactStore) -> DataFrame:
    """Resolve, find orphans and undefined entities, scope transactions, and return coverage as (metric, value)."""
    members, calls, accesses = store["member"].withColumn("id", F.xxhash64("name", F.coalesce("library", F.lit("")), "dialect")), store["call_edge"], store["data_access"]
    edges = resolve.resolve_edges(calls.withColumn("own", F.col("kind") == "PERFORM_INTERNAL").withColumnRenamed("name", "callee"), members, "callee", "name", "id", "own")
    store["resolved_edge"] = edges.withColumn("dynamic", F.coalesce(F.col("detail") == "dynamic", F.lit(False)))
    edges = store["resolved_edge"]
    entities = store["entity"].select(F.col("name").alias("entity"), F.lit(True).alias("defined")).distinct()
    undefined = resolve.undefined_names(accesses, entities, "name", "entity", "defined")
    lost = resolve.unresolved_calls(edges.where(~F.col("resolved") & ~F.col("dynamic")), members, "callee", "kind", "member", "line_no", "name")
    alone = resolve.orphans(members.where(F.col("object_type") != "copycode"), edges.where("not dynamic"), "id", "name", "callee_id", "callee")
    mapping, doubtful = named_files(store)
    links = store["entity_link"].withColumn("target_id", F.when(F.col("verb") == "implements", F.concat_ws("@", "kind", "detail")).otherwise(F.col("kind")))
    store["resolved_link"] = resolve.repoint(links, mapping, "target_id").where(F.col("name").isNull() | (F.col("name") != F.col("target_id")))
    gap = lambda df, kind, level, detail, member: df.select(F.lit(kind).alias("kind"), F.lit(level).alias("severity"), detail.alias("detail"), member.alias("member"))
    nobody = F.lit(None).cast("string")
    reporting = store["metric"].where("name = 'mode' and detail = 'reporting'").select("member")
    changes = accesses.where(F.col("kind").isin("C", "U", "D")).join(reporting, "member", "left_anti")  # scopes of reporting mode are not in the text
    unbounded = changes.select("member").distinct().join(store["transaction_marker"].select("member"), "member", "left_anti")
    store["derived_gap"] = (
        gap(undefined, "no_ddl_for_entity", "medium", F.col("entity_name"), nobody)
        .unionByName(gap(lost, "unresolved_call", "high", F.col("callee"), F.col("first_caller")))
        .unionByName(gap(alone, "orphan_module", "low", F.col("name"), F.col("name")))
        .unionByName(gap(doubtful, "ambiguous_adabas_file", "medium", F.col("placeholder"), nobody))
        .unionByName(gap(unbounded, "sme_question", "medium", F.lit("writes without a transaction marker"), F.col("member")))
    )
    marks = store["transaction_marker"].select("member", "line_no", F.lit(True).alias("marker"), F.lit(False).alias("write"), nobody.alias("entity"))
    writes = changes.select("member", "line_no", F.lit(False).alias("marker"), F.lit(True).alias("write"), F.col("name").alias("entity"))
    store["transaction_scope"] = resolve.scopes(marks.unionByName(writes), "member", "line_no", "marker", "write").select("member", "boundary", "line_no", "entity")
    known = accesses.where("name is not null").select("member", F.col("name").alias("entity_name"), F.col("kind").alias("crud"), "verb", "line_no")
    store["crud"] = measures.crud_matrix(known, "member", "entity_name", "crud", "verb", "line_no")
    return coverage(store)


def coverage(store: FactStore) -> DataFrame:
    """(metric, value): counts and rates of the store; a rate with nothing to divide by is 0."""
    calls = ~F.col("kind").isin(*NOT_INVOKED)
    defined = store["entity"].where(F.col("kind").isin(*DEFINED)).select(F.upper("name").alias("name"), F.lit(True).alias("defined"))
    used = store["data_access"].where("name is not null and name not like 'WORKFILE-%'").select(F.upper("name").alias("name"), F.lit(False).alias("defined"))
    known = defined.unionByName(used).groupBy("name").agg(F.max("defined").alias("defined"))
    gaps = store["gap"].select("kind", F.col("verb").alias("severity")).unionByName(store["derived_gap"].select("kind", "severity")).unionByName(store["ingest_gap"].select("kind", "severity"))
    row = measures.coverage(
        {
            "member": (store["member"], {"members": F.count("*"), "code_members": F.count_if(F.col("dialect").isin("natural", "mantis"))}),
            "line": (store["source_line"], {"source_lines": F.count("*")}),
            "gap": (gaps, {"unparsed_lines": F.count_if(F.col("kind") == "unparsed_line"), "gaps_high": F.count_if(F.col("severity") == "high"), "gaps_total": F.count("*")}),
            "entity": (known, {"entities": F.count("*"), "entities_with_definition": F.count_if("defined"), "entity_definition_rate": measures.ratio(F.count_if("defined"), F.count("*"))}),
            "field": (store["entity_field"], {"entity_fields": F.count("*")}),
            "access": (store["data_access"], {"data_accesses": F.count("*")}),
            "rule": (store["rule_candidate"], {"rule_candidates": F.count("*")}),
            "edge": (
                store["resolved_edge"],
                {
                    "invocation_edges": F.count_if(calls), "invocations_resolved": F.count_if(calls & F.col("resolved")), "call_resolution_rate": measures.ratio(F.count_if(calls & F.col("resolved")), F.count_if(calls)),
                    "dynamic_call_edges": F.count_if(F.col("dynamic")), "include_edges": F.count_if(F.col("kind") == "INCLUDE"), "includes_resolved": F.count_if((F.col("kind") == "INCLUDE") & F.col("resolved")),
                    "include_resolution_rate": measures.ratio(F.count_if((F.col("kind") == "INCLUDE") & F.col("resolved")), F.count_if(F.col("kind") == "INCLUDE")),
                },
            ),
        }
    )
    row = row.withColumn("line_recognition_rate", F.when(F.col("source_lines") > 0, F.bround(1 - F.col("unparsed_lines") / F.col("source_lines"), 4)).otherwise(0.0))
    rows = measures.as_rows(row)
    return rows.unionByName(store["metric_value"].select("metric", "value")) if store.has("metric_value") else rows


def set_metric(store: FactStore, metric: str, value: float) -> None:
    """Put a metric that is measured outside, in place of the one of that name."""
    new = store.spark.createDataFrame([(metric, float(value))], "metric string, value double")
    store["metric_value"] = store["metric_value"].where(F.col("metric") != metric).unionByName(new) if store.has("metric_value") else new


def export(store: FactStore, folder: str) -> list[str]:
    """Every table of the store as JSON lines; returns their names."""
    done = []
    for name in store.names():
        store[name].write.mode("overwrite").json(f"{folder}/{name}")
        done.append(name)
    return done
