"""Queries of test planning, reports and scanners over the standard tables; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators import measures, resolve, scanners, structure, testplan, validate
from lodestrata.plans import reports
from lodestrata.plans.queries import ACCESSES, accesses, edges, parts, query, table
from lodestrata.sources import corpus

#: events as rules: the construct that each event type stands for.
CONSTRUCT = {"signup": "IF", "click": "ELSE", "view": "DECIDE FOR", "purchase": "WHEN", "error": "ON ERROR"}
RULES = """rules as (select user_id as member, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as n,
case event_type when 'signup' then 'IF' when 'click' then 'ELSE' when 'view' then 'DECIDE FOR' when 'purchase' then 'WHEN' else 'ON ERROR' end as construct, props as condition from events)"""


def rules(spark, d):
    table_ = F.create_map(*[F.lit(x) for kv in CONSTRUCT.items() for x in kv])
    e = table(spark, d, "events").withColumn("construct", table_[F.col("event_type")])
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("member"), "event_id", "ts", n.cast("int").alias("n"), "construct", F.col("props").alias("condition"))


@query(f"with {RULES} select member, printf('%d:BR-%03d', member, n) as scenario, construct, condition as given_condition from rules where construct <> 'DECIDE FOR'")
def P01_scenarios(spark, d):
    out = testplan.scenarios(rules(spark, d), "member", ["ts", "event_id"], "construct", "condition")
    return out.select("member", "scenario", "construct", F.col("given.condition").alias("given_condition"))


@query("select l_orderkey as member, string_agg('#' || l_partkey, ',' order by l_linenumber, l_partkey) as parameters from lineitem where l_returnflag = 'A' group by 1")
def P02_parameters(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'A'")
    packed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return li.groupBy(F.col("l_orderkey").alias("member")).agg(F.array_join(F.transform(packed, lambda x: F.concat(F.lit("#"), x["l_partkey"].cast("string"))), ",").alias("parameters"))


@query("""with a as (select l_orderkey as member, 'S' || l_suppkey as t from lineitem), c as (select l_orderkey as member, 'Part' || l_partkey as t from lineitem where l_returnflag <> 'R')
select coalesce(x.member, y.member) as member, coalesce(entities, '') as entities, coalesce(callees, '') as callees from (select member, string_agg(distinct t, ',' order by t) as entities from a group by 1) x
full join (select member, string_agg(distinct t, ',' order by t) as callees from c group by 1) y on x.member = y.member""")
def P03_mock_targets(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("member"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("entity"))
    calls = edges(spark, d).select(F.col("caller").alias("member"), "callee", F.when(F.col("kind") == "R", "INCLUDE").otherwise(F.col("kind")).alias("kind"))
    return testplan.mock_targets(li, calls, "member", "entity", "callee", "kind")


REVIEW = {0: "in_review", 1: "draft", 2: "signed_off", 3: None}


@query("""with o as (select doc_id, case doc_id % 4 when 0 then 'in_review' when 1 then 'draft' when 2 then 'signed_off' end as review_status, case when toxic = 1 then 'confirmed' when quality = 0 then 'odd' else 'rejected' end as s from labels)
select d.doc_id, case when review_status in ('in_review', 'signed_off') and s in ('confirmed', 'rejected') then s else 'characterization' end as status from documents d left join o on d.doc_id = o.doc_id""")
def P04_overlay_status(spark, d):
    state = F.when(F.col("doc_id") % 4 == 0, "in_review").when(F.col("doc_id") % 4 == 1, "draft").when(F.col("doc_id") % 4 == 2, "signed_off")
    status = F.when(F.col("toxic") == 1, "confirmed").when(F.col("quality") == 0, "odd").otherwise("rejected")
    overlay = table(spark, d, "labels").select("doc_id", state.alias("review_status"), status.alias("status"))
    return testplan.overlay_status(table(spark, d, "documents").select("doc_id"), overlay, "doc_id")


@query("""with c as (select doc_id, case when doc_id % 2 = 0 then 'signed_off' else 'draft' end as review_status, quality as v from labels where doc_id % 3 <> 0), n as (select doc_id, 'draft' as review_status, toxic + 10 as v from labels where doc_id % 5 <> 0)
select coalesce(c.doc_id, n.doc_id) as doc_id, case when c.doc_id is not null and (c.review_status = 'signed_off' or n.doc_id is null) then c.review_status else n.review_status end as review_status,
case when c.doc_id is not null and (c.review_status = 'signed_off' or n.doc_id is null) then c.v else n.v end as v from c full join n on c.doc_id = n.doc_id""")
def P05_merge_overlay(spark, d):
    rows = table(spark, d, "labels")
    now = rows.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "signed_off").otherwise("draft").alias("review_status"), F.col("quality").alias("v"))
    new = rows.where("doc_id % 5 <> 0").select("doc_id", F.lit("draft").alias("review_status"), (F.col("toxic") + 10).cast("int").alias("v"))
    return testplan.merge_overlay(now, new, "doc_id", ["review_status", "v"])


@query(f"""with {ACCESSES}, m as (select member, count(*) filter (verb = 'error') > 16 as dynamic, count(distinct entity) > 47 as unresolved, count(*) filter (verb = 'purchase') as entities, count(*) filter (verb = 'click') as targets from acc group by 1)
select member, case when dynamic or unresolved then 'untestable-gap' when entities > 14 then 'integration-only' when targets > 12 then 'needs-mock' else 'pure' end as testability from m""")
def P07_classify(spark, d):
    m = accesses(spark, d).groupBy("member").agg(
        (F.count_if(F.col("verb") == "error") > 16).alias("dynamic"), (F.countDistinct("entity") > 47).alias("unresolved"), (F.count_if(F.col("verb") == "purchase") - 13).alias("entities"), (F.count_if(F.col("verb") == "click") - 12).alias("targets")
    )
    return testplan.classify(m, F.col("dynamic"), F.col("unresolved"), F.col("entities"), F.col("targets")).select("member", "testability")


@query("select l_orderkey as member, 'Part' || l_partkey as target, min(l_linenumber) as first_line from lineitem where l_linestatus <> 'O' group by 1, 2")
def P08_seams(spark, d):
    calls = edges(spark, d).select(F.col("caller").alias("member"), F.col("callee").alias("target"), "line_no", F.col("internal").alias("dynamic"))
    return testplan.seams(calls, "member", "target", "line_no", "dynamic")


@query("""select l_orderkey, l_linenumber, case when l_linestatus = 'O' then 'target Part' || l_partkey || ' is set at run time' when p_partkey is null then 'Part' || l_partkey || ' has no source here' end as gap
from lineitem left join (select p_partkey from part where p_size <= 25) on l_partkey = p_partkey""")
def P09_gap_text(spark, d):
    e, p = edges(spark, d), parts(spark, d, 25).select("p_partkey")
    out = e.join(p, e["part"] == p["p_partkey"], "left")
    return out.select(F.col("caller").alias("l_orderkey"), F.col("line_no").alias("l_linenumber"), testplan.gap_text(F.col("callee"), F.col("internal"), F.col("p_partkey").isNotNull()).alias("gap"))


@query(f"""with {RULES} select member::varchar as report, 1 as section, n::int as ord, '| ' || printf('%d:BR-%03d', member, n) || ' | ' || construct || ' | ' || replace(coalesce(condition, ''), '|', '\\|') || ' | ' || printf('[[%d:%d]]', member, n) || ' |' as text from rules""")
def R04_rules_register(spark, d):
    return reports.rules_register(rules(spark, d), "member", ["ts", "event_id"], "construct", "condition", "n")


@query("""with c as (select n_name as report, row_number() over (partition by n_name order by c_custkey) as ord, c_name as text from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9000),
s as (select n_name as report, row_number() over (partition by n_name order by s_suppkey) as ord, s_name as text from supplier join nation on s_nationkey = n_nationkey),
r as (select report, 1 as section, ord, text from c union all select distinct report, 1, 0, '## Customers' from c union all select report, 2, ord, text from s union all select distinct report, 2, 0, '## Suppliers' from s)
select report, string_agg(text, chr(10) order by section, ord) as text from r group by 1""")
def R03_sectioned_report(spark, d):
    n = table(spark, d, "nation")
    c, s = table(spark, d, "customer").where("c_acctbal > 9000"), table(spark, d, "supplier")
    return reports.whole(
        reports.report(
            reports.section(1, "Customers", c.join(n, c.c_nationkey == n.n_nationkey), ["c_custkey"], F.col("c_name"), "n_name"),
            reports.section(2, "Suppliers", s.join(n, s.s_nationkey == n.n_nationkey), ["s_suppkey"], F.col("s_name"), "n_name"),
        )
    )


@query("select doc_id, case lang when 'en' then 'natural' when 'de' then 'mantis' end as dialect, case when n_chars > 2000 then 'program' else 'copycode' end as object_type from documents where lang in ('en', 'de') and n_chars > 500")
def R08_batchable(spark, d):
    kind = F.when(F.col("n_chars") > 2000, "program").when(F.col("n_chars") > 500, "copycode").otherwise("map")
    dialect = F.when(F.col("lang") == "en", "natural").when(F.col("lang") == "de", "mantis").otherwise(F.col("lang"))
    return reports.batchable(table(spark, d, "documents").select("doc_id", dialect.alias("dialect"), kind.alias("object_type")))


@query("""select doc_id, case when doc_id % 9 = 0 then '_ambiguous' when doc_id % 7 = 0 then '_unknown' else lang || case when doc_id % 2 = 0 then '/' || source else '' end end || '/D' || doc_id || '.md' as path from documents""")
def F15_output_paths(spark, d):
    docs = table(spark, d, "documents")
    path = reports.output_path(F.when(F.col("doc_id") % 7 != 0, F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.concat(F.lit("D"), F.col("doc_id")), F.col("doc_id") % 9 == 0)
    return docs.select("doc_id", path.alias("path"))


@query("select doc_id, case when doc_id % 3 = 1 then 'body ' || doc_id end as body from documents")
def F13_only_fence(spark, d):
    one = F.concat(F.lit("text\n```sql\nbody "), F.col("doc_id"), F.lit("\n```\n"))
    text = F.when(F.col("doc_id") % 3 == 1, one).when(F.col("doc_id") % 3 == 2, F.concat(one, one)).otherwise("no fence")
    return table(spark, d, "documents").select("doc_id", tx.only_fence(text).alias("body"))


@query("select doc_id, upper(coalesce(text, '')) like 'THE%' as accurate from documents")
def F05_verdict(spark, d):
    answer = F.concat(F.when(F.upper(F.coalesce("text", F.lit(""))).startswith("THE"), "Accurate: ").otherwise("Wrong: "), F.lit("reason\nACCURATE"))
    return table(spark, d, "documents").select("doc_id", tx.verdict(answer).alias("accurate"))


@query("select p_partkey, case p_partkey % 3 when 0 then 'A' when 1 then 'P' end as letter, case p_partkey % 3 when 0 then p_size::varchar when 1 then p_size || '.2' end as length from part")
def F12_format_parts(spark, d):
    raw = F.expr("case p_partkey % 3 when 0 then concat('(A', p_size, ')') when 1 then concat('p', p_size, ',2') else 'no format' end")
    letter, length = tx.format_parts(raw)
    return parts(spark, d).select("p_partkey", letter.alias("letter"), length.alias("length"))


@query("select p_partkey, 'SIZE,BRAND' as names, p_size || ',''' || p_brand || '''' as literals from part")
def X14_condition_facts(spark, d):
    condition = F.format_string("size = %d and brand = '%s' or SIZE > %d", F.col("p_size"), F.col("p_brand"), F.col("p_size"))
    names, literals = tx.condition_facts(condition, ["AND", "OR"])
    return parts(spark, d).select("p_partkey", names.alias("names"), literals.alias("literals"))


@query("select event_id, case when value > 66 then 0 when value > 33 then 1 else 2 end as rank from events")
def Q09_severity_rank(spark, d):
    level = F.when(F.col("value") > 66, "high").when(F.col("value") > 33, "medium").otherwise("low")
    return table(spark, d, "events").withColumn("severity", level).select("event_id", measures.by_severity().alias("rank"))


@query("select doc_id, 'JOB' || doc_id as member, printf('STEP%d', doc_id % 7) as step, 'PGM' || doc_id % 50 as program from documents")
def X25_scan_jcl(spark, d):
    job = F.format_string("//JOB%d JOB\n//STEP%d EXEC PGM=PGM%d,\n//   COND=(4,LT)\n//DD1 DD DSN=A.B,DISP=SHR", F.col("doc_id"), F.col("doc_id") % 7, F.col("doc_id") % 50)
    members = table(spark, d, "documents").select(F.concat(F.lit("JOB"), F.col("doc_id")).alias("name"), F.lit("jcl").alias("dialect"), F.lit(None).cast("string").alias("object_type"), job.alias("text"))
    out = scanners.facts_of(scanners.scan(members), "step")
    return out.select(F.substring("member", 4, 20).cast("long").alias("doc_id"), "member", F.col("kind").alias("step"), F.col("name").alias("program"))


@query()
def X06_scan_natural(spark, d):
    code = F.format_string("DEFINE DATA\nLOCAL\n1 V VIEW OF F%d\nEND-DEFINE\nR1. READ V BY KEY\nIF A = %d\nUPDATE (R1.)\nEND-IF\nEND-READ\nCALLNAT 'P%d'\nEND", F.col("doc_id") % 9, F.col("doc_id"), F.col("doc_id") % 50)
    members = table(spark, d, "documents").select(F.concat(F.lit("N"), F.col("doc_id")).alias("name"), F.lit("natural").alias("dialect"), F.lit("program").alias("object_type"), code.alias("text"))
    return scanners.facts_of(scanners.scan(members), "access")


@query("select doc_id, upper(regexp_replace(regexp_replace('d' || doc_id, '[.].*$', ''), '^.*/', '')) as name, case when doc_id % 2 = 0 then 'natural' else 'jcl' end as hint from documents")
def S10_member_names(spark, d):
    path = F.concat(F.lit("/src/d"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".nsp.txt").otherwise(".jcl"))
    name, hint = corpus.member_name(path)
    return table(spark, d, "documents").select("doc_id", name.alias("name"), hint.alias("hint"))


@query("select event_id as gap, event_type as kind from events where value > 66 order by event_type, event_id limit 200")
def W05_top_high_gaps(spark, d):
    e = table(spark, d, "events").where("value > 66").select(F.col("event_id").alias("gap"), F.col("event_type").alias("kind"))
    return e.orderBy("kind", "gap").limit(200)


@query("""with l as (select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::bigint as line_no, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
e as (select doc_id, 1::bigint as ordinal, doc_id % 6 as body_end from documents)
select e.doc_id, ordinal, coalesce(string_agg(line, chr(10) order by line_no), '') as excerpt from e left join l on l.doc_id = e.doc_id and line_no > ordinal and line_no <= body_end group by 1, 2""")
def W03_branch_excerpts(spark, d):
    docs = table(spark, d, "documents")
    ends = docs.select("doc_id", F.lit(1).cast("long").alias("ordinal"), (F.col("doc_id") % 6).alias("body_end"))
    out = structure.branch_excerpts(ends, corpus.lines(docs, "doc_id", "text"), "doc_id", "ordinal", "line_no", "line")
    return out.select("doc_id", "ordinal", "excerpt")


@query("select doc_id, case when doc_id % 3 = 0 then 'sources' when doc_id % 3 = 1 then '' else 'title,doc_type,sources' end as missing from documents")
def V01_front_matter(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, "---\ntitle: x\ndoc_type: y\n---\nbody").when(F.col("doc_id") % 3 == 1, "---\ntitle: x\ndoc_type: y\nsources: z\n---\n").otherwise("no block: here")
    _, missing = validate.front_matter(head, ["title", "doc_type", "sources"])
    return table(spark, d, "documents").select("doc_id", F.array_join(missing, ",").alias("missing"))


@query("select doc_id, case when doc_id % 3 = 0 then 'The total is kept.' else '' end as uncited from documents")
def V05_uncited_assertions(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, "# Title\nThe total is kept. The rest is cited [[A:1]].").when(F.col("doc_id") % 3 == 1, "The total is unclear.\n| The cell |").otherwise("- when it ends [[B]]\nPlain words.")
    return table(spark, d, "documents").select("doc_id", F.array_join(validate.uncited(validate.logical_units(text)), ";").alias("uncited"))


@query("select doc_id, 'D' || doc_id || ':BR-' || doc_id % 9 as refs from documents")
def V06_scenario_refs(spark, d):
    text = F.format_string("see D%d:BR-%d, not (xD:BR-) or D%d:BR-%d again", F.col("doc_id"), F.col("doc_id") % 9, F.col("doc_id"), F.col("doc_id") % 9)
    return table(spark, d, "documents").select("doc_id", F.array_join(validate.scenario_refs(text), ",").alias("refs"))


def includes(spark, d):
    """Each part but the first includes that of half its number."""
    p = table(spark, d, "part").where("p_partkey > 1")
    return p.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))


@query("""with recursive e as (select p_partkey as src, p_partkey // 2 as dst from part where p_partkey > 1), r(member, node, depth) as (select src, dst, 1 from e where src % 50 = 0 union all select member, e.dst, depth + 1 from r join e on r.node = e.src where depth < 12)
select member, node, min(depth) as depth from r where node > 0 group by 1, 2""")
def J11_include_closure(spark, d):
    """Of every 50th member, as in the SQL; J11_include_closure_all takes each."""
    e = includes(spark, d)
    return resolve.closures(e, e.where("src % 50 = 0").select(F.col("src").alias("member")), 12).where("node > 0")


@query()
def J11_include_closure_all(spark, d):
    """Of every member."""
    e = includes(spark, d)
    return resolve.closures(e, e.select(F.col("src").alias("member")), 12).where("node > 0")


@query("select doc_id, upper(text) like '%MAP%' as is_map, case when n_chars > 3000 then 'subprogram' when text like '%the%' then 'subroutine' else 'program' end as object_type from documents")
def S13_object_type(spark, d):
    rules_ = [("subprogram", F.col("n_chars") > 3000), ("subroutine", F.contains("text", F.lit("the")))]
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.contains(F.upper("text"), F.lit("MAP")).alias("is_map"), corpus.object_type(rules_).alias("object_type"))


@query("select doc_id, '/out/D' || doc_id || case lang when 'en' then '.java' when 'de' then '.py' when 'fr' then '.cs' else '.md' end as path from documents")
def F14_sidecar_paths(spark, d):
    language = F.when(F.col("lang") == "en", "java").when(F.col("lang") == "de", "python").when(F.col("lang") == "fr", "csharp")
    return table(spark, d, "documents").select("doc_id", tx.sidecar_path(F.concat(F.lit("/out/D"), F.col("doc_id"), F.lit(".md")), language).alias("path"))
