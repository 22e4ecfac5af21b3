"""Queries of the corpus-fact operators over the standard tables, each with its SQL where SQL can say the same.

The tables stand for fact tables: events are data accesses and control flow by user, lineitem rows are call edges from
orders to parts, documents are members with lines, labels are verdicts. Every operator is called with column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators import measures, resolve, structure, upsert, validate
from lodestrata.sources import corpus
from lodestrata.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CRUD = {"signup": "C", "view": "R", "click": "R", "purchase": "U"}


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member (user), line_no, verb, crud and entity (the page a user acts on) of events."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    crud = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CRUD.items() for x in kv]), F.col("event_type")), F.lit("?"))
    entity = F.concat(F.lit("E"), F.get_json_object("props", "$.k"))
    return e.select(F.col("user_id").alias("member"), n.alias("line_no"), F.col("event_type").alias("verb"), crud.alias("crud"), entity.alias("entity"), "event_id")


ACCESSES = """acc as (
  select user_id as member, row_number() over (partition by user_id order by ts, event_id) as line_no, event_type as verb,
         case event_type when 'signup' then 'C' when 'view' then 'R' when 'click' then 'R' when 'purchase' then 'U' else '?' end as crud,
         'E' || json_extract_string(props, '$.k') as entity, event_id from events)"""


@query(f"""with {ACCESSES} select member, verb as entity_name, string_agg(distinct crud, ',' order by crud) as crud, string_agg(distinct entity, ',' order by entity) as verbs,
count(*) as hits, min(line_no) as first_line from acc group by member, verb""")
def A01_crud_matrix(spark, d):
    a = accesses(spark, d).withColumnRenamed("verb", "entity_name")
    return measures.crud_matrix(a, "member", "entity_name", "crud", "entity", "line_no")


@query(f"""with {ACCESSES} select (select count(*) from documents) as members, (select count(*) from acc) as data_accesses,
(select count(*) from acc where crud = '?') as unknown_accesses,
(select coalesce(sum(case when crud <> '?' then 1 else 0 end)::double / nullif(count(*), 0), 0) from acc) as recognition_rate,
(select count(*) from lineitem) as edges, (select count(*) from lineitem where l_linestatus = 'O') as dynamic_edges""")
def A02_coverage(spark, d):
    acc = accesses(spark, d)
    return measures.coverage(
        {
            "members": (table(spark, d, "documents"), {"members": F.count("*")}),
            "access": (
                acc,
                {"data_accesses": F.count("*"), "unknown_accesses": F.count_if(F.col("crud") == "?"), "recognition_rate": measures.ratio(F.count_if(F.col("crud") != "?"), F.count("*"))},
            ),
            "edges": (table(spark, d, "lineitem"), {"edges": F.count("*"), "dynamic_edges": F.count_if(F.col("l_linestatus") == "O")}),
        }
    )


@query("select event_type as gap_kind, case when value > 66 then 'high' when value > 33 then 'medium' else 'low' end as severity, count(*) as n from events group by all")
def A03_gap_histogram(spark, d):
    level = F.when(F.col("value") > 66, "high").when(F.col("value") > 33, "medium").otherwise("low")
    return measures.histogram(table(spark, d, "events").select(F.col("event_type").alias("gap_kind"), level.alias("severity")), "gap_kind", "severity")


GATES = [("edges", "min", 1000.0), ("dynamic_edges", "max", 10.0), ("recognition_rate", "min", 0.5), ("absent_metric", "min", 0.1)]


@query("""with m as (select 'edges' as metric, count(*)::double as value from lineitem union all select 'dynamic_edges', count(*)::double from lineitem where l_linestatus = 'O'
union all select 'recognition_rate', avg(case when event_type <> 'error' then 1.0 else 0.0 end)::double from events),
g(metric, kind, threshold) as (values ('edges', 'min', 1000.0::double), ('dynamic_edges', 'max', 10.0), ('recognition_rate', 'min', 0.5), ('absent_metric', 'min', 0.1))
select g.metric, kind, threshold, coalesce(value, 0.0) as value, case when kind = 'min' then coalesce(value, 0.0) >= threshold else coalesce(value, 0.0) <= threshold end as passed,
greatest(case when kind = 'min' then threshold - coalesce(value, 0.0) else coalesce(value, 0.0) - threshold end, 0.0) as shortfall from g left join m on g.metric = m.metric""")
def A04_quality_gates(spark, d):
    edges, events = table(spark, d, "lineitem"), table(spark, d, "events")
    row = measures.coverage(
        {
            "e": (edges, {"edges": F.count("*"), "dynamic_edges": F.count_if(F.col("l_linestatus") == "O")}),
            "v": (events, {"recognition_rate": measures.ratio(F.count_if(F.col("event_type") != "error"), F.count("*"))}),
        }
    )
    return measures.gate(measures.as_rows(row), GATES)


LINES = "lines as (select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::bigint as line_no, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)"


@query(f"""with {LINES}, t as (select *, upper(regexp_extract(line, '^[ ]*([^ ]+)', 1)) as token from lines where regexp_full_match(line, '[\\x20-\\x7E]*'))
select token, count(*) as n, arg_min(line, (doc_id, line_no)) as sample from t where token <> '' group by token order by n desc, token limit 30""")
def A05_calibrate(spark, d):
    """Lines of printable ASCII only, as in the SQL; A05_calibrate_all takes every line."""
    rows = corpus.lines(table(spark, d, "documents"), "doc_id", "text").where(F.col("line").rlike("^[\\x20-\\x7E]*$"))
    return measures.calibrate(rows, "line", ["doc_id", "line_no"])


@query()
def A05_calibrate_all(spark, d):
    """Every line, of any characters; upper-casing differs in SQL, so tests compare it with a plain version."""
    return measures.calibrate(corpus.lines(table(spark, d, "documents"), "doc_id", "text"), "line", ["doc_id", "line_no"])


@query("select count(*) as pairs, avg(case when quality = toxic then 1.0 else 0.0 end)::double as agreement from labels")
def A06_agreement(spark, d):
    rows = table(spark, d, "labels")
    return measures.agreement(rows.select("doc_id", F.col("quality").alias("v")), rows.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query("""select o_orderstatus as status, count(*) as n, sum(o_orderkey)::bigint as tokens_in, sum(o_custkey)::bigint as tokens_out,
sum(o_orderkey) * 3.0 / 1e6 + sum(o_custkey) * 15.0 / 1e6 > 0 as has_cost from orders group by 1""")
def A07_batch_cost(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status")
    return measures.batch_cost(o, 3.0, 15.0, "o_orderkey", "o_custkey", "status").select("status", "n", "tokens_in", "tokens_out", (F.col("cost") > 0).alias("has_cost"))


def edges(spark, d):
    """Call edges from orders to parts by name."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("caller"), F.col("l_linenumber").alias("line_no"), F.concat(F.lit("Part"), F.col("l_partkey")).alias("callee"),
        F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("kind"), (F.col("l_linestatus") == "O").alias("internal"), F.col("l_quantity").alias("quantity"),
    )


EDGES = "edges as (select l_orderkey as caller, l_linenumber as line_no, 'Part' || l_partkey as callee, l_partkey as part, l_returnflag as kind, l_linestatus = 'O' as internal, l_quantity as quantity from lineitem)"


def parts(spark, d, most=None):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("PART"), F.col("p_partkey")).alias("name"), "p_size", "p_brand", "p_type", "p_retailprice")
    return p if most is None else p.where(F.col("p_size") <= most)


@query("""with n as (select p_partkey as id, p_size as number, case when p_partkey % 3 = 0 then null else p_partkey % 5 end as base from part where p_partkey % 7 = 0),
p as (select p_partkey as id, p_size as number, case when p_partkey % 4 = 0 then null else p_partkey % 5 end as base from part where p_partkey % 7 <> 0)
select p.id as placeholder, case when count(*) = 1 then min(n.id) end as target, count(*) as candidates
from p join n on p.number = n.number and (p.base is null or n.base is null or p.base = n.base) group by p.id""")
def J01_reconcile_placeholders(spark, d):
    p = parts(spark, d)
    base = lambda k: F.when(F.col("p_partkey") % k == 0, None).otherwise(F.col("p_partkey") % 5)
    named = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("number"), base(3).alias("base"))
    open_ = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("number"), base(4).alias("base"))
    return resolve.reconcile(open_, named, "number", "base", "id")


@query(f"""with {EDGES}, def as (select upper('PART' || p_partkey) as u, min(p_partkey) as id from part where p_size <= 25 group by 1)
select caller, line_no, callee, id as callee_id, id is not null or internal as resolved from edges left join def on upper(callee) = u""")
def J02_resolve_edges(spark, d):
    out = resolve.resolve_edges(edges(spark, d), parts(spark, d, 25), "callee", "name", "p_partkey", "internal")
    return out.select("caller", "line_no", "callee", "callee_id", "resolved")


@query(f"""with {EDGES}, def as (select upper('PART' || p_partkey) as u, min(p_partkey) as id from part where p_size <= 40 group by 1)
select caller, line_no, coalesce(case when part % 2 = 0 then part end, id) as entity_id from edges left join def on upper(callee) = u""")
def J03_fill_entity(spark, d):
    acc = edges(spark, d).withColumn("entity_id", F.when(F.col("part") % 2 == 0, F.col("part")))
    return resolve.fill_entity(acc, parts(spark, d, 40), "callee", "entity_id", "name", "p_partkey").select("caller", "line_no", "entity_id")


@query(f"""with {EDGES}, def as (select upper('PART' || p_partkey) as u, p_size <= 40 as ok from part where p_partkey % 10 <> 0)
select distinct callee as entity_name from edges left join def on upper(callee) = u where u is null or not ok""")
def J04_undefined_entities(spark, d):
    p = parts(spark, d).where("p_partkey % 10 <> 0").withColumn("defined", F.col("p_size") <= 40)
    return resolve.undefined_names(edges(spark, d), p, "callee", "name", "defined")


@query(f"""with {EDGES}, def as (select upper('PART' || p_partkey) as u from part where p_size <= 25)
select upper(callee) as callee, kind as call_kind, count(*) as calls, arg_min(caller, (line_no, caller)) as first_caller, min(line_no) as first_line
from edges where upper(callee) not in (select u from def) group by 1, 2""")
def J05_unresolved_calls(spark, d):
    return resolve.unresolved_calls(edges(spark, d), parts(spark, d, 25), "callee", "kind", "caller", "line_no", "name")


@query(f"""with {EDGES}, e as (select case when kind = 'R' then part end as id, case when kind = 'A' then callee end as name from edges where quantity > 48)
select p_partkey, 'PART' || p_partkey as name from part p where not exists (select 1 from e where e.id = p.p_partkey or upper(e.name) = upper('PART' || p.p_partkey))""")
def J06_orphans(spark, d):
    e = edges(spark, d).where("quantity > 48").select(F.when(F.col("kind") == "R", F.col("part")).alias("id"), F.when(F.col("kind") == "A", F.col("callee")).alias("name"))
    return resolve.orphans(parts(spark, d), e, "p_partkey", "name", "id", "name").select("p_partkey", "name")


@query(f"""with {ACCESSES}, w as (select * from acc where verb in ('signup', 'click')), m as (select member, line_no from acc where verb = 'purchase')
select w.member, w.line_no, w.verb, m.line_no as boundary from w asof join m on w.member = m.member and w.line_no <= m.line_no""")
def J07_transaction_scopes(spark, d):
    rows = accesses(spark, d).withColumn("marker", F.col("verb") == "purchase").withColumn("write", F.col("verb").isin("signup", "click"))
    return resolve.scopes(rows, "member", "line_no", "marker", "write").select("member", "line_no", "verb", "boundary")


@query("""select r1.r_name as from_name, n.n_name as link, s.s_name as via_name from nation n join region r1 on n.n_regionkey = r1.r_regionkey
left join supplier s on s.s_nationkey = n.n_nationkey and s.s_suppkey % 10 = 0""")
def J08_entity_links(spark, d):
    n, r, s = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "supplier").where("s_suppkey % 10 = 0")
    entities = r.select(F.concat(F.lit("r"), "r_regionkey").alias("k"), F.col("r_name").alias("name")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("k"), F.col("n_name").alias("name")))
    links = n.select(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"), F.col("n_nationkey").alias("via"))
    out = resolve.linked_entities(links, entities, s, "a", "b", "via", "k", "name", "s_nationkey", "s_name")
    return out.select("from_name", F.col("to_name").alias("link"), "via_name")


@query(f"with {EDGES} select 'PART' || p_partkey as name, caller, line_no from part join edges on upper(callee) = upper('PART' || p_partkey) where p_size = 1")
def J09_inbound_callers(spark, d):
    e, p = edges(spark, d), parts(spark, d).where("p_size = 1")
    return resolve.callers_of(e, p, "callee", "name").select("name", "caller", "line_no")


@query(f"with {ACCESSES} select entity, member, line_no, crud from acc where entity in (select 'E' || k from range(10) t(k))")
def J10_accessed_by(spark, d):
    wanted = spark.range(10).select(F.concat(F.lit("E"), F.col("id").cast("string")).alias("entity"))
    return resolve.accesses_of(accesses(spark, d), wanted, "entity").select("entity", "member", "line_no", "crud")


CITED = """raw as (select doc_id, 'see [[D' || (doc_id % 50) || ':' || (doc_id % 97 + 1) || ']] and [[d' || (doc_id % 61) || ':9-' || (doc_id % 13 + 1) || ']] or [[D' || (doc_id % 1999) || ']]' as body from documents),
cits as (select doc_id, unnest(regexp_extract_all(body, '\\[\\[([A-Za-z0-9#@$_.-]+)(?::([0-9]+)(?:-([0-9]+))?)?\\]\\]')) as citation, generate_subscripts(regexp_extract_all(body, '\\[\\[[^\\]]*\\]\\]'), 1) - 1 as ord from raw),
claims as (select doc_id, ord, citation, upper(regexp_extract(citation, '\\[\\[([^:\\]]+)', 1)) as member, try_cast(nullif(regexp_extract(citation, ':([0-9]+)', 1), '') as int) as from_line,
coalesce(try_cast(nullif(regexp_extract(citation, '-([0-9]+)\\]', 1), '') as int), try_cast(nullif(regexp_extract(citation, ':([0-9]+)', 1), '') as int)) as to_line from cits)"""


def synthetic_claims(spark, d):
    body = F.expr("concat('see [[D', doc_id % 50, ':', doc_id % 97 + 1, ']] and [[d', doc_id % 61, ':9-', doc_id % 13 + 1, ']] or [[D', doc_id % 1999, ']]')")
    return tx.cited(table(spark, d, "documents").select("doc_id", body.alias("body")), "doc_id", "body")


def document_members(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id")).alias("name"), "doc_id", "source", "lang", "text")


@query(f"""with {CITED}, {LINES}, last as (select 'D' || doc_id as u, max(line_no) as last_line from lines group by 1)
select doc_id, ord, citation, case when u is null then 'unknown member' when from_line is not null and (greatest(from_line, to_line) > last_line or least(from_line, to_line) < 1) then 'out of range' end as note,
u is not null and not coalesce(greatest(from_line, to_line) > last_line or least(from_line, to_line) < 1, false) as valid, coalesce(from_line > to_line, false) as range_reversed
from claims left join last on member = u""")
def J12_check_citations(spark, d):
    members = document_members(spark, d)
    rows = corpus.lines(members.withColumnRenamed("name", "member"), "member", "text")
    return validate.check_citations(synthetic_claims(spark, d), rows, members).select("doc_id", "ord", "citation", "note", "valid", "range_reversed")


@query(f"""with {CITED}, {LINES} select c.doc_id, ord, line_no, line from claims c join lines l on member = 'D' || l.doc_id and line_no between from_line and to_line""")
def J13_cited_lines(spark, d):
    rows = corpus.lines(document_members(spark, d).withColumnRenamed("name", "member"), "member", "text")
    claims = synthetic_claims(spark, d).where("from_line <= to_line")
    claims = claims.select("doc_id", "ord", "member", F.explode(F.sequence(F.col("from_line").cast("long"), F.col("to_line").cast("long"))).alias("line_no"))
    return claims.join(rows, ["member", "line_no"]).select("doc_id", "ord", "line_no", "line")


@query("select distinct upper(p_brand) || ':' || p_size as ref from part where upper(p_brand) || ':' || p_size not in (select upper(p_brand) || ':' || p_size from part where p_partkey % 3 = 0)")
def J14_unknown_references(spark, d):
    ref = lambda p: p.select(F.concat(F.upper("p_brand"), F.lit(":"), F.col("p_size").cast("string")).alias("ref"))
    p = parts(spark, d)
    return resolve.unknown_references(ref(p), ref(p.where("p_partkey % 3 = 0")), "ref")


@query("""with l as (select distinct l_partkey as id from lineitem where l_quantity > 45), r as (select p_partkey as id from part where p_size < 20)
select id, 'left' as side from l where id not in (select id from r) union all select id, 'right' from r where id not in (select id from l)""")
def J15_manifest_difference(spark, d):
    left = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return resolve.differences(left, parts(spark, d).where("p_size < 20").select(F.col("p_partkey").alias("id")), "id")


@query("select a.doc_id, a.quality as human, b.toxic as llm from labels a join labels b using (doc_id) where a.doc_id % 2 = 0 and b.doc_id % 3 = 0")
def J16_both_verdicts(spark, d):
    rows = table(spark, d, "labels")
    return resolve.both_judged(rows.where("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("human")), rows.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("llm")), "doc_id")


@query("select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def J17_gaps_by_dialect(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return resolve.facts_of_members(o, c, "o_custkey", "c_custkey", ["c_mktsegment"]).select("o_orderkey", "c_mktsegment")


@query("select l_orderkey, l_linenumber, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey where l_quantity = 50")
def J18_cases_of_members(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity = 50").select("l_orderkey", "l_linenumber")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return resolve.facts_of_members(li, o, "l_orderkey", "o_orderkey", ["o_orderstatus"]).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def J19_facts_of_batch(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return resolve.facts_in_batch(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), urgent, "l_orderkey", "o_orderkey")


def calls(spark, d):
    """Two calls out of each part."""
    p = table(spark, d, "part").select("p_partkey")
    n = p.count()
    out = lambda a, b: p.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * a + b) % n + 1).alias("dst"))
    return out(7, 3).union(out(3, 11))


@query("""with recursive n as (select count(*) as n from part), e as (select p_partkey as s, (p_partkey * 7 + 3) % (select n from n) + 1 as t from part union select p_partkey, (p_partkey * 3 + 11) % (select n from n) + 1 from part),
r(node, depth) as (select 1::bigint, 0 union select t, depth + 1 from r join e on s = node where depth < 8) select node, min(depth) as depth from r group by node""")
def G01_call_closure(spark, d):
    """To depth 8, as in the SQL; G01_call_closure_full goes to the operator's depth."""
    return resolve.closure(calls(spark, d), 1, 8)


@query()
def G01_call_closure_full(spark, d):
    """To the operator's own depth, 12."""
    return resolve.closure(calls(spark, d), 1)


@query("select o_orderkey as entry, o_orderpriority as kind from orders where o_orderpriority = '1-URGENT' union all select c_custkey, c_mktsegment from customer where c_mktsegment = 'MACHINERY'")
def G03_entry_points(spark, d):
    a = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("entry"), F.col("o_orderpriority").alias("kind"))
    return a.unionByName(table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("entry"), F.col("c_mktsegment").alias("kind")))


@query("select lang as dialect, source as object_type, count(*) as n from documents group by all")
def G04_member_inventory(spark, d):
    return measures.histogram(table(spark, d, "documents").select(F.col("lang").alias("dialect"), F.col("source").alias("object_type")), "dialect", "object_type")


@query("""select coalesce(p_brand, '') as p_brand, coalesce(p_type, '') as p_type, arg_max(p_size, p_partkey) filter (p_size <> 13) as p_size, arg_max(p_retailprice, p_partkey) as p_retailprice from part group by 1, 2""")
def U01_upsert_member(spark, d):
    p = parts(spark, d).withColumn("p_size", F.when(F.col("p_size") != 13, F.col("p_size")))
    return upsert.upsert(p, ["p_brand", "p_type"], "p_partkey", ["p_size", "p_retailprice"])


@query("select upper(c_mktsegment) as entity, c_nationkey, max(c_custkey) as last_id, arg_max(c_name, c_custkey) as c_name from customer group by 1, 2")
def U02_upsert_entity(spark, d):
    c = table(spark, d, "customer").withColumn("entity", F.upper("c_mktsegment")).withColumn("last_id", F.col("c_custkey")).withColumn("nation", F.col("c_nationkey").cast("string"))
    return upsert.upsert(c, ["entity", "nation"], "c_custkey", ["last_id", "c_name"]).select("entity", F.col("nation").cast("int").alias("c_nationkey"), "last_id", "c_name")


@query("""select upper(p_type) as type, p_brand as brand, arg_max(p_name, p_partkey) as p_name, arg_min(p_size, p_partkey) as remark from part group by 1, 2""")
def U04_upsert_field(spark, d):
    p = table(spark, d, "part").select(F.upper("p_type").alias("type"), F.col("p_brand").alias("brand"), "p_partkey", "p_name", F.col("p_size").alias("remark"))
    return upsert.upsert(p, ["type", "brand"], "p_partkey", ["p_name", "remark"], keep_first=["remark"])


@query("""select l_orderkey, l_linenumber, case when l_partkey in (select p_partkey from part where p_size > 45) then null else l_partkey end as callee_id from lineitem
where l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)""")
def U05_purge_members(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("callee_id"))
    gone = table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey")
    out = upsert.purge(li, gone, "l_suppkey")
    g = parts(spark, d).where("p_size > 45").select(F.col("p_partkey").alias("_gone"))
    out = out.join(g, out.callee_id == g["_gone"], "left").withColumn("callee_id", F.when(F.col("_gone").isNull(), F.col("callee_id")))
    return out.select("l_orderkey", "l_linenumber", "callee_id")


@query("select upper(n_name) as member_name, count(*) as members, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as libraries, count(*) > 1 as ambiguous from customer join nation on c_nationkey = n_nationkey group by 1")
def U07_name_holders(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return resolve.name_holders(c.join(n, c.c_nationkey == n.n_nationkey), "n_name", "c_mktsegment")


@query("select c_name, min(c_custkey) as id from customer where c_nationkey < 20 group by c_name having count(*) = 1")
def U08_unambiguous(spark, d):
    return resolve.unambiguous(table(spark, d, "customer").where("c_nationkey < 20"), "c_name").select("c_name", F.col("c_custkey").alias("id"))


@query("""with r as (select user_id, ts, event_id, printf('%d:BR-%03d', user_id, row_number() over (partition by user_id order by ts, event_id)) as rule_id, event_type from events)
select event_id, rule_id from r where event_type in ('click', 'view')""")
def W01_rule_ids(spark, d):
    e = structure.rule_ids(table(spark, d, "events").withColumn("m", F.col("user_id")), "m", ["ts", "event_id"])
    return e.where("event_type in ('click', 'view')").select("event_id", "rule_id")


DEPTHS = """r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n, event_type, case event_type when 'signup' then 1 when 'error' then -1 else 0 end as step from events),
p as (select *, coalesce(sum(step) over (partition by user_id order by n rows between unbounded preceding and 1 preceding), 0) as s from r),
dep as (select *, (s - least(min(s) over (partition by user_id order by n), 0))::bigint as depth from p)"""


def nested_events(spark, d):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    e = table(spark, d, "events").withColumn("step", step)
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return structure.nesting(e, "user_id", ["n"], "step")


@query(f"with {DEPTHS} select event_id, depth from dep")
def W02_nesting_depth(spark, d):
    return nested_events(spark, d).select("event_id", "depth")


@query(f"""with {DEPTHS}, h as (select * from dep where event_type = 'signup')
select h.user_id, h.n, h.depth, min(case when x.depth < h.depth or (x.depth = h.depth and x.event_type = 'signup') then x.n end) - 1 as body_end
from h left join dep x on x.user_id = h.user_id and x.n > h.n group by 1, 2, 3""")
def W02_branch_bodies(spark, d):
    e = nested_events(spark, d).withColumn("head", F.col("event_type") == "signup")
    return structure.branch_ends(e, "user_id", "n", "depth", "head")


@query(f"with {LINES}, c as (select *, sum(case when length(line) >= 40 then 1 else 0 end) over (partition by doc_id order by line_no) as code from lines) select doc_id, line_no, line from c where code = 0")
def W04_leading_comments(spark, d):
    rows = corpus.lines(table(spark, d, "documents"), "doc_id", "text")
    return structure.leading_comments(rows, "doc_id", "line_no", F.length("line") < 40)


@query("select event_id, lag(event_id) over w as previous_id, lead(event_id) over w as next_id from events where event_type = 'purchase' window w as (partition by user_id order by ts, event_id)")
def W06_boundaries(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select("event_id", F.lag("event_id").over(w).alias("previous_id"), F.lead("event_id").over(w).alias("next_id"))


@query(f"with {LINES} select doc_id, line_no, line from lines")
def S03_source_lines(spark, d):
    return corpus.lines(table(spark, d, "documents"), "doc_id", "text")


@query(f"""with {LINES}, f as (select doc_id, count(*) filter (length(line) >= 73) as n, count(*) filter (length(line) >= 73 and regexp_matches(substr(line, 73, 8), '^[0-9 ]*$')) as ok,
count(*) filter (length(line) > 4) as n4, count(*) filter (length(line) > 4 and regexp_matches(substr(line, 1, 4), '^[0-9]{{4}}$')) as ok4 from lines group by doc_id)
select doc_id, n >= 5 and ok >= 0.9 * n as trailing, case when n4 >= 5 and ok4 >= 0.9 * n4 then 4 else 0 end as leading from f""")
def S05_sequence_columns(spark, d):
    return corpus.sequence_columns(corpus.lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "line")


KEYWORDS = [("germanic", " (?:der|die|und) "), ("romance", " (?:que|de|le) "), ("english", " (?:the|of|and) ")]


@query("""with s as (select doc_id, lang, text, len(regexp_extract_all(coalesce(text, ''), ' (?:der|die|und) ')) as a, len(regexp_extract_all(coalesce(text, ''), ' (?:que|de|le) ')) as b, len(regexp_extract_all(coalesce(text, ''), ' (?:the|of|and) ')) as c from documents),
r as (select *, greatest(a, b, c) as top, a + b + c - greatest(a, b, c) - least(a, b, c) as second from s)
select doc_id, case when top = 0 then 'unknown' when a = top then 'germanic' when b = top then 'romance' else 'english' end as dialect, top as score, top > 0 and top < 2 * second as ambiguous from r""")
def S08_detect_dialect(spark, d):
    return corpus.detect_dialect(table(spark, d, "documents"), "text", None, KEYWORDS).select("doc_id", "dialect", "score", "ambiguous")


@query(f"""with {LINES}, b as (select *, length(line) < 20 as banner from lines), s as (select *, sum(case when banner then 1 else 0 end) over (partition by doc_id order by line_no)::bigint as segment from b)
select doc_id, line_no as pos, segment, row_number() over (partition by doc_id, segment order by line_no) as line_no from s""")
def S11_split_members(spark, d):
    rows = corpus.lines(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("line_no", "pos")
    return structure.segments(rows, "doc_id", "pos", F.length("line") < 20).select("doc_id", "pos", "segment", "line_no")


@query(f"""with {LINES}, b as (select *, length(line) < 20 as banner from lines), s as (select *, sum(case when banner then 1 else 0 end) over (partition by doc_id order by line_no)::bigint as segment from b),
m as (select *, max(case when segment = 0 and length(line) > 200 then 1 else 0 end) over (partition by doc_id) as code0, max(segment) over (partition by doc_id) as more from s),
t as (select doc_id, line_no as pos, case when segment = 0 and code0 = 0 and more > 0 then 1 else segment end as segment from m)
select doc_id, pos, segment, row_number() over (partition by doc_id, segment order by pos) as line_no from t""")
def S12_merge_preambles(spark, d):
    rows = corpus.lines(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("line_no", "pos")
    out = structure.merge_preambles(structure.segments(rows, "doc_id", "pos", F.length("line") < 20), "doc_id", "pos", F.length("line") > 200)
    return out.select("doc_id", "pos", "segment", "line_no")


@query("select doc_id, sha256(coalesce(text, '')) as sha, case when length(coalesce(text, '')) > 1000 then 'large' else 'small' end as size_class from documents")
def S14_content_hash(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha"), F.when(F.length(t) > 1000, "large").otherwise("small").alias("size_class"))


@query(f"with {CITED} select doc_id, ord, citation, member, from_line, to_line from claims")
def V02_citations(spark, d):
    return synthetic_claims(spark, d)


@query(f"""with {CITED}, {LINES}, last as (select 'D' || doc_id as u, max(line_no) as last_line from lines group by 1),
v as (select doc_id, u is not null and not coalesce(greatest(from_line, to_line) > last_line or least(from_line, to_line) < 1, false) as valid from claims left join last on member = u),
b as (select doc_id, count(*) as c, count(*) filter (not valid) as bad from v group by 1)
select count(*) as documents, count(*) filter (bad = 0) as ok, sum(c)::bigint as citations, sum(bad)::bigint as bad from b""")
def V07_tree_rollup(spark, d):
    return validate.rollup(J12_check_citations(spark, d).select(F.col("doc_id").alias("doc"), "valid"))


@query()
def V04_logical_units(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(validate.logical_units(F.col("text"))).alias("ord", "unit"))


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"


@query(f"select doc_id, regexp_replace(regexp_replace(text, '{EMAIL}', '[REDACTED]', 'g'), '[0-9]{{9,}}', '[REDACTED]', 'g') as text from documents")
def F01_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.redact(F.col("text"), [EMAIL, "[0-9]{9,}"]).alias("text"))


@query("select doc_id, substr(sha256(doc_id || chr(0) || source || chr(0) || lang), 1, 16) as sample_id from documents")
def F02_sample_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.sample_id(F.col("doc_id"), F.col("source"), F.col("lang")).alias("sample_id"))


@query("select source, doc_id from documents qualify row_number() over (partition by source order by sha256('seed7' || doc_id)) <= 3")
def F03_hash_sample(spark, d):
    return tx.hash_sample(table(spark, d, "documents").select("source", "doc_id"), "source", F.col("doc_id"), "seed7", 3)


@query("select doc_id, quality from labels where doc_id % 2 = 0 union all select doc_id, toxic from labels where doc_id % 2 = 1 and doc_id % 5 = 0")
def F06_merge_unseen(spark, d):
    rows = table(spark, d, "labels")
    return upsert.merge_unseen(rows.where("doc_id % 2 = 0").select("doc_id", "quality"), rows.where("doc_id % 5 = 0").select("doc_id", F.col("toxic").alias("quality")), "doc_id")


@query("""with e as (select sha256(doc_id || chr(0) || coalesce(text, '')) as h from documents), g as (select substr(h, 1, 2) as g, sha256(string_agg(h, '' order by h)) as h from e group by 1)
select sha256(string_agg(h, '' order by g) || chr(0) || 'policy') as signature from g""")
def F07_corpus_signature(spark, d):
    return tx.signature(table(spark, d, "documents"), ["doc_id", "text"], ["policy"])


@query("select p_partkey, case when p_partkey % 3 = 0 then printf('[[%s:%d]]', p_brand, p_size) else printf('[[%s:%d-%d]]', p_brand, p_size, p_size + p_partkey % 3) end as citation from part")
def F08_cite(spark, d):
    return parts(spark, d).select("p_partkey", tx.cite(F.col("p_brand"), F.col("p_size"), F.col("p_size") + F.col("p_partkey") % 3).alias("citation"))


@query("select doc_id, n_name from documents join nation on contains(lower(text), lower(substr(n_name, 1, 4)))")
def F09_lexicon_hits(spark, d):
    terms = table(spark, d, "nation").select("n_name", F.lower(F.substring("n_name", 1, 4)).alias("term"))
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    return docs.join(terms, F.contains("t", "term")).select("doc_id", "n_name")  # a small dimension on one side


@query("select doc_id, replace(text, '|', '\\|') as cell from documents where contains(text, '|')")
def F10_escape_cells(spark, d):
    return table(spark, d, "documents").where(F.contains("text", F.lit("|"))).select("doc_id", tx.escape_cell(F.col("text")).alias("cell"))


@query("""select doc_id, sha256(coalesce(text, '')) as sha from documents where doc_id % 5 = 0 or doc_id % 7 = 0""")
def I01_changed(spark, d):
    now = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    before = now.where("doc_id % 7 <> 0").withColumn("sha", F.when(F.col("doc_id") % 5 == 0, F.lit("stale")).otherwise(F.col("sha")))
    return incremental.changed(now, before, "doc_id", "sha")


@query("""select doc_id, case when doc_id % 7 = 0 then 'add' when doc_id % 5 = 0 then 'change' when doc_id % 11 = 0 then 'remove' else 'keep' end as action from documents""")
def I02_change_plan(spark, d):
    all_ = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    now = all_.where("doc_id % 11 <> 0 or doc_id % 7 = 0 or doc_id % 5 = 0")
    before = all_.where("doc_id % 7 <> 0").withColumn("sha", F.when(F.col("doc_id") % 5 == 0, F.lit("stale")).otherwise(F.col("sha")))
    return incremental.plan(now, before, "doc_id", "sha")


@query("""select doc_id, case when doc_id % 7 = 0 then 'new' when doc_id % 5 = 0 then 'corpus' when doc_id % 3 = 0 then 'brief' else 'skip' end as reason from documents""")
def I03_two_tier_skip(spark, d):
    now = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("brief"))
    state = now.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("brief")).alias("brief"), F.when(F.col("doc_id") % 5 == 0, F.lit("s0")).otherwise(F.lit("s1")).alias("signature"))
    return incremental.two_tier(now, state, "doc_id", "brief", "s1").select("doc_id", "reason")
