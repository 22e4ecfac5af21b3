"""Queries that run the line scanners over sources built from the tables, with the facts that each source holds in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import scanners
from lodestrata.plans.queries import query, table
from lodestrata.sources import corpus


def scanned(spark, d, dialect: str, text: str, kind: str = "program") -> DataFrame:
    """The facts of one member a customer, whose text is the SQL expression `text` over its number n."""
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("n"))
    members = members.select(F.concat(F.lit("M"), "n").alias("name"), F.lit(dialect).alias("dialect"), F.lit(kind).alias("object_type"), F.expr(text).alias("text"))
    return scanners.scan(members)


NATURAL = """concat('DEFINE DATA\\nLOCAL\\n1 V VIEW OF FILE', n % 5, '\\nEND-DEFINE\\n',
case n % 4 when 0 then 'READ V BY KEY' when 1 then 'FIND V WITH KEY = 1' when 2 then 'GET V #ISN' else 'HISTOGRAM V KEY' end,
'\\nSTORE LOG', n % 3, case n % 2 when 0 then '\\nUPDATE V' else '' end, '\\nEND TRANSACTION\\nREAD WORK FILE ', n % 7, ' #A\\nEND')"""


@query("""with m as (select c_custkey as n, 'M' || c_custkey as member from customer)
select member, 5::bigint as line_no, case n % 4 when 0 then 'READ' when 1 then 'FIND' when 2 then 'GET' else 'HISTOGRAM' end as verb, 'FILE' || n % 5 as entity, 'R' as crud, case when n % 4 < 2 then 'KEY' end as by_key from m
union all select member, 6, 'STORE', 'LOG' || n % 3, 'C', null from m
union all select member, 7, 'UPDATE', 'FILE' || n % 5, 'U', null from m where n % 2 = 0
union all select member, case when n % 2 = 0 then 9 else 8 end, 'READ WORK', 'WORKFILE-' || n % 7, 'R', null from m""")
def X06_natural_access(spark, d):
    rows = scanners.facts_of(scanned(spark, d, "natural", NATURAL), "access")
    return rows.select("member", "line_no", "verb", F.col("name").alias("entity"), F.col("kind").alias("crud"), F.col("detail").alias("by_key"))


@query("""select 'M' || c_custkey as member, case c_custkey % 3 when 0 then 'structured' when 1 then 'reporting' else 'unknown' end as mode from customer""")
def X15_mode(spark, d):
    rows = scanned(spark, d, "natural", "concat('READ X', case n % 3 when 0 then '\\nIF A = 1\\nEND-IF' when 1 then '\\nLOOP\\n  WRITE A' else '\\nWRITE A' end)")
    return scanners.facts_of(rows, "metric").where("name = 'mode'").select("member", F.col("detail").alias("mode"))


@query("""with m as (select c_custkey as n, 'M' || c_custkey as member from customer)
select member, 3::bigint as line_no, 1 as depth from m where n % 2 = 0 union all select member, 5, 0 from m where n % 2 = 0
union all select member, 3, 0 from m where n % 2 = 1 union all select member, 5, 1 from m where n % 2 = 1""")
def X16_loop_depth(spark, d):
    """Depth of the two IF lines: inside and after an indented loop (even members), or with indents that show nothing (odd ones)."""
    text = "if(n % 2 = 0, 'WRITE A\\nLOOP\\n  IF A = 1\\n    MOVE 1 TO B\\nIF C = 2', 'WRITE A\\nLOOP\\nIF A = 1\\nMOVE 1 TO B\\nIF C = 2')"
    return scanners.facts_of(scanned(spark, d, "natural", text), "rule").where("verb = 'IF'").select("member", "line_no", "depth")


@query("""with m as (select c_custkey as n, 'M' || c_custkey as member from customer)
select member, 2::bigint as line_no, 'access' as fact, 'GET' as verb, 'REC' || n % 7 as name, 'R' as kind, 0 as depth from m
union all select member, 3, 'rule', case n % 2 when 0 then 'IF' else 'WHILE' end, null, null, 0 from m
union all select member, 4, 'call', 'CALL', 'SUB' || n % 11, 'CALL', 1 from m
union all select member, 6, 'transaction', case n % 3 when 0 then 'COMMIT' when 1 then 'ENDTRAN' else 'SINOF' end, null, case n % 3 when 0 then 'COMMIT' when 1 then 'ENDTR' else 'SIGNOFF' end, 0 from m""")
def X17_mantis(spark, d):
    text = """concat('% a comment\\nGET REC', n % 7, '\\n', case n % 2 when 0 then 'IF' else 'WHILE' end, ' A = 1\\n.CALL "SUB', n % 11, '"\\nEND\\n', case n % 3 when 0 then 'COMMIT' when 1 then 'ENDTRAN' else 'SINOF' end)"""
    rows = scanned(spark, d, "mantis", text).where("fact in ('access', 'rule', 'call', 'transaction')")
    return rows.select("member", "line_no", "fact", "verb", "name", "kind", "depth")


@query("""with m as (select c_custkey as n, 'M' || c_custkey as member from customer)
select member, 2::bigint as line_no, 'AA' as field, 'A' as format, (n % 9 + 1)::varchar as length, 'DE' as descriptor, 1 as level from m
union all select member, 3, 'AB', 'MU', (n % 4 + 1)::varchar, null, 2 from m""")
def X20_fdt(spark, d):
    text = "concat('FIELD DEFINITION TABLE\\n 1 AA ', n % 9 + 1, ' A DE,NU\\n 2 AB ', n % 4 + 1, ' P MU')"
    rows = scanners.facts_of(scanned(spark, d, "adabas_fdt", text), "field")
    return rows.select("member", "line_no", F.col("name").alias("field"), F.col("kind").alias("format"), F.col("detail").alias("length"), F.col("verb").alias("descriptor"), F.col("depth").alias("level"))


@query("""with m as (select c_custkey as n, 'M' || c_custkey as member from customer)
select member, 2::bigint as line_no, 'A' as field, 'INTEGER' as format, null as length, 'NOT NULL' as required from m
union all select member, 3, 'B', 'CHAR', (n % 9 + 1)::varchar, null from m""")
def X23_ddl(spark, d):
    text = "concat('CREATE TABLE T', n, ' (\\n  A INTEGER NOT NULL,\\n  B CHAR(', n % 9 + 1, '),\\n  PRIMARY KEY (A)\\n);')"
    rows = scanners.facts_of(scanned(spark, d, "sql_ddl", text), "field")
    return rows.select("member", "line_no", F.col("name").alias("field"), F.col("kind").alias("format"), F.col("detail").alias("length"), F.col("verb").alias("required"))


@query("""with m as (select c_custkey as n, 'M' || c_custkey as member from customer)
select member, 1::bigint as line_no, 'REC' as field, null as format, null as length from m
union all select member, 2, 'AMT', 'P', (n % 7 + 1) || '.2' from m union all select member, 3, 'NAM', 'A', (n % 20 + 1)::varchar from m""")
def X24_copybook(spark, d):
    text = "concat('       01 REC.\\n          05 AMT PIC S9(', n % 7 + 1, ')V99 COMP-3.\\n          05 NAM PIC X(', n % 20 + 1, ').')"
    rows = scanners.facts_of(scanned(spark, d, "cobol_copybook", text), "field")
    return rows.select("member", "line_no", F.col("name").alias("field"), F.col("kind").alias("format"), F.col("detail").alias("length"))


@query("""with m as (select c_custkey as n from customer)
select 'F' || n as path, 'ONE' || n as name, 1::bigint as first_line, '* why' || chr(10) || 'READ A' as text, 'program' as object_type from m
union all select 'F' || n, 'TWO' || n, 5, 'READ B', case n % 2 when 0 then 'subprogram' else 'map' end from m where n % 3 > 0""")
def S11_split_members(spark, d):
    """Files of one or two members behind banners, after a comment that goes with the first."""
    text = """concat('* why\\n---ONE', n, ' (P)---\\nREAD A', if(n % 3 > 0, concat('\\n---TWO', n, ' (', if(n % 2 = 0, 'N', 'M'), ')---\\nREAD B'), ''))"""
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("n"))
    files = files.select(F.concat(F.lit("F"), "n").alias("path"), F.concat(F.lit("F"), "n").alias("name"), F.lit("natural").alias("dialect"), F.lit("auto").alias("sequence"), F.expr(text).alias("text"))
    out = corpus.split_members(files)
    kind = corpus.infer_type(F.col("text"), F.col("path"), F.lit("natural"), F.col("code"))
    return out.select("path", "name", "first_line", "text", kind.alias("object_type"))
