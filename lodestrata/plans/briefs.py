"""Briefs and registers over a fact store: each is made for all members or entities at once, as rows (report, section, ord, text).

Sections stand in a fixed order and only where they have rows; every row cites its line. reports.whole() joins a report's rows.
A report is of one member or entity; the system brief alone has one report, whose rows are counts, entry points and the like.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import cite, escape_cell, redact
from lodestrata.operators import measures, resolve, structure, testplan
from lodestrata.plans.derive import FactStore, coverage
from lodestrata.plans.reports import batchable, report, section, whole


def _here() -> Column:
    return F.when(F.col("line_no").isNotNull(), cite(F.col("member"), F.col("line_no"))).otherwise(F.concat(F.lit("[["), F.col("member"), F.lit("]]")))


def _row(*parts: Column | str) -> Column:
    return F.concat(F.lit("- "), F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _code(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull() & (c != ""), F.concat(F.lit("`"), c, F.lit("`")))


def numbered_rules(store: FactStore) -> DataFrame:
    return structure.rule_ids(store["rule_candidate"], "member", ["line_no", "verb", "detail"])


def ambiguous_names(store: FactStore) -> DataFrame:
    """member, libraries: names that several members hold; they get no brief of their own."""
    held = resolve.name_holders(store["member"], "name", "library").where("ambiguous")
    return held.select(F.col("member_name").alias("member"), "libraries")


def gaps_of(store: FactStore) -> DataFrame:
    """member, line_no, kind, severity, detail of all gaps."""
    told = store["gap"].select("member", "line_no", "kind", F.col("verb").alias("severity"), "detail")
    derived = store["derived_gap"].select("member", F.lit(None).cast("long").alias("line_no"), "kind", "severity", "detail")
    return told.unionByName(derived).unionByName(store["ingest_gap"].select("member", F.lit(None).cast("long").alias("line_no"), "kind", "severity", F.lit("").alias("detail")))


def module_briefs(store: FactStore, patterns: list[str] | None = None, lexicon: Mapping[str, str] | None = None) -> DataFrame:
    """One report a member: 14 sections from its header facts to its gaps."""
    hide = lambda c: redact(F.col(c), patterns or [], bool(patterns))
    members = store["member"].join(ambiguous_names(store), F.upper("name") == F.col("member"), "left_anti").withColumn("member", F.col("name"))
    only = lambda df: df.join(members.select("member"), "member", "left_semi")
    count = store["source_line"].groupBy("member").agg(F.count("*").alias("lines"))
    mode = store["metric"].where("name = 'mode'").select("member", F.col("detail").alias("mode"))
    known = members.join(count, "member", "left").join(mode, "member", "left")
    facts = F.array(*[F.format_string(f"- {t}: %s", F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for t, c in (("system", "system"), ("dialect", "dialect"), ("object_type", "object_type"), ("library", "library"), ("mode", "mode"), ("line_count", "lines"))])
    head = known.select("member", F.posexplode(facts).alias("n", "t"))
    comments = structure.leading_comments(only(store["source_line"]), "member", "line_no", F.col("line").rlike(r"^\s*(?:[*%!]|/\*|//\*|$)"))
    comments = comments.withColumn("said", F.trim(F.regexp_replace("line", r"^[\s*/%!]+|[\s*/]+$", ""))).where(F.length("said") > 3)
    calls = only(store["resolved_edge"].withColumnRenamed("callee", "name"))
    tag = F.when(F.col("dynamic"), "**[dynamic target]**").when(F.col("kind") == "PERFORM_INTERNAL", "(internal)").when(~F.col("resolved"), "**[source not supplied]**")
    inbound = store["resolved_edge"].select(F.upper("callee").alias("member"), F.col("member").alias("caller"), F.col("line_no").alias("at"), "kind")
    rules = numbered_rules(store)
    taken = only(store["resolved_edge"].where("kind = 'INCLUDE' and resolved").select("member", F.upper("callee").alias("node")).distinct())
    copies = resolve.closures(taken.select(F.upper("member").alias("src"), F.col("node").alias("dst")), taken.select(F.upper("member").alias("member")).distinct())
    inherited = copies.select("member", "node").join(rules.withColumn("node", F.upper("member")).drop("member"), "node")
    rule = lambda who: _row(F.concat(F.lit("**"), F.col("rule_id"), F.lit("**")), cite(who, F.col("line_no")), F.format_string("depth %d", "depth"), _code("verb"), _code(hide("detail")))
    gaps = only(gaps_of(store))
    by_line = ["line_no", "verb", "name"]
    parts = [
        section(0, "Facts", head, ["n"], F.col("t"), "member"),
        section(2, "Header comments (an author's claims)", comments, ["line_no"], _row(_here(), _code(F.substring(hide("said"), 1, 160))), "member"),
        section(3, "Parameters", only(store["variable"].where(F.col("verb").isin("parameter", "ENTRY"))), by_line, _row(_here(), _code("name"), F.concat_ws("", "kind", "detail")), "member"),
        section(4, "Views", only(store["view"]), by_line, _row(_here(), _code("name"), "over", _code("detail")), "member"),
        section(5, "Data access", only(store["data_access"]), by_line, _row(_here(), _code("verb"), F.concat(F.lit("("), "kind", F.lit(") on")), _code(F.coalesce("name", F.lit("UNKNOWN"))), _code(hide("detail")), F.when(F.col("extra") == "unresolved", "**[unresolved]**")), "member"),
        section(6, "Transaction boundaries", only(store["transaction_marker"]), by_line, _row(_here(), _code("verb"), _code(hide("detail"))), "member"),
        section(7, "Outbound calls", calls, by_line, _row(_here(), _code("kind"), "->", _code("name"), tag), "member"),
        section(8, "Inbound callers", only(inbound), ["caller", "at", "kind"], _row(cite(F.col("caller"), F.col("at")), _code("kind"), "from", _code("caller")), "member"),
        section(9, "Interaction points", only(store["interaction"]), by_line, _row(_here(), _code("verb"), _code("name"), _code(F.substring(hide("detail"), 1, 90))), "member"),
        section(10, "Messages", only(store["message_ref"]), by_line, _row(_here(), _code("verb"), _code(F.substring(hide("detail"), 1, 120))), "member"),
        section(11, "Candidate rules", only(rules), ["line_no", "rule_id"], rule(F.col("member")), "member"),
        section(12, "Rules of included members", only(inherited), ["node", "line_no", "rule_id"], rule(F.col("node")), "member"),
        section(13, "Known gaps", gaps, [measures.by_severity(), "line_no", "kind", "detail"], _row(F.concat(F.lit("["), "severity", F.lit("]")), _here(), F.col("kind"), F.col("detail")), "member"),
    ]
    out = report(*parts)
    return with_vocabulary(out, lexicon) if lexicon else out


def with_vocabulary(rows: DataFrame, lexicon: Mapping[str, str]) -> DataFrame:
    """The reports with section 1: the given terms that occur in them."""
    terms = rows.sparkSession.createDataFrame(sorted(lexicon.items()), "term string, means string")
    hits = rows.join(F.broadcast(terms), F.contains(rows["text"], terms["term"])).select(F.col("report").alias("member"), "term", "means").distinct()  # the lexicon is given by hand
    return rows.unionByName(section(1, "Vocabulary", hits, ["term"], _row(_code("term"), "->", F.col("means")), "member"))


def entity_briefs(store: FactStore, lexicon: Mapping[str, str] | None = None) -> DataFrame:
    """One report an entity: its definition, fields, links and who uses it."""
    entities = store["entity"].where("name is not null").groupBy(F.upper("name").alias("entity")).agg(F.min_by(F.struct("kind", "member", "line_no"), F.struct("kind", "member", "line_no")).alias("d"))
    head = entities.select("entity", F.posexplode(F.array(F.concat(F.lit("- kind: "), F.coalesce("d.kind", F.lit("unknown"))), F.concat(F.lit("- definition: "), cite(F.col("d.member"), F.col("d.line_no"))))).alias("n", "t"))
    owner = store["entity"].where("verb is null or verb in ('CREATE', 'NAME')").select("member", F.upper("name").alias("of_member")).distinct()
    fields = store["entity_field"].withColumn("stated", F.upper(F.when(F.col("extra").rlike(r"^[A-Z][A-Z0-9#@$_.-]+$"), F.col("extra"))))
    whose = owner.groupBy("member").agg(F.min("of_member").alias("only"), F.count("*").alias("c")).where("c = 1")
    fields = fields.join(whose, "member", "left").withColumn("entity", F.coalesce(F.when(F.col("stated").isNotNull() & F.col("only").isNull(), F.col("stated")), "only", "stated")).where("entity is not null")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", F.coalesce(F.col("depth").cast("string"), F.lit("")), F.col("name"), *[escape_cell(F.coalesce(c, F.lit(""))) for c in ("kind", "detail", "verb", "extra")], _here()), F.lit(" |"))
    links = store["resolved_link"].select("member", "line_no", "verb", F.upper("name").alias("a"), F.upper("target_id").alias("b"))
    both = links.withColumn("entity", F.explode(F.array_distinct(F.array("a", "b")))).where("entity is not null")
    used = store["data_access"].where("name is not null").withColumn("entity", F.upper("name"))
    nobody = entities.join(used.select("entity"), "entity", "left_anti")
    out = report(
        section(0, "Definition", head, ["n"], F.col("t"), "entity"),
        section(2, "Fields", fields, ["line_no", "name"], cells, "entity"),
        section(3, "Relationships", both, ["member", "line_no", "a", "b"], _row(_here(), _code("a"), "--", F.col("verb"), "->", _code("b")), "entity"),
        section(4, "Accessed by", used, ["member", "line_no", "verb"], _row(_here(), _code("member"), _code("verb"), F.concat(F.lit("("), "kind", F.lit(")"))), "entity"),
        section(4, "Accessed by", nobody, ["entity"], F.lit("- no access in the source read"), "entity"),
    )
    return with_vocabulary(out, lexicon) if lexicon else out


def system_brief(store: FactStore) -> DataFrame:
    """One report: coverage, inventory, entry points, access matrix and the first 200 gaps of high severity."""
    kinds = store["member"].groupBy("dialect", F.coalesce("object_type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    steps = store["job_step"].where("name is not null").select("member", "line_no", _row(_here(), "step", _code("kind"), "runs", _code("name")).alias("t"))
    online = store["resource"].where("verb = 'TRANSACTION'").select("member", "line_no", _row(_here(), "transaction", _code("name"), _code(F.substring("detail", 1, 100))).alias("t"))
    high = gaps_of(store).where("severity = 'high'").orderBy("kind", "member", "line_no", "detail").limit(200)
    place = F.when(F.col("member").isNotNull(), _here())
    return report(
        section(0, "Coverage", coverage(store), ["metric"], F.format_string("- %s: %s", "metric", F.col("value").cast("string"))),
        section(1, "Members", kinds, ["dialect", "type"], F.format_string("| %s | %s | %d |", "dialect", "type", "n")),
        section(2, "Entry points", steps.unionByName(online), ["member", "line_no", "t"], F.col("t")),
        section(3, "Access matrix", store["crud"], ["member", "entity_name"], F.format_string("| %s | %s | %s | %s | %s |", "member", "entity_name", "crud", "verbs", cite(F.col("member"), F.col("first_line")))),
        section(4, "Gaps of high severity", high, ["kind", "member", "line_no", "detail"], _row(F.col("kind"), place, F.col("detail"))),
    )


def plan_tests(store: FactStore, member: str | None = None, overlay: DataFrame | None = None) -> DataFrame:
    """Rebuild test_case for all batchable members, or for one, and return (name, libraries) of those left out as ambiguous.

    Rows of other members, and of ambiguous ones from an earlier run, stay as they are.
    """
    doubtful = ambiguous_names(store)
    clear = batchable(store["member"]).join(doubtful, F.upper("name") == F.col("member"), "left_anti").select(F.col("name").alias("member")).distinct()
    if member:
        clear = clear.where(F.upper("member") == member.upper())
    rules = store["rule_candidate"].join(clear, "member", "left_semi")
    numbered = structure.rule_ids(rules, "member", ["line_no", "verb", "detail"])
    branch = F.upper("verb").rlike(testplan.BRANCHES)
    level = F.when(F.upper("verb") == "ELSE", F.greatest(F.col("depth") - 1, F.lit(0))).otherwise(F.col("depth"))  # an ELSE ends its IF
    ends = structure.branch_ends(numbered.withColumns({"header": branch, "depth": level}), "member", "line_no", "depth", "header").select("member", "line_no", "body_end").dropDuplicates(["member", "line_no"])
    last = store["source_line"].groupBy("member").agg(F.max("line_no").alias("last"))
    cases = numbered.where(branch).join(ends, ["member", "line_no"], "left").join(last, "member", "left")
    cases = cases.select("member", F.col("rule_id").alias("scenario"), "line_no", F.col("verb").alias("construct"), F.col("detail").alias("condition"), F.coalesce("body_end", "last").alias("body_end"))
    span = cases.where("body_end > line_no").select("member", "scenario", F.explode(F.sequence(F.col("line_no") + 1, F.col("body_end"))).alias("line_no"))
    text = span.join(store["source_line"].select("member", "line_no", "line"), ["member", "line_no"]).groupBy("member", "scenario")
    text = text.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("excerpt"))
    mocks = testplan.mock_targets(store["data_access"], store["resolved_edge"].where("not dynamic"), "member", "name", "callee", "kind")
    cases = cases.join(text, ["member", "scenario"], "left").join(mocks, "member", "left")
    cases = testplan.overlay_status(cases, overlay, "scenario") if overlay is not None else cases.withColumn("status", F.lit("characterization"))
    cases = cases.withColumns({"citation": cite(F.col("member"), F.col("line_no")), "excerpt": F.coalesce("excerpt", F.lit(""))})
    cases = cases.select("member", "scenario", "line_no", "construct", "condition", "body_end", "excerpt", "entities", "callees", "status", "citation")
    if store.has("test_case"):
        old = store["test_case"].join(clear, "member", "left_anti")
        old = old if member else old.join(doubtful, F.upper(old["member"]) == doubtful["member"], "left_semi")
        cases = cases.unionByName(old)
    store["test_case"] = cases
    return doubtful


def test_plan_register(store: FactStore) -> DataFrame:
    """report (the member) rows: one table row a scenario."""
    cell = lambda c: escape_cell(F.coalesce(c, F.lit("")))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "scenario", "member", "status", "construct", cell("condition"), "citation"), F.lit(" |"))
    return section(1, "Scenarios", store["test_case"], ["line_no", "scenario"], row, "member")


def test_case_briefs(store: FactStore) -> DataFrame:
    """One report a member: parameters, what to stand in for, and each scenario with what the source does."""
    cases = store["test_case"]
    takes = store["variable"].where(F.col("verb").isin("parameter", "ENTRY")).join(cases.select("member"), "member", "left_semi")
    mocks = cases.select("member", "entities", "callees").distinct()
    mocks = mocks.select("member", F.explode(F.concat(*[F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != ""), lambda x, k=k: F.concat(F.lit(f"- {k}: "), x)) for c, k in (("entities", "entity"), ("callees", "callee"))])).alias("t"))
    seen = F.when(F.col("excerpt") != "", F.concat(F.lit("\n- the source then does:\n"), F.col("excerpt"))).otherwise(F.lit("\n- what follows is not in the source read"))
    text = F.concat(F.format_string("### %s (%s) %s\n- construct: %s", "scenario", "status", "citation", "construct"), F.coalesce(F.concat(F.lit("\n- condition: "), F.col("condition")), F.lit("")), seen)
    return report(
        section(1, "Parameters", takes, ["line_no", "name"], _row(_here(), _code("name"), F.concat_ws("", "kind", "detail")), "member"),
        section(2, "To stand in for", mocks, ["t"], F.col("t"), "member"),
        section(3, "Scenarios", cases, ["line_no", "scenario"], text, "member"),
    )


def advise(store: FactStore) -> DataFrame:
    """testability of every batchable member of one name, from its calls, accesses and scopes; also kept in the store."""
    members = batchable(store["member"]).join(ambiguous_names(store), F.upper("name") == F.col("member"), "left_anti").select(F.col("name").alias("member")).distinct()
    outward = ~F.col("kind").isin(*testplan.INTERNAL)
    calls = store["resolved_edge"].groupBy("member").agg(F.max(F.col("dynamic") & outward).alias("dyn"), F.max(outward & ~F.col("resolved") & ~F.col("dynamic")).alias("lost"), F.count_if(outward).alias("calls"))
    wide = store["transaction_scope"].groupBy("member", "boundary").agg(F.count_distinct("entity").alias("e")).groupBy("member").agg(F.max("e").alias("most"))
    data = store["data_access"].groupBy("member").agg(F.count_distinct("name").alias("data"))
    rows = members.join(calls, "member", "left").join(wide, "member", "left").join(data, "member", "left").fillna({"dyn": False, "lost": False, "calls": 0, "most": 0, "data": 0})
    rows = testplan.classify(rows, F.col("dyn"), F.col("lost"), F.col("most"), F.col("calls") + F.col("data"))
    store["testability"] = rows.select("member", "testability")
    return store["testability"]


def testability_report(store: FactStore) -> DataFrame:
    """One report a class: its members with their seams and gaps."""
    kinds = advise(store)
    edges = store["resolved_edge"].where(~F.col("kind").isin(*testplan.INTERNAL))
    first = testplan.seams(edges, "member", "callee", "line_no", "dynamic").withColumn("t", F.format_string("seam: callee %s at %s", "callee", cite(F.col("member"), F.col("first_line")))).select("member", F.lit(1).alias("o"), "t")
    data = store["data_access"].where("name is not null").groupBy("member", "name").agg(F.min("line_no").alias("l")).withColumn("t", F.format_string("seam: entity %s at %s", "name", cite(F.col("member"), F.col("l"))))
    gaps = edges.withColumn("t", testplan.gap_text(F.col("callee"), F.col("dynamic"), F.col("resolved"))).where("t is not null").withColumn("t", F.concat(F.lit("gap: "), F.col("t"), F.lit(" "), _here()))
    heads = kinds.select("member", F.lit(0).alias("o"), F.col("member").alias("t"))
    rows = heads.unionByName(first).unionByName(data.select("member", F.lit(1).alias("o"), "t")).unionByName(gaps.select("member", F.lit(2).alias("o"), "t").distinct())
    rows = rows.join(kinds, "member")
    return section(1, "Members", rows, ["member", "o", "t"], F.concat(F.when(F.col("o") == 0, F.lit("### ")).otherwise(F.lit("- ")), F.col("t")), "testability")


def text_of(rows: DataFrame, name: str | None = None) -> str | None:
    """The text of one report; None if there is no such report."""
    found = whole(rows if name is None else rows.where(F.upper("report") == name.upper())).first()
    return found["text"] + "\n" if found else None
