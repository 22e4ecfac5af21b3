"""Ingest with members in one file, skips, reports, test plans and validation over one small project."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata import cli
from lodestrata.operators import resolve
from lodestrata.operators import scanners as S
from lodestrata.plans import briefs, documents
from lodestrata.plans import derive as plans

TWO = """* who wrote this, and why
* MEMBER: PAY100
* pays the orders of a day
DEFINE DATA
PARAMETER
1 #DAY (N8)
LOCAL
1 ORD VIEW OF ORDERS
END-DEFINE
READ ORD BY KEY
IF STATUS = 'O'
  UPDATE ORD
  CALLNAT 'LOG200'
ELSE
  ESCAPE TOP
END-IF
END-READ
END TRANSACTION
* MEMBER: LOG200
DEFINE DATA PARAMETER
END-DEFINE
FETCH #NEXT
STORE LOGFILE"""
DDL = "CREATE TABLE ORDERS (\n  KEY INTEGER NOT NULL,\n  STATUS CHAR(1),\n  PRIMARY KEY (KEY)\n);"


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    src, lib = root / "src", root / "lib"
    src.mkdir(), lib.mkdir()
    (src / "BATCH.txt").write_text(TWO)
    (src / "SEQ.nsp").write_text("\n".join(f"{t:<72}{n:08d}" for n, t in enumerate(["WRITE 'A'", "WRITE 'B'", "WRITE 'C'", "WRITE 'D'", "WRITE 'E'", "END"])))
    (lib / "orders.sql").write_text(DDL)
    (root / "project.yml").write_text(f"sources:\n- path: {src}\n  glob: ['*.txt', '*.nsp']\n  dialect: natural\n  library: PAYLIB\n- path: {lib}\n  glob: '*.sql'\noptions:\n  lexicon: {{ORDERS: customer orders}}\n")
    run = lambda *a: cli.main(["--store", str(root / "store"), "--config", str(root / "project.yml"), *a], spark)
    assert run("ingest") == 0 and run("derive") == 0
    return root, run, plans.FactStore(spark, str(root / "store"))


def test_a_file_of_two_members(project):
    _, _, store = project
    found = {(r.name, r.dialect, r.object_type, r.library, r.first_line) for r in store["member"].collect()}
    assert found == {("PAY100", "natural", "subprogram", "PAYLIB", 1), ("LOG200", "natural", "subprogram", "PAYLIB", 20), ("SEQ", "natural", "program", "PAYLIB", 1), ("ORDERS", "sql_ddl", "ddl", None, 1)}
    lines = {(r.member, r.line_no): r.line for r in store["source_line"].collect()}
    assert lines["PAY100", 1] == "* who wrote this, and why" and lines["PAY100", 2] == "* pays the orders of a day" and lines["LOG200", 1] == "DEFINE DATA PARAMETER"
    assert lines["SEQ", 1] == "WRITE 'A'"
    assert store["resolved_edge"].where("callee = 'LOG200' and resolved").count() == 1
    gaps = {(r.kind, r.detail) for r in store["derived_gap"].collect()}
    assert ("no_ddl_for_entity", "LOGFILE") in gaps and ("no_ddl_for_entity", "ORDERS") not in gaps
    assert ("sme_question", "writes without a transaction marker") in gaps


def test_kept_files_are_not_read_again(project, capsys):
    root, run, store = project
    before = sorted(map(str, store["facts"].collect()))
    assert run("ingest") == 0 and capsys.readouterr().out == "keep: 3\n"
    assert sorted(map(str, store["facts"].collect())) == before
    (root / "src" / "NEW.nsp").write_text("CALLNAT 'PAY100'\nEND")
    (root / "lib" / "orders.sql").write_text(DDL.replace("STATUS", "STATE"))
    assert run("ingest") == 0 and capsys.readouterr().out == "add: 1\nchange: 1\nkeep: 2\n"
    assert {r.name for r in store["entity_field"].collect()} == {"KEY", "STATE"} and store["member"].count() == 5
    (root / "src" / "NEW.nsp").unlink()
    (root / "lib" / "orders.sql").write_text(DDL)
    assert run("ingest") == 0 and run("derive") == 0
    assert sorted(map(str, store["facts"].collect())) == before


def test_briefs(project, capsys):
    _, run, store = project
    assert run("brief", "--module", "pay100") == 0
    out = capsys.readouterr().out
    for part in ("- object_type: subprogram", "- line_count: 17", "[[PAY100:2]] `pays the orders of a day`", "`#DAY` N8", "`ORD` over `ORDERS`", "[[PAY100:11]] `UPDATE`", "`CALLNAT` -> `LOG200`", "**PAY100:BR-001** [[PAY100:10]]", "`ORDERS` -> customer orders"):
        assert part in out, part
    assert out.index("## Facts") < out.index("## Vocabulary") < out.index("## Data access") < out.index("## Candidate rules")
    assert run("brief", "--module", "LOG200") == 0
    out = capsys.readouterr().out
    assert "`CALLNAT` from `PAY100`" in out and "**[dynamic target]**" in out and "[high]" in out
    assert run("brief", "--entity", "orders") == 0
    out = capsys.readouterr().out
    assert "kind: sql_table" in out and "| KEY | INTEGER" in out and "`PAY100` `UPDATE` (U)" in out
    assert run("brief", "--system") == 0 and "| PAY100 | ORDERS | R,U |" in capsys.readouterr().out
    assert run("brief", "--module", "NOBODY") == 1
    one, two = (briefs.text_of(briefs.module_briefs(store), "PAY100") for _ in range(2))
    assert one == two
    assert run("rules-register") == 0 and "PAY100:BR-001" in capsys.readouterr().out


def test_test_plan(project, capsys):
    root, run, store = project
    overlay = root / "overlay.json"
    overlay.write_text(json.dumps({"scenario": "PAY100:BR-001", "review_status": "signed_off", "status": "confirmed"}))
    assert run("test-plan", "--overlay", str(overlay)) == 0
    out = capsys.readouterr().out
    assert "| PAY100:BR-001 | PAY100 | confirmed | IF |" in out
    cases = {r.scenario: r for r in store["test_case"].collect()}
    assert cases["PAY100:BR-001"].excerpt == "  UPDATE ORD\n  CALLNAT 'LOG200'" and cases["PAY100:BR-001"].entities == "ORDERS"
    before = sorted(map(str, cases.values()))
    assert run("test-plan", "--member", "log200") == 0 and sorted(map(str, store["test_case"].collect())) == before  # others stay
    assert run("test-brief", "PAY100") == 0 and "### PAY100:BR-001 (confirmed) [[PAY100:10]]" in capsys.readouterr().out
    assert run("test-advisory") == 0
    out = capsys.readouterr().out
    assert "# untestable-gap\n## Members\n### LOG200" in out and "# needs-mock" in out and "seam: entity ORDERS at [[PAY100:9]]" in out


def test_validation_and_samples(project, capsys):
    root, run, store = project
    docs = root / "docs"
    docs.mkdir()
    head = "---\ntitle: t\ndoc_type: module\nmodule: PAY100\nstatus: draft\n---\n"
    (docs / "good.md").write_text(head + "The program reads orders [[PAY100:9]]. It updates them [[PAY100:11-12]].\n")
    (docs / "bad.md").write_text(head + "The program prints [[PAY100:99]]. It also sings in the evening.\n")
    (docs / "README.md").write_text("The program is not looked at.")
    assert run("validate", str(docs)) == 1
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 2 and out[0].startswith("FAIL") and "1 invalid, 1 uncited" in out[0] and out[1].startswith("ok")
    (docs / "t.md").write_text("covers PAY100:BR-001 and PAY100:BR-099")
    assert run("test-validate", str(docs)) == 1 and "PAY100:BR-099" in capsys.readouterr().out
    assert run("sample-citations", str(docs), "--n", "2") == 0
    samples = {r.claim: r for r in store["citation_sample"].collect()}
    assert samples["It updates them ."].source == "  UPDATE ORD\n  CALLNAT 'LOG200'"
    verdicts = root / "v.json"
    verdicts.write_text("\n".join(json.dumps({"id": r.id, "accurate": r.claim.startswith("It")}) for r in samples.values()))
    assert run("sample-citations", "--judge", "llm", "--verdicts", str(verdicts)) == 1
    assert run("sample-citations", "--judge", "human", "--verdicts", str(verdicts)) == 0
    assert run("sample-citations", "--judge", "llm", "--verdicts", str(verdicts)) == 0
    got = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert got["samples"] == len(samples) == 3 and got["human"] == pytest.approx(1 / 3) and got["agreement"] == 1.0
    assert {r.metric: r.value for r in plans.coverage(store).collect()}["citation_accuracy_rate"] == pytest.approx(1 / 3)
    assert documents.claim_pairs(documents.read_docs(store.spark, str(docs))).where(F.col("claim").startswith("The program reads")).first()["citations"] == "[[PAY100:9]]"


def test_reporting_mode():
    deep = ["READ X", "LOOP", "  IF A = 1", "    DO", "    MOVE 1 TO B", "  WRITE 'X'", "IF C = 2", "END"]
    assert S.natural_mode(deep) == "reporting" and S.indented_loops(deep) == {2: 0}
    rules = [(r[0], r[6]) for r in S.scan_natural(deep).rows if r[1] == "rule" and r[2] == "IF"]
    assert rules[0] == (3, 2) and rules[1][0] == 7 and rules[1][1] < 3  # inside the loop, then after it
    flat = ["LOOP", "IF A = 1", "END"]
    assert S.indented_loops(flat) is None
    assert ("gap", "high") in {(r[1], r[2]) for r in S.scan_natural(flat).rows}
    assert S.natural_mode(["IF A", "END-IF", "LOOP"]) == "structured" and S.natural_mode(["WRITE 'A'"]) == "unknown"
    assert [r[4] for r in S.scan_natural(["T Name"], "map").rows if r[1] == "gap"] == ["map_body_unverified"]


def test_mantis_words():
    found = S.scan_mantis(["CTRL-BEGIN", "ENDTRAN", "SINOF", "SINON", "% no", "! no", "// no", "SMALLTEXT A(3)"]).rows
    assert [r[4] for r in found if r[1] == "transaction"] == ["CTRL-BEGIN", "ENDTR", "SIGNOFF", "SIGNON"]
    assert [r[3] for r in found if r[1] == "variable"] == ["A"] and not [r for r in found if r[1] == "gap"]


def test_placeholders_and_families(spark):
    named = spark.createDataFrame([("A", "7", "1"), ("B", "7", "2"), ("C", "8", None), ("D", "9", None), ("E", "9", "3")], "id string, n string, b string")
    asked = spark.createDataFrame([("p1", "7", "1"), ("p2", "7", None), ("p3", "8", "5"), ("p4", "9", "3"), ("p5", "9", "4"), ("p6", "4", None), ("p7", "7", "9")], "id string, n string, b string")
    got = {r.placeholder: (r.candidates, r.target) for r in resolve.reconcile(asked, named, "n", "b", "id").collect()}
    assert got == {"p1": (1, "A"), "p2": (2, None), "p3": (1, "C"), "p4": (2, None), "p5": (1, "D")}
    entities = spark.createDataFrame([("Orders", "sql_table"), ("ORDERS", "sql_view"), ("ORDERS", "ddm")], "name string, kind string")
    wanted = spark.createDataFrame([("orders",), ("nothing",)], "name string")
    got = {r.name: (r.entity_name, r.entity_kind) for r in resolve.resolve_entity(wanted, entities, "name", "sql", "kind", "sql_table").collect()}
    assert got == {"orders": ("Orders", "sql_table"), "nothing": ("nothing", "sql_table")}
