import json

from lodestrata import cli
from lodestrata.plans import derive as plans

MAIN = "DEFINE DATA\nLOCAL\n1 V VIEW OF ORDERS\nEND-DEFINE\nREAD V BY KEY\nUPDATE V\nEND-READ\nEND TRANSACTION\nCALLNAT 'SUB1'\nCALLNAT 'GONE'\nEND"


def test_ingest_derive_gate_export(spark, tmp_path, capsys):
    src, store = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    (src / "MAIN.nsp").write_text(MAIN)
    (src / "SUB1.nsp").write_text("WRITE 'X'\nWEIRD WORDS HERE\nEND")
    (src / "JOB.jcl").write_text("//J JOB A\n//S EXEC PGM=MAIN\n//D DD DSN=P.Q,DISP=SHR")
    run = lambda *a: cli.main(["--store", store, *a], spark)
    assert run("ingest", str(src)) == 0 and "add: 3" in capsys.readouterr().out
    assert run("derive") == 0
    got = json.loads(capsys.readouterr().out)
    assert (got["members"], got["invocation_edges"], got["invocations_resolved"], got["unparsed_lines"]) == (3, 3, 2, 1)
    s = plans.FactStore(spark, store)
    gaps = {(r.kind, r.detail) for r in s["derived_gap"].collect()}
    assert {("unresolved_call", "GONE"), ("no_ddl_for_entity", "ORDERS"), ("orphan_module", "J")} == gaps  # the job card names the member
    assert [(r.line_no, r.boundary, r.entity) for r in s["transaction_scope"].collect()] == [(6, 8, "ORDERS")]
    lines = {(r.member, r.line_no): r.line for r in s["source_line"].collect()}
    assert all(lines["MAIN", k + 1] == t for k, t in enumerate(MAIN.split("\n")))
    assert run("gate", "--rule", "call_resolution_rate:min:0.6", "--rule", "gaps_high:max:5") == 0
    assert run("gate", "--rule", "call_resolution_rate:min:0.9") == 1 and run("gate") == 2
    assert run("calibrate") == 0 and "WEIRD" in capsys.readouterr().out
    (src / "SUB1.nsp").unlink()
    (src / "MAIN.nsp").write_text(MAIN + "\n* changed")
    assert run("ingest", str(src)) == 0
    out = capsys.readouterr().out
    assert "change: 1" in out and "remove: 1" in out and "keep: 1" in out
    assert run("derive") == 0 and s["member"].count() == 2
    assert run("export", str(tmp_path / "json")) == 0 and (tmp_path / "json" / "member").exists()
