from lodestrata.operators import scanners as S


def rows(scan, fact):
    return [r for r in scan.rows if r[1] == fact]


NATURAL = """DEFINE DATA
PARAMETER USING PDA1
LOCAL
1 V-ORD VIEW OF ORDERS
  2 STAT (A1)
1 #N (P7.2)
END-DEFINE
* a comment
F1. FIND V-ORD WITH ORD-ID = #N
  IF NO RECORDS FOUND
    ESCAPE TOP
  END-NOREC
  IF STAT = 'C' /* closed
    AND #N > 5
    CALLNAT 'SUB1' #N
  ELSE
    UPDATE (F1.)
  END-IF
END-FIND
DELETE (X9.)
PERFORM CHECK
DEFINE SUBROUTINE CHECK
  FETCH #PROG
END-SUBROUTINE
END TRANSACTION
FROBNICATE THE THING
END""".split("\n")


def test_natural():
    s = S.scan_natural(NATURAL)
    assert [(r[0], r[2], r[3], r[4]) for r in rows(s, "access")] == [(9, "FIND", "ORDERS", "R"), (17, "UPDATE", "ORDERS", "U"), (20, "DELETE", None, "D")]
    assert [(r[0], r[3], r[4]) for r in rows(s, "call")] == [(2, "PDA1", "INCLUDE"), (15, "SUB1", "CALLNAT"), (21, "CHECK", "PERFORM_INTERNAL"), (23, "#PROG", "FETCH")]
    conditions = [r for r in rows(s, "rule") if r[2] == "IF"]
    assert conditions[0][5] == "STAT = 'C' AND #N > 5" and conditions[0][7] == "STAT,#N;'C',5"
    assert {r[4] for r in rows(s, "gap")} == {"dynamic_target", "unparsed_line"}
    assert rows(s, "transaction")[0][0] == 25
    assert [r[3] for r in rows(s, "variable")] == ["STAT", "#N"]


def test_natural_unclosed_block_is_a_gap():
    s = S.scan_natural(["IF #A = 1", "WRITE 'X'"])
    assert any("not closed" in r[5] for r in rows(s, "gap"))


def test_mantis():
    s = S.scan_mantis(['PROGRAM "ORDENQ"', "* comment", 'CUSTVIEW ACCESS("X")', "IF STATUS=1", ".GET CUSTREC", ".CONVERSE ORDMAP", "END", "ENDTR", 'CHAIN "LIB:NEXTPGM"'])
    assert [(r[2], r[3]) for r in rows(s, "access")] == [("GET", "CUSTREC")]
    assert [(r[2], r[3]) for r in rows(s, "call")] == [("INCLUDE", "ORDMAP"), ("CHAIN", "NEXTPGM")]
    assert rows(s, "transaction")[0][4] == "ENDTR"
    assert [r[6] for r in rows(s, "rule")] == [0]


def test_jcl_keeps_continuations_and_stacked_input():
    s = S.scan_jcl("//J JOB A\n//S1 EXEC PGM=NATBAT,\n//   COND=(4,LT)\n//CMSYNIN DD *\nLOGON LIB\nORDPGM\nFIN\n/*\n//S2 EXEC PGM=IDCAMS\n//SYSIN DD *\n DELETE X\n/*\n//OUT DD DSN=PROD.ORD,DISP=(NEW,CATLG)".split("\n"))
    assert [r[3] for r in rows(s, "call")] == ["NATBAT", "ORDPGM", "IDCAMS"]
    assert rows(s, "step")[0][7] == "(4,LT)"
    assert [(r[3], r[5]) for r in rows(s, "dd") if r[5]] == [("OUT", "PROD.ORD")]
    assert [r[3] for r in rows(s, "entity")] == ["PROD.ORD"]


def test_definitions():
    ddl = S.scan_ddl(["CREATE TABLE A.T (ID INT NOT NULL,", " X DECIMAL(9,2), PRIMARY KEY(ID),", " FOREIGN KEY (X) REFERENCES B.U);", "CREATE UNIQUE INDEX I ON A.T (ID)"])
    assert [(r[0], r[3], r[4], r[5]) for r in rows(ddl, "field")] == [(1, "ID", "INT", None), (2, "X", "DECIMAL", "9,2")]
    assert rows(ddl, "link")[0][3:6] == ("A.T", "B.U", "X") and rows(ddl, "index")[0][2] == "UNIQUE"
    copy = S.scan_copybook(["       01  REC.", "           05  AMT  PIC S9(7)V99 COMP-3.", "           05  NAME PIC X(20) OCCURS 3.", "      * note"])
    assert [(r[3], r[4], r[5]) for r in rows(copy, "field")] == [("REC", None, None), ("AMT", "P", "7.2"), ("NAME", "A", "20")]
    csd = S.scan_csd(["DEFINE TRANSACTION(ORD1) GROUP(G)", "       PROGRAM(ORDPGM)", "DEFINE FILE(ORDF) DSNAME(PROD.F)"])
    assert [(r[3], r[4]) for r in rows(csd, "call")] == [("ORDPGM", "TRANSACTION")] and rows(csd, "entity")[0][3] == "ORDF"
    fdt = S.scan_fdt(["FILE NUMBER: 12", "1 | AA | 8 | A | DE,UQ |", "1 | AB | | | PE |", "SUPER DESCRIPTORS", "S1 = AA(1,4),AB(1,2)"])
    assert [(r[2], r[3], r[4]) for r in rows(fdt, "field")] == [("DE", "AA", "A"), (None, "AB", "PE"), ("super", "S1", "SP")]
    ddm = S.scan_ddm(["DDM NAME: ORDERS", "DB: 1 FILE: 12", "- - -- ----", "  1 AA ORDER-ID                 A  8.0 N D", "M 1 AB TAGS                     A 10.0   coupled to file 30"])
    assert [r[3] for r in rows(ddm, "field")] == ["ORDER-ID", "TAGS"]
    assert [(r[2], r[4]) for r in rows(ddm, "link")] == [("implements", "FILE-12"), ("coupled", "FILE-30")]
    supra = S.scan_supra(["DATA-SET NAME: CUST", "TYPE: PRIMARY", "  CUSTNAME C 20", "DATA-SET NAME: ORDS", "LINKPATH NAME: LK1", "PRIMARY DATA-SET: CUST", "RELATED DATA-SET: ORDS"])
    assert [r[3] for r in rows(supra, "field")] == ["CUSTNAME"] and rows(supra, "link")[0][5] == "LK1"
    assert [r[5] for r in rows(supra, "gap")] == ["ORDS has no type"]


def test_scan_on_spark(spark):
    members = [("A", "natural", None, "\n".join(NATURAL)), ("B", "jcl", None, "//S EXEC PGM=A"), ("C", "other", None, "x"), ("D", "mantis", None, None)]
    out = S.scan(spark.createDataFrame(members, "name string, dialect string, object_type string, text string"))
    assert {(r.member, r.name) for r in S.facts_of(out, "call").collect()} >= {("A", "SUB1"), ("B", "A")}
    assert S.facts_of(out, "gap").where("member = 'C'").count() == 1
