from pyspark.sql import functions as F

from lodestrata.sources import corpus


def test_reading_decodes_and_splits(spark, tmp_path):
    (tmp_path / "a.nsp").write_bytes(b"DEFINE DATA\r\nEND-DEFINE\rX")
    (tmp_path / "b.nsp").write_bytes("READ CUSTOMER   BY NAME    END-READ".encode("cp037"))
    (tmp_path / "c.nsp").write_bytes("caf\xe9 cr\xe8me".encode("latin-1"))
    out = {r.path.rsplit("/", 1)[1]: r for r in corpus.read_files(spark, str(tmp_path), "*.nsp").collect()}
    assert out["a.nsp"].text == "DEFINE DATA\nEND-DEFINE\nX" and out["a.nsp"].encoding == "utf-8"
    assert out["b.nsp"].encoding == "cp037" and out["b.nsp"].text.startswith("READ CUSTOMER")
    assert out["c.nsp"].text == "caf\xe9 cr\xe8me"
    assert not out["a.nsp"].too_large and len(out["a.nsp"].sha256) == 64


def test_sequence_columns_are_found_and_cut(spark):
    trailing = [(1, i, "CODE".ljust(72) + f"{i:08d}") for i in range(6)]
    leading = [(2, i, f"{i:04d}READ X") for i in range(6)]
    plain = [(3, i, "short") for i in range(6)]
    df = spark.createDataFrame(trailing + leading + plain, "m int, n int, t string")
    found = corpus.sequence_columns(df, "m", "t")
    assert {(r.m, r.trailing, r.leading) for r in found.collect()} == {(1, True, 0), (2, False, 4), (3, False, 0)}
    cut = {(r.m, r.t) for r in corpus.strip_sequence(df, found, "m", "t").select("m", "t").collect()}
    assert cut == {(1, "CODE"), (2, "READ X"), (3, "short")}


def test_member_name_and_hint(spark):
    df = spark.createDataFrame([("/x/ord100.nsp.txt",), ("/x/Y.jcl",), ("/x/plain",)], "p string")
    name, hint = corpus.member_name(F.col("p"))
    assert [tuple(r) for r in df.select(name, hint).collect()] == [("ORD100", "natural"), ("Y", "jcl"), ("PLAIN", None)]


def test_dialects(spark):
    texts = ["DEFINE DATA\nLOCAL\nEND-DEFINE\nCALLNAT 'X'", "//A JOB X\n//S EXEC PGM=Y\n//D DD DSN=Z", "nothing here", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.dialect for r in corpus.detect_dialect(df, "text").collect()] == ["natural", "jcl", "unknown", "unknown"]
