"""Reading line-oriented source: files, encodings, lines, sequence columns, dialects, members.

read_files() is one binary scan; decoding is an Arrow batch function (EBCDIC code pages need Python's codecs), and all that
follows is DataFrame work: a file's parameters are grouped sums over its lines, joined back by path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BYTES = 50 * 1024 * 1024
EBCDIC = ("cp037", "cp500", "cp1047", "cp285", "cp273")

#: Signatures of each dialect, in the order that settles ties.
DIALECTS = [
    ("jcl", r"(?m)^//\S*\s+(JOB|EXEC|DD)\b"),
    ("cics_csd", r"(?mi)^\s*DEFINE\s+(PROGRAM|TRANSACTION|FILE|MAPSET)\s*\("),
    ("adabas_fdt", r"(?mi)FIELD\s+DEFINITION\s+TABLE|^\s*\d+\s+[A-Z0-9]{2}\s+\d+\s+[ABPUFGIL]\s"),
    ("ddm", r"(?mi)^\s*(DDM\s+NAME|DEFAULT\s+SEQUENCE|DB\s*:\s*\d+\s+FILE\s*:\s*\d+)"),
    ("supra_dir", r"(?i)\b(LINKPATH|DATA-?SET\s+NAME|PRIMARY\s+DATA\s*SET|RELATED\s+DATA\s*SET|ELEMENT\s+NAME)\b"),
    ("sql_ddl", r"(?mi)^\s*CREATE\s+(TABLE|UNIQUE\s+INDEX|INDEX|VIEW|TABLESPACE)\b"),
    ("natural", r"(?mi)^\s*(DEFINE\s+DATA\b|END-DEFINE\b|CALLNAT\b|FETCH\s+RETURN\b)"),
    ("mantis", r"(?mi)^\s*(ENTRY\b|CONVERSE\b|OBTAIN\b|EXIT\s*$|PROGRAM\s+\"|EXTERNAL\b)"),
    ("cobol_copybook", r"(?mi)^\s*\d\d\s+[A-Z0-9\-]+\s+(PIC|PICTURE)\s"),
]
#: Lines that begin a member in a file of several, by dialect; the groups hold the name and, if any, the type.
BANNERS = {
    "natural": [
        (r"(?i)^\*+\s*>{2,}\s*(?:(\w+)\s+)?([A-Z0-9#\-_&$]{1,32})\s*<{2,}", 2, 1),
        (r"(?i)^\s*\*\s*MEMBER\s*[:=]\s*([A-Z0-9#\-_&$]{1,32})", 1, 0),
        (r"(?i)^--+\s*([A-Z0-9#\-_&$]{1,32})\s*\(([A-Z]{1,12})\)\s*--+", 1, 2),
    ],
    "mantis": [(r"(?i)^\s*PROGRAM\s+\"([^\"]{1,40})\"", 1, 0), (r"(?i)^\s*\*\s*MANTIS\s+(?:PROGRAM|OBJECT)\s*[:=]\s*(\S{1,40})", 1, 0)],
    "jcl": [(r"^//([A-Z0-9#@$]{1,8})\s+JOB\b", 1, 0)],
}
#: Dialects whose banners come from an unload utility and are no lines of the member.
UTILITY_BANNERS = ("natural",)
#: Object types by file ending and by a banner's type code.
TYPE_OF_ENDING = {
    "nsp": "program", "nsn": "subprogram", "nss": "subroutine", "nsc": "copycode", "nsh": "helproutine", "nsm": "map", "nsl": "lda", "nsg": "gda", "nsa": "pda",
    "nst": "text", "nsd": "ddm", "nsx": "class",
}
TYPE_OF_CODE = {
    "P": "program", "PROGRAM": "program", "N": "subprogram", "SUBPROGRAM": "subprogram", "S": "subroutine", "SUBROUTINE": "subroutine", "C": "copycode", "COPYCODE": "copycode",
    "H": "helproutine", "HELPROUTINE": "helproutine", "M": "map", "MAP": "map", "L": "lda", "LDA": "lda", "LOCAL": "lda", "G": "gda", "GDA": "gda", "GLOBAL": "gda",
    "A": "pda", "PDA": "pda", "PARAMETER": "pda", "T": "text", "TEXT": "text", "V": "ddm", "DDM": "ddm", "VIEW": "ddm",
}
#: Types of members of the other dialects.
TYPE_OF_DIALECT = {"mantis": "program", "jcl": "job", "sql_ddl": "ddl", "cobol_copybook": "copybook", "cics_csd": "csd", "adabas_fdt": "fdt", "ddm": "ddm", "supra_dir": "directory"}
EXTENSIONS = {
    "nsp": "natural", "nsn": "natural", "nss": "natural", "nsc": "natural", "nsm": "natural", "nsl": "natural", "nsg": "natural", "nsa": "natural", "nsh": "natural", "mantis": "mantis", "man": "mantis", "ddm": "ddm",
    "fdt": "adabas_fdt", "dir": "supra_dir", "sql": "sql_ddl", "ddl": "sql_ddl", "cpy": "cobol_copybook", "jcl": "jcl", "csd": "cics_csd", "txt": None, "src": None,
}


def read_files(spark: SparkSession, path: str, glob: str = "*", forced: str | None = None) -> DataFrame:
    """path, sha256, size, too_large, encoding, text of the files under path (text null over MOST_BYTES)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return decode(files.select("path", F.col("length").alias("size"), "content"), forced)


def sniff(raw: bytes) -> str:
    """utf-8 if it decodes to over 95 % printable characters; EBCDIC if over a tenth of the bytes are 0x40; else latin-1."""
    try:
        text = raw.decode("utf-8")
        if not text or sum(c.isprintable() or c in "\r\n\t" for c in text) > 0.95 * len(text):
            return "utf-8"
    except UnicodeDecodeError:
        pass
    return EBCDIC[0] if raw.count(0x40) > 0.1 * len(raw) else "latin-1"


def decode(files: DataFrame, forced: str | None = None) -> DataFrame:
    """files (path, size, content) with sha256 of the raw bytes, the encoding and the text with \\n line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for raw in batch.column("content").to_pylist():
                if raw is None:
                    names.append(None), texts.append(None)
                    continue
                names.append(forced or sniff(raw))
                texts.append(raw.decode(names[-1], "replace").replace("\r\n", "\n").replace("\r", "\n"))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("path", "sha256", "size", "too_large")], pa.array(names, pa.string()), pa.array(texts, pa.string())],
                names=["path", "sha256", "size", "too_large", "encoding", "text"],
            )

    large = F.col("size") > MOST_BYTES
    frame = files.select("path", F.sha2("content", 256).alias("sha256"), "size", large.alias("too_large"), F.when(~large, F.col("content")).alias("content"))
    return frame.mapInArrow(run, "path string, sha256 string, size long, too_large boolean, encoding string, text string")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1) and line: a text split at \\n; null is one empty line."""
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n")
    return docs.select(key, F.posexplode(F.split(normal, "\n", -1)).alias("_n", "line")).select(key, (F.col("_n") + 1).cast("long").alias("line_no"), "line")


def sequence_columns(rows: DataFrame, key: str, text: str, first: int = 73, last: int = 80, least: int = 5, share: float = 0.9) -> DataFrame:
    """key, trailing (columns hold sequence numbers), leading (width of a numeric prefix: 4, 6 or 8, else 0)."""
    long_ = F.length(text) >= first
    part = F.substring(text, first, last - first + 1)
    aggs = [F.sum(long_.cast("int")).alias("_n"), F.sum((long_ & part.rlike("^[0-9 ]*$")).cast("int")).alias("_ok")]
    for w in (4, 6, 8):
        wide = F.length(text) > w
        aggs += [F.sum(wide.cast("int")).alias(f"_n{w}"), F.sum((wide & F.substring(text, 1, w).rlike(f"^[0-9]{{{w}}}$")).cast("int")).alias(f"_ok{w}")]
    out = rows.groupBy(key).agg(*aggs)
    hit = lambda n, ok: (F.col(n) >= least) & (F.col(ok) >= share * F.col(n))
    leading = F.coalesce(*[F.when(hit(f"_n{w}", f"_ok{w}"), F.lit(w)) for w in (4, 6, 8)], F.lit(0))
    return out.select(key, hit("_n", "_ok").alias("trailing"), leading.alias("leading"))


def strip_sequence(rows: DataFrame, found: DataFrame, key: str, text: str, first: int = 73) -> DataFrame:
    """rows without their sequence columns; a trailing one wins over a leading one."""
    out = rows.join(found, key, "left")
    cut = F.when(F.col("trailing"), F.rtrim(F.substring(text, 1, first - 1))).when(F.col("leading") > 0, F.expr(f"substring(`{text}`, leading + 1)")).otherwise(F.col(text))
    return out.withColumn(text, cut).drop("trailing", "leading")


def dialect_scores(text: Column, table: list[tuple[str, str]] = DIALECTS) -> Column:
    """Array of (n, -ord, name): matches of each dialect's signature, ordered so that the maximum is the detected dialect."""
    return F.array(*[F.struct(F.regexp_count(text, F.lit(p)).cast("long").alias("n"), F.lit(-k).alias("ord"), F.lit(name).alias("name")) for k, (name, p) in enumerate(table)])


def detect_dialect(docs: DataFrame, text: str, hint: str | None = None, table: list[tuple[str, str]] = DIALECTS) -> DataFrame:
    """docs with dialect ('unknown' without a match), score, and ambiguous: the best under twice the next and no hint."""
    ranked = F.sort_array(dialect_scores(F.coalesce(F.col(text), F.lit("")), table), asc=False)
    out = docs.withColumn("_s", ranked)
    best = F.when(F.col("_s")[0]["n"] > 0, F.col("_s")[0]["name"]).otherwise("unknown")
    known = F.col(hint) if hint else F.lit(None).cast("string")
    ambiguous = known.isNull() & (F.col("_s")[0]["n"] > 0) & (F.col("_s")[0]["n"] < 2 * F.col("_s")[1]["n"])
    return out.withColumns({"dialect": F.coalesce(known, best), "score": F.col("_s")[0]["n"], "ambiguous": ambiguous}).drop("_s")


def member_name(path: Column) -> tuple[Column, Column]:
    """(name, dialect hint): the file's name without its chain of known extensions, upper-cased; the hint of the innermost."""
    known = "|".join(sorted(EXTENSIONS, key=len, reverse=True))
    file = F.regexp_extract(path, r"([^/\\]+)$", 1)
    name = F.upper(F.regexp_replace(file, rf"(?i)(?:\.(?:{known}))+$", ""))
    bearing = "|".join(sorted((e for e, d in EXTENSIONS.items() if d), key=len, reverse=True))
    chain = F.regexp_extract(file, rf"(?i)((?:\.(?:{known}))+)$", 1)
    first = F.lower(F.regexp_extract(chain, rf"(?i)\.({bearing})(?=\.|$)", 1))
    table = F.create_map(*[F.lit(x) for e, d in EXTENSIONS.items() if d for x in (e, d)])
    return name, F.try_element_at(table, first)


def source_sets(spark: SparkSession, sets: list[dict]) -> DataFrame:
    """The files of all source sets, each once: as read_files(), with the set's dialect, library, system and sequence setting.

    A set has path (a file or folder), glob (one or a list; all files if none), and optionally dialect, library, system,
    encoding and sequence_columns: auto, none, or FROM:TO. A file in several sets belongs to the first.
    """
    out = None
    for k, s in enumerate(sets):
        globs = s.get("glob") or ["*"]
        names = [g.rsplit("/", 1)[-1] for g in ([globs] if isinstance(globs, str) else globs)]
        files = read_files(spark, s["path"], names[0] if len(names) == 1 else "{" + ",".join(names) + "}", s.get("encoding"))
        given = {c: F.lit(s.get(c)).cast("string") for c in ("dialect", "library", "system")}
        files = files.withColumns(given | {"sequence": F.lit(str(s.get("sequence_columns", "auto"))), "_set": F.lit(k)})
        out = files if out is None else out.unionByName(files)
    first = Window.partitionBy("path").orderBy("_set")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_set")


def strip_by_setting(rows: DataFrame, key: str, text: str, setting: str) -> DataFrame:
    """rows without sequence columns: found by counting where the setting is auto, cut at FROM where it is FROM:TO, kept if none."""
    found = sequence_columns(rows.where(F.col(setting) == "auto"), key, text)
    given = F.try_to_number(F.regexp_extract(setting, r"^([0-9]+):[0-9]+$", 1), F.lit("999")).cast("int")
    cut = F.when(given.isNotNull(), F.rtrim(F.expr(f"substring(`{text}`, 1, cast(regexp_extract(`{setting}`, '^([0-9]+):', 1) as int) - 1)"))).otherwise(F.col(text))
    return strip_sequence(rows.withColumn(text, cut), found, key, text)


def banner(dialect: Column, line: Column) -> tuple[Column, Column]:
    """(name, type code) where a line begins a member, else null."""
    name, code = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d, patterns in BANNERS.items():
        for pattern, of_name, of_code in patterns:
            hit = (dialect == d) & line.rlike(pattern)
            name = F.coalesce(name, F.when(hit, F.upper(F.regexp_extract(line, pattern, of_name))))
            code = F.coalesce(code, F.when(hit, F.nullif(F.upper(F.regexp_extract(line, pattern, of_code)), F.lit("")))) if of_code else code
    return name, code


def split_members(files: DataFrame) -> DataFrame:
    """name, code, path, first_line, text: the members of each file (path, name, dialect, sequence, text), by their banners.

    A member's lines are numbered anew. Comment lines before the first banner go with the first member. Windows are over one
    file, of at most MOST_BYTES.
    """
    from lodestrata.operators import structure

    rows = files.select("path", "name", "dialect", "sequence", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    rows = strip_by_setting(rows, "path", "line", "sequence")
    name, code = banner(F.col("dialect"), F.col("line"))
    rows = rows.withColumns({"_name": name, "_code": code})
    rows = structure.segments(rows, "path", "pos", F.col("_name").isNotNull())
    of_segment = Window.partitionBy("path", "segment")
    rows = rows.withColumns({"member": F.coalesce(F.max("_name").over(of_segment), "name"), "code": F.max("_code").over(of_segment)})
    rows = rows.where(F.col("_name").isNull() | ~F.col("dialect").isin(*UTILITY_BANNERS))
    rows = structure.merge_preambles(rows, "path", "pos", F.col("line").rlike(r"(?i)^\s*[A-Z0-9]"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    last = F.struct("pos", "member", "code")  # of a merged preamble, the member's own name
    out = rows.groupBy("path", "segment").agg(F.max_by("member", last).alias("name"), F.max_by("code", last).alias("code"), (F.min("pos") + 1).cast("long").alias("first_line"), text.alias("text"))
    return out.drop("segment")


def infer_type(text: Column, path: Column, dialect: Column, code: Column | None = None) -> Column:
    """A member's object type: a banner's code, else what its first 200 lines show, else its ending, else its dialect."""
    head = F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 200), "\n")
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    ending = F.try_element_at(table(TYPE_OF_ENDING), F.lower(F.regexp_extract(path, r"(?i)\.(ns[a-z])(?:\.[a-z]+)*$", 1)))
    has = lambda p: head.rlike(rf"(?mi)^\s*{p}")
    routine = has(r"DEFINE\s+SUBROUTINE\b") & ~has(r"(?:DEFINE\s+DATA|END\s*$)")
    takes = has(r"DEFINE\s+DATA\s+PARAMETER\b") | has(r"PARAMETER\s*$")
    shown = F.when(routine, "subroutine").when(takes, F.coalesce(ending, F.lit("subprogram"))).otherwise(F.coalesce(ending, F.when(has(r"DEFINE\s+DATA\b"), "program")))
    coded = F.try_element_at(table(TYPE_OF_CODE), code) if code is not None else F.lit(None).cast("string")
    return F.when(dialect == "natural", F.coalesce(coded, shown)).otherwise(F.try_element_at(table(TYPE_OF_DIALECT), dialect))


def object_type(rules: list[tuple[str, Column]], default: str = "program") -> Column:
    """The type of the first rule that holds."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules], F.lit(default))
