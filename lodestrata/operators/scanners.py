"""Line scanners: from a member's text to facts, one Arrow batch function over members.

A member is one row, so a scanner's sequential state (blocks, views, labels, instream data) lives in one call and nothing is
shuffled. Facts come as rows (member, line_no, fact, verb, name, kind, detail, depth, extra): `fact` names the table, and
facts_of() picks one of them. Whatever a scanner does not recognise becomes a gap, never a guess.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("fact", "verb", "name", "kind", "detail", "depth", "extra")
SCHEMA = "member string, line_no long, fact string, verb string, name string, kind string, detail string, depth int, extra string"
FOLD_LINES = 25


@dataclass
class Scan:
    """What a scanner has found so far."""

    rows: list[tuple] = field(default_factory=list)

    def add(self, line: int, fact: str, verb: str | None = None, name: str | None = None, kind: str | None = None, detail: str | None = None, depth: int | None = None, extra: str | None = None) -> bool:
        self.rows.append((line, fact, verb, name, kind, detail, depth, extra))
        return True

    def gap(self, line: int | None, kind: str, detail: str, severity: str = "medium") -> bool:
        return self.add(line, "gap", severity, None, kind, detail[:500])


def masked(text: str) -> str:
    """The text with each quoted literal replaced by as many NULs, so that places stay."""
    return re.sub(r"'[^']*'|\"[^\"]*\"", lambda m: "\0" * len(m[0]), text)


def facts(condition: str) -> str:
    """Identifiers; literals of a condition, each once in order."""
    plain = re.sub(r"'[^']*'|\"[^\"]*\"", " ", condition)
    noise = {"AND", "OR", "NOT", "EQ", "NE", "GT", "LT", "GE", "LE", "THRU", "TO", "WITH", "BY", "THEN", "IF", "IS", "OF", "MASK"}
    names = dict.fromkeys(w.upper() for w in re.findall(r"[#+&A-Za-z][A-Za-z0-9_#.-]*", plain) if w.upper() not in noise)
    literals = dict.fromkeys(re.findall(r"'[^']*'|\"[^\"]*\"|\b[0-9]+(?:\.[0-9]+)?\b", condition))
    return f"{','.join(names)};{','.join(literals)}"


# ---- Natural ----

N_DATA = re.compile(r"^(READ WORK(?: FILE)?|WRITE WORK(?: FILE)?|READ|FIND NUMBER|FIND|HISTOGRAM|GET SAME|GET TRANSACTION DATA|GET|STORE|UPDATE|DELETE|SELECT|INSERT)\b(.*)$", re.IGNORECASE | re.DOTALL)
N_CALL = re.compile(r"^(CALLNAT|FETCH RETURN|FETCH|PERFORM|INCLUDE|RUN|CALL)\s+(\S+)", re.IGNORECASE)
N_RULE = re.compile(r"^(IF NO RECORDS?(?: FOUND)?|IF|ELSE|DECIDE ON|DECIDE FOR|WHEN|VALUES?|NONE|ANY|ALL|FOR|REPEAT|ESCAPE|AT (?:BREAK|END|START|TOP)|ON ERROR)\b(.*)$", re.IGNORECASE | re.DOTALL)
N_OPENS = {"IF": "IF", "DECIDE": "DECIDE", "FOR": "FOR", "REPEAT": "REPEAT", "AT BREAK": "BREAK", "ON ERROR": "ERROR", "READ": "READ", "FIND": "FIND", "HISTOGRAM": "HISTOGRAM"}
N_CRUD = {"READ": "R", "FIND": "R", "FIND NUMBER": "R", "HISTOGRAM": "R", "GET": "R", "GET SAME": "R", "STORE": "C", "UPDATE": "U", "DELETE": "D", "SELECT": "R", "INSERT": "C", "READ WORK": "R", "WRITE WORK": "C"}
N_MATH = re.compile(r"^(COMPUTE|ADD|SUBTRACT|MULTIPLY|DIVIDE|MOVE|EXAMINE|COMPRESS|SEPARATE|ASSIGN)\b", re.IGNORECASE)


def natural_statements(lines: list[str]) -> Iterator[tuple[int, str]]:
    """(line, statement): comments off, lines that the last one's end or their own beginning continues folded in."""
    at = 0
    while at < len(lines):
        text = without_comment(lines[at])
        first, n = at, 0
        at += 1
        while text and at < len(lines) and n < FOLD_LINES:
            following = without_comment(lines[at])
            hangs = re.search(r"(?:\b(?:AND|OR|WITH|BY|TO|THRU)|[=+\-,(])$", masked(text), re.IGNORECASE)
            leads = re.match(r"(?:AND|OR|THRU|TO|WITH|BY)\b", following, re.IGNORECASE) or re.match(r"(?:WRITE|DISPLAY|PRINT)\b", text, re.IGNORECASE) and re.match(r"[0-9]+[TX]\b", following)
            if not following or not (hangs or leads):
                break
            text, at, n = f"{text} {following}", at + 1, n + 1
        if text:
            yield first + 1, text


#: What shows structured mode, and what shows reporting mode.
N_STRUCTURED = re.compile(r"\bEND-(IF|DEFINE|DECIDE|REPEAT|FOR|SUBROUTINE|WORK|ALL)\b", re.IGNORECASE)
N_REPORTING = re.compile(r"^\s*(LOOP\b|DO\b\s*$|DOEND\b)", re.IGNORECASE)


def natural_mode(lines: list[str]) -> str:
    """structured, reporting or unknown."""
    if any(N_STRUCTURED.search(t) for t in lines):
        return "structured"
    return "reporting" if any(N_REPORTING.match(t) for t in lines) else "unknown"


def indented_loops(lines: list[str]) -> dict[int, int] | None:
    """Indent of each LOOP line by number, if indents can be trusted: each is followed by a deeper code line. Else None."""
    code = [(n, len(t) - len(t.lstrip()), bool(re.match(r"\s*LOOP\b", t, re.IGNORECASE))) for n, t in enumerate(lines, 1) if without_comment(t)]
    after = [*code[1:], (0, -1, False)]
    if any(loop and below[1] <= indent for (_, indent, loop), below in zip(code, after, strict=True)):
        return None
    return {n: indent for n, indent, loop in code if loop}


def without_comment(line: str) -> str:
    if re.match(r"\*|\s*/\*", line):
        return ""
    cut = masked(line).find("/*")
    return (line if cut < 0 else line[:cut]).strip()


def scan_natural(lines: list[str], object_type: str | None = None) -> Scan:
    s, blocks, views, labels = Scan(), [], {}, {}
    own = {m[1].upper() for t in lines if (m := re.match(r"\s*DEFINE SUBROUTINE\s+(\S+)", t, re.IGNORECASE))}
    scope, coded = None, 0
    mode = natural_mode(lines)
    s.add(None, "metric", None, "mode", None, mode)
    loops = indented_loops(lines) if mode == "reporting" else {}
    if loops is None:
        s.gap(None, "reporting_mode", "indents do not show where loops end", "high")
        loops = {}
    if object_type == "map":
        s.gap(None, "map_body_unverified", "the fields of a map are read from its text alone")
    for line, text in natural_statements(lines):
        coded += 1
        if loops:
            indent = len(lines[line - 1]) - len(lines[line - 1].lstrip())
            ended = next((k for k, b in enumerate(blocks) if b[0] == "LOOP" and indent <= loops[b[1]]), len(blocks))
            del blocks[ended:]  # with the loop, what it opened
            if line in loops:
                blocks.append(("LOOP", line))
                continue
        label = re.match(r"([A-Z][A-Z0-9-]*)\.\s+(.*)$", text, re.IGNORECASE | re.DOTALL)
        if label:
            text = label[2]
        upper = masked(text).upper()
        if upper.startswith("DEFINE DATA"):
            scope = "local"
        elif upper == "END-DEFINE":
            scope = None
        elif scope and (m := re.match(r"(PARAMETER|LOCAL|GLOBAL|INDEPENDENT)(?:\s+USING\s+(\S+))?$", upper)):
            scope = m[1].lower()
            if m[2]:
                s.add(line, "call", "INCLUDE", m[2], "INCLUDE", scope)
        elif scope:
            if m := re.match(r"[0-9]+\s+(\S+)\s+VIEW(?:\s+OF)?\s+(\S+)", upper):
                views[m[1]] = m[2]
                s.add(line, "view", None, m[1], None, m[2])
            elif m := re.match(r"([0-9]+)\s+([^\s(]+)\s*(?:\(([A-Z])([0-9.,/:]*)\))?", upper):
                s.add(line, "variable", scope, m[2], m[3], m[4] or None, int(m[1]))
            else:
                s.gap(line, "unparsed_line", text, "low")
        elif not natural_statement(s, line, text, upper, blocks, views, labels, own, label[1].upper() if label else None, object_type):
            if len(text) > 3:
                s.gap(line, "unparsed_line", text, "low")
    for block, line in [b for b in blocks if b[0] != "LOOP"]:
        s.gap(line, "unparsed_line", f"{block} is not closed")
    s.add(None, "metric", None, "code_lines", None, str(coded))
    return s


def natural_statement(s: Scan, line: int, text: str, upper: str, blocks: list, views: dict, labels: dict, own: set, label: str | None, object_type: str | None) -> bool:
    depth = len(blocks)
    if m := re.match(r"END-([A-Z]+)$", upper):
        if blocks and m[1] in (blocks[-1][0], "ALL"):  # only the top block closes
            blocks.pop()
        return True
    if re.match(r"END TRANSACTION|BACKOUT TRANSACTION", upper):
        return s.add(line, "transaction", upper.split()[0], None, "END" if upper[0] == "E" else "BACKOUT", text[:160], depth)
    if object_type == "map" and (m := re.match(r"([TF])\s+(.*)$", text)):
        return s.add(line, "interaction", "MAP_TEXT" if m[1] == "T" else "MAP_FIELD", None, None, m[2][:160])
    if m := N_CALL.match(upper):
        verb, raw = m[1], text[m.start(2) : m.end(2)]
        if verb == "PERFORM" and m[2] in own:
            return s.add(line, "call", verb, m[2], "PERFORM_INTERNAL", None, depth)
        target = raw.strip("'\"(),.").upper()
        dynamic = target[:1] in ("#", "+", "*")
        s.add(line, "call", verb, target, verb, "dynamic" if dynamic else None, depth)
        return s.gap(line, "dynamic_target", text, "high") if dynamic else verb != "CALL" or s.gap(line, "external_call", text)
    if m := re.match(r"DEFINE SUBROUTINE\s+(\S+)", upper):
        blocks.append(("SUBROUTINE", line))
        return s.add(line, "subroutine", None, m[1])
    if upper.startswith(("INPUT", "REINPUT", "WRITE", "DISPLAY", "PRINT")) and not upper.startswith("WRITE WORK"):
        if m := re.search(r"USING MAP\s+['\"]?([A-Za-z0-9#-]+)", text, re.IGNORECASE):
            s.add(line, "call", "INCLUDE", m[1].upper(), "INCLUDE", "map", depth)
        if upper.startswith("REINPUT"):
            s.add(line, "message", "REINPUT", None, None, (re.search(r"'([^']*)'|\*([0-9]+)", text) or [text])[0][:300])
        return s.add(line, "interaction", upper.split()[0], None, None, text[:160], depth)
    rule = N_RULE.match(upper)
    if rule:
        construct = re.sub(r"\s+", " ", rule[1])
        condition = text[rule.start(2) :].strip()
        s.add(line, "rule", construct, None, None, condition[:500], depth, facts(condition))
        opens = next((b for k, b in N_OPENS.items() if construct.startswith(k)), None)
        if opens and construct not in ("IF NO RECORDS", "IF NO RECORD") or construct.startswith("IF NO"):
            blocks.append(("NOREC" if construct.startswith("IF NO") else opens, line))
        return True
    if m := N_DATA.match(upper):
        return natural_access(s, line, text, m, blocks, views, labels, label, depth)
    if m := N_MATH.match(upper):
        if ("\0" in upper or re.search(r"\b[0-9]+\b", upper)) and not re.match(r"(ADD|SUBTRACT) 1 (TO|FROM)\b", upper):
            s.add(line, "rule", m[1], None, None, text[:500], depth, facts(text))
        return True
    return bool(re.match(r"(RESET|IGNORE|END|SET KEY|FORMAT|STOP|TERMINATE|NEWPAGE|SKIP|EJECT|MOVE|LIMIT|CLOSE|INIT|SUSPEND|LOOP|DO|DOEND|#?[A-Z0-9#.-]+\s*:?=)", upper))


def natural_access(s: Scan, line: int, text: str, m: re.Match, blocks: list, views: dict, labels: dict, label: str | None, depth: int) -> bool:
    verb = re.sub(r"\s+FILE$", "", re.sub(r"\s+", " ", m[1]))
    rest = m[2]
    if verb == "GET TRANSACTION DATA":
        return s.add(line, "transaction", verb, None, "GET", text[:160], depth)
    if verb in ("READ WORK", "WRITE WORK"):
        n = re.match(r"\s*([0-9]+)", rest)
        return s.add(line, "access", verb, f"WORKFILE-{n[1] if n else '?'}", N_CRUD[verb], None, depth)
    if verb in ("UPDATE", "DELETE") and (ref := re.match(r"\s*(?:RECORD\s+)?(?:IN\s+)?\(([A-Z][A-Z0-9-]*)\.?\)", rest)):
        entity = labels.get(ref[1])
        s.add(line, "access", verb, entity, N_CRUD[verb], None, depth, None if entity else "unresolved")
        return bool(entity) or s.gap(line, "dynamic_target", f"no loop {ref[1]}: {text}")
    if verb == "SELECT" or verb == "INSERT":
        t = re.search(r"\b(?:FROM|INTO)\s+([A-Z][\w.-]*)", rest)
        return bool(t) and s.add(line, "access", verb, t[1], N_CRUD[verb], None, depth)
    name = re.match(r"\s*(?:\([0-9A-Z#-]+\)\s*)?(?:ALL\s+)?(?:IN\s+|RECORDS?\s+IN\s+)?(?:FILE\s+)?([A-Z][A-Z0-9#_-]*)", rest)
    entity = views.get(name[1], name[1]) if name else None
    by = re.search(r"\b(?:BY|WITH|FOR)\s+([A-Z][A-Z0-9#_-]*)", rest)
    s.add(line, "access", verb, entity, N_CRUD[verb], by[1] if by else None, depth)
    if verb in ("READ", "FIND", "HISTOGRAM"):
        blocks.append((verb, line))
        if label and entity:
            labels[label] = entity
    return True


# ---- Mantis ----

#: The codes of direct calls and what they do to a record; transaction words; comments; declarations.
SUPRA_CODES = {
    "READM": "R", "READD": "R", "READV": "R", "READR": "R", "RDNXT": "R", "READX": "R", "RDNXTX": "R",
    "ADD-M": "C", "ADDM": "C", "ADD-D": "C", "ADDD": "C", "ADDVA": "C", "ADDVB": "C",
    "WRITM": "U", "WRITD": "U", "WRITV": "U", "WRITX": "U",
    "DEL-M": "D", "DELM": "D", "DEL-D": "D", "DELD": "D", "DELVD": "D",
}
M_TXN = {
    "COMMIT": "COMMIT", "ROLLBACK": "ROLLBACK", "ENDTR": "ENDTR", "ENDTRAN": "ENDTR", "CTRL-BEGIN": "CTRL-BEGIN", "CTRL-END": "CTRL-END", "SINON": "SIGNON", "SINOF": "SIGNOFF",
}
M_COMMENTS = ("*", "%", "!", "/*", "//")
M_DECLARED = ("TEXT", "SMALLTEXT", "BIGTEXT", "NUMERIC", "BIGNUMERIC", "SMALLNUMERIC", "ARRAY", "KANJI", "LEVEL", "PICTURE")


def scan_mantis(lines: list[str], object_type: str | None = None) -> Scan:
    s, depth, opened, coded, bad = Scan(), 0, [], 0, 0
    for number, raw in enumerate(lines, 1):
        text = raw.strip()
        if not text or text.startswith(M_COMMENTS):
            continue
        coded += 1
        text = re.sub(r"^[0-9]+\s+\.*", "", text).lstrip(".")
        upper = masked(text).upper()
        word = re.match(r"[A-Z_-]+", upper)
        word = word[0] if word else ""
        quoted = re.search(r"[\"']([^\"']+)[\"']", text)
        name = quoted[1].split(":")[-1].upper() if quoted else None
        if word == "END":
            depth = max(depth - 1, 0)
            opened and opened.pop()
        elif word in ("IF", "WHILE", "FOR", "CASE", "UNTIL", "WHEN", "ELSE") or upper.startswith("ON ERROR"):
            s.add(number, "rule", "ON ERROR" if word == "ON" else word, None, None, text[len(word) :].strip()[:500], depth, facts(text[len(word) :]))
            if word in ("IF", "WHILE", "FOR", "CASE"):
                depth += 1
                opened.append((word, number))
        elif word in M_TXN:
            s.add(number, "transaction", word, None, M_TXN[word], text[:160], depth)
        elif code := next((c for c in SUPRA_CODES if re.search(rf"(?<![A-Z]){c}(?![A-Z])", upper + " " + (name or ""))), None):
            target = re.search(r"(?:DATABASE|DATBAS|CALL)\s*\(?\s*[\"'][^\"']+[\"']\s*,\s*[^,]*,\s*[\"']?([A-Z0-9-]+)", text.upper())
            s.add(number, "access", code, target[1] if target else None, SUPRA_CODES[code], None, depth)
        elif word in ("OBTAIN", "GET", "INSERT", "UPDATE", "DELETE"):
            t = re.match(r"[A-Z]+\s+([A-Z0-9_-]+)", upper)
            s.add(number, "access", word, t[1] if t else None, {"OBTAIN": "R", "GET": "R", "INSERT": "C", "UPDATE": "U", "DELETE": "D"}[word], None, depth)
        elif word in ("CONVERSE", "SHOW", "CHAIN", "CALL", "LINK", "TRANSFER", "DO"):
            t = re.match(r"[A-Z]+\s+\(?([A-Z0-9_#-]+)", upper)
            target = name or (t[1] if t else None)
            if word in ("CONVERSE", "SHOW"):
                s.add(number, "interaction", word, target, None, text[:160], depth)
                s.add(number, "call", "INCLUDE", target, "INCLUDE", None, depth)
            else:
                s.add(number, "call", word, target, "PERFORM_INTERNAL" if word == "DO" else word, None, depth)
        elif word in ("PROGRAM", "ENTRY", "EXIT", "EXTERNAL", "VIEW", "SCREEN", "FILE", "ACCESS", "INTERFACE", *M_DECLARED):
            fact = {"PROGRAM": "declaration", "EXTERNAL": "declaration", "VIEW": "view"}.get(word, "variable")
            t = re.match(r"[A-Z]+\s+([A-Z0-9_-]+)", upper)
            s.add(number, fact, word, t[1] if t else None, None, name)
        elif re.match(r"[A-Z_][A-Z0-9_()., +-]*\s*=", upper) or word in ("CLEAR", "PAD", "UNPAD", "RETURN", "STOP", "WAIT", "PROMPT", "HEAD", "SET", "TRAP", "BREAK", "NEXT", "LET"):
            pass
        else:
            bad += 1
            s.gap(number, "unparsed_line", text, "low")
    for word, number in opened:
        s.gap(number, "unparsed_line", f"{word} is not closed")
    if coded >= 20 and coded - bad < 0.85 * coded:
        s.gap(None, "ambiguous_dialect", f"{coded - bad} of {coded} lines recognised", "high")
    s.add(None, "metric", None, "code_lines", None, str(coded))
    return s


# ---- definitions and jobs ----


def scan_ddl(lines: list[str], object_type: str | None = None) -> Scan:
    """CREATE TABLE with columns, keys and links; CREATE INDEX. Each row cites its own line."""
    s = Scan()
    text = "\n".join(re.sub(r"--.*", "", t) for t in lines)
    line_at = lambda p: text.count("\n", 0, p) + 1
    for m in re.finditer(r"\bCREATE\s+TABLE\s+([\w.#@$\"]+)\s*\(", text, re.IGNORECASE):
        table = m[1].strip('"').upper()
        s.add(line_at(m.start()), "entity", "CREATE", table, "sql_table")
        depth, at, begin = 1, m.end(), m.end()
        while at < len(text) and depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            if depth == 0 or depth == 1 and text[at] == ",":
                ddl_item(s, table, text[begin:at], line_at(begin + len(text[begin:at]) - len(text[begin:at].lstrip())))
                begin = at + 1
            at += 1
    for m in re.finditer(r"\bCREATE\s+(UNIQUE\s+)?INDEX\s+([\w.#@$]+)\s+ON\s+([\w.#@$]+)\s*\(([^)]*)\)", text, re.IGNORECASE):
        s.add(line_at(m.start()), "index", "UNIQUE" if m[1] else None, m[3].upper(), m[2].upper(), ",".join(c.split()[0].upper() for c in m[4].split(",") if c.split()))
    return s


def ddl_item(s: Scan, table: str, item: str, line: int) -> None:
    item = " ".join(item.split())
    if m := re.match(r"(?:CONSTRAINT\s+\S+\s+)?PRIMARY\s+KEY\s*\(([^)]*)\)", item, re.IGNORECASE):
        s.add(line, "key", "PRIMARY", table, None, m[1].replace(" ", "").upper())
    elif m := re.match(r"(?:CONSTRAINT\s+\S+\s+)?FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+([\w.#@$]+)", item, re.IGNORECASE):
        s.add(line, "link", "foreign_key", table, m[2].upper(), m[1].replace(" ", "").upper())
    elif m := re.match(r"([\w#@$\"]+)\s+([A-Za-z]+(?:\s+VARYING|\s+PRECISION)?)\s*(?:\(([^)]*)\))?(.*)$", item):
        if m[1].upper() not in ("CHECK", "UNIQUE", "CONSTRAINT"):
            s.add(line, "field", "NOT NULL" if re.search("NOT NULL", m[4], re.IGNORECASE) else None, m[1].strip('"').upper(), m[2].upper(), m[3], None, table)


def scan_copybook(lines: list[str], object_type: str | None = None) -> Scan:
    s = Scan()
    for n, raw in enumerate(lines, 1):
        if len(raw) > 6 and raw[6] in "*/":
            continue
        body = (raw[6:72] if re.match(r"^[0-9 ]{6}", raw) else raw).strip().rstrip(".")
        m = re.match(r"([0-9]{1,2})\s+([A-Z0-9-]+)(.*)$", body, re.IGNORECASE)
        if not m:
            if body:
                s.gap(n, "unparsed_line", body, "low")
            continue
        pic = re.search(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", m[3], re.IGNORECASE)
        usage = re.search(r"\b(COMP(?:UTATIONAL)?(?:-[1-5])?|BINARY|PACKED-DECIMAL)\b", m[3], re.IGNORECASE)
        occurs = re.search(r"\bOCCURS\s+([0-9]+)", m[3], re.IGNORECASE)
        other = re.search(r"\bREDEFINES\s+([A-Z0-9-]+)", m[3], re.IGNORECASE)
        kind, size = picture(pic[1].upper(), usage[1].upper() if usage else "") if pic else (None, None)
        s.add(n, "field", f"OCCURS {occurs[1]}" if occurs else None, m[2].upper(), kind, size, int(m[1]), f"REDEFINES {other[1].upper()}" if other else None)
    return s


def picture(pic: str, usage: str) -> tuple[str, str]:
    """Format letter and length of a PICTURE: A text, N zoned, P packed, B binary; lengths like 7.2."""
    flat = re.sub(r"(.)\(([0-9]+)\)", lambda m: m[1] * int(m[2]), pic)
    whole, _, part = flat.partition("V")
    if re.search(r"[XA]", flat):
        return "A", str(len(re.findall(r"[XA9]", flat)))
    digits = (whole.count("9") + whole.count("Z"), part.count("9"))
    letter = "P" if "3" in usage or "PACKED" in usage else "B" if usage else "N"
    return letter, f"{digits[0]}.{digits[1]}" if digits[1] else str(digits[0])


#: Data definitions that belong to the system, not to the business.
SYSTEM_DDS = frozenset("STEPLIB JOBLIB SYSPRINT SYSOUT SYSIN SYSUDUMP SYSABEND SYSDBOUT CEEDUMP SORTLIB SORTWK01 SORTWK02 SORTWK03 DDCARD DDPRINT CMPRINT CMSYNIN CMOBJIN SYSTSPRT SYSTSIN".split())
STACKED = ("CMSYNIN", "CMOBJIN")


def scan_jcl(lines: list[str], object_type: str | None = None) -> Scan:
    s, step, program, dd, at = Scan(), None, "", None, 0
    while at < len(lines):
        raw, first = lines[at], at + 1
        at += 1
        if raw.startswith("//*") or not raw.strip():
            continue
        if not raw.startswith("//"):
            if dd and not raw.startswith("/*"):
                stacked(s, first, raw, dd, program)
            elif not raw.startswith("/*"):
                s.gap(first, "unparsed_line", raw, "low")
            dd = None if raw.startswith("/*") else dd
            continue
        dd, text = None, raw[:71].rstrip()
        while re.search(r",$", text) and at < len(lines) and re.match(r"//\s+\S", lines[at]):
            text += lines[at][2:71].strip()
            at += 1
        m = re.match(r"//(\S*)\s+(JOB|EXEC|DD|PROC|PEND|SET|IF|ELSE|ENDIF|INCLUDE|JCLLIB|OUTPUT)\b\s*(.*)$", text)
        if not m:
            s.gap(first, "unparsed_line", text, "low")
        elif m[2] == "EXEC":
            p = re.match(r"(?:PGM=|PROC=)?([A-Z0-9@#$]+)", m[3])
            step, program = m[1], p[1] if p else ""
            cond = re.search(r"COND=(\([^)]*\)|[^,\s]+)", m[3])
            s.add(first, "step", "PGM" if "PGM=" in m[3] else "PROC", program, step, m[3][:300], None, cond[1] if cond else None)
            s.add(first, "call", "EXEC", program, "EXEC_PGM", step)
        elif m[2] == "DD":
            dsn = re.search(r"DSN(?:AME)?=([A-Z0-9@#$.&()+-]+)", m[3])
            disp = re.search(r"DISP=(\([^)]*\)|[A-Z]+)", m[3])
            s.add(first, "dd", step, m[1], disp[1] if disp else None, dsn[1] if dsn else None)
            if dsn and m[1] not in SYSTEM_DDS:
                s.add(first, "entity", None, dsn[1], "dataset")
            dd = m[1] if re.match(r"(\*|DATA)\b|\*", m[3]) else None
    return s


def stacked(s: Scan, line: int, raw: str, dd: str, program: str) -> None:
    """Names that inline input runs: input stacks always, SYSIN only under a Natural driver."""
    if dd not in STACKED and not (dd == "SYSIN" and program.startswith("NAT")):
        return
    word = raw.split()
    if not word:
        return
    if word[0].upper() == "LOGON" and len(word) > 1:
        s.add(line, "logon", dd, word[1].upper())
    elif word[0].upper() not in ("FIN", "END", "STOP", "%", "GLOBALS") and re.fullmatch(r"[A-Z][A-Z0-9@#$-]*", word[0].upper()):
        s.add(line, "call", "STACK", word[0].upper(), "EXEC_PGM", dd)


def scan_csd(lines: list[str], object_type: str | None = None) -> Scan:
    s, at = Scan(), 0
    while at < len(lines):
        text, first = lines[at].rstrip(), at + 1
        at += 1
        while at < len(lines) and lines[at][:1] == " " and not re.match(r"\s*DEFINE\b", lines[at], re.IGNORECASE):
            text += " " + lines[at].strip()
            at += 1
        m = re.match(r"\s*DEFINE\s+([A-Z0-9]+)\s*\(([^)]*)\)(.*)$", text, re.IGNORECASE)
        if not m:
            if text.strip() and not text.lstrip().startswith("*"):
                s.gap(first, "unparsed_line", text, "low")
            continue
        pairs = [(k.upper(), v.strip()) for k, v in re.findall(r"([A-Z0-9]+)\s*\(([^)]*)\)", m[3], re.IGNORECASE)]
        kind, name = m[1].upper(), m[2].strip().upper()
        s.add(first, "resource", kind, name, None, "; ".join(f"{k}={v}" for k, v in pairs))
        if kind == "TRANSACTION" and (p := dict(pairs).get("PROGRAM")):
            s.add(first, "call", "TRANSACTION", p.upper(), "TRANSACTION", name)
        if kind == "FILE":
            s.add(first, "entity", None, name, "file", dict(pairs).get("DSNAME"))
    return s


OPTIONS = frozenset("DE FI NU UQ MU PE NC NN NV LA LB XI HF SB".split())


def scan_fdt(lines: list[str], object_type: str | None = None) -> Scan:
    s, super_, found = Scan(), False, 0
    for n, raw in enumerate(lines, 1):
        text = raw.strip()
        if m := re.search(r"FILE\s*(NUMBER|NAME)\s*[:=]?\s*(\S+)", text, re.IGNORECASE):
            s.add(n, "entity", m[1].upper(), m[2].upper(), "adabas_file")
        elif m := re.search(r"DATABASE\s*(?:ID)?\s*[:=]?\s*([0-9]+)", text, re.IGNORECASE):
            s.add(n, "entity", "DATABASE", m[1], "database")
        elif re.search(r"(SUPER|SUB|PHONETIC|HYPER).*DESC", text, re.IGNORECASE):
            super_ = True
        elif super_ and (m := re.match(r"\|?\s*([A-Z][A-Z0-9])\s*[|=]?\s*(.*)$", text)) and (parents := re.findall(r"([A-Z][A-Z0-9])\s*\(", m[2])):
            found += s.add(n, "field", "super", m[1], "SP", ",".join(parents))
        elif m := re.match(r"\|?\s*([0-9]+)\s*\|?\s+([A-Z][A-Z0-9])\s*(?:\|?\s*([0-9]+)?\s*\|?\s*([ABFGPUW])?\s*\|?\s*(.*?))?\|?$", text):
            marks = [o for o in re.split(r"[\s,|]+", m[5] or "") if o in OPTIONS]
            kind = next((o for o in ("PE", "MU") if o in marks), m[4])
            found += s.add(n, "field", "DE" if {"DE", "UQ"} & set(marks) else None, m[2], kind, m[3], int(m[1]), ",".join(marks))
    if not found:
        s.gap(None, "unparsed_line", "no field rows", "high")
    return s


def scan_ddm(lines: list[str], object_type: str | None = None) -> Scan:
    s, rows, entity = Scan(), False, None
    for n, raw in enumerate(lines, 1):
        text = raw.rstrip()
        if m := re.search(r"\bDB\s*:?\s*([0-9]+).*\bFILE\s*:?\s*([0-9]+)", text, re.IGNORECASE):
            s.add(n, "link", "implements", entity, f"FILE-{m[2]}", m[1])
        elif m := re.search(r"\bDDM\b\s*(?:NAME)?\s*[:=]?\s*([A-Z][A-Z0-9#_-]+)", text, re.IGNORECASE):
            entity = m[1].upper()
            s.add(n, "entity", None, entity, "ddm")
        if re.match(r"\s*-+(\s+-+)+", text):
            rows = True
        elif rows and (m := re.match(r"\s*([GMPS*])?\s*([0-9])\s+([A-Z][A-Z0-9])\s+([A-Z][A-Z0-9#/_-]*)\s*(?:([ABFILNPTDU])\s+([0-9.]+))?\s*([NFM])?\s*([DSHPN])?\s*(.*)$", text)):
            s.add(n, "field", m[8], m[4], {"M": "MU", "P": "PE", "G": "GROUP"}.get(m[1], m[5]), m[6], int(m[2]), f"{m[3]};{m[7] or ''};{m[9]}")
            if c := re.search(r"coupled (?:to|with)\s+(?:file\s+)?([A-Z0-9-]+)", m[9], re.IGNORECASE):
                s.add(n, "link", "coupled", entity, f"FILE-{c[1]}" if c[1].isdigit() else c[1].upper(), m[4], None, "inferred")
        elif rows and text.strip() and not text.lstrip().startswith("*"):
            s.gap(n, "unparsed_line", text, "low")
    return s


def scan_supra(lines: list[str], object_type: str | None = None, labels: dict[str, str] | None = None) -> Scan:
    names = {"dataset": "DATA-SET NAME", "type": "TYPE", "key": "CONTROL KEY", "path": "LINKPATH NAME", "primary": "PRIMARY DATA-SET", "related": "RELATED DATA-SET"} | (labels or {})
    s, dataset, path, typed, linked = Scan(), None, {}, set(), False
    for n, raw in enumerate(lines, 1):
        found = next(((k, m[1].upper()) for k, v in names.items() if (m := re.search(rf"(?:^|\s){re.escape(v)}\s*:\s*(\S+)", raw, re.IGNORECASE))), None)
        if not found:
            m = re.match(r"\s+([A-Z][A-Z0-9-]{3,})\s+([CPZB])\s+([0-9]+)(?:\s+([0-9]+))?(?:\s+([0-9]+))?\s*$", raw)
            if m and dataset:
                s.add(n, "field", None, m[1], m[2], f"{m[3]}.{m[4]}" if m[4] and m[4] != "0" else m[3], None, dataset)
            continue
        kind, value = found
        if kind == "dataset":
            dataset = value
            s.add(n, "entity", None, value, "supra_dataset")
        elif kind == "type" and dataset:
            typed.add(dataset)
            s.add(n, "attribute", "type", dataset, None, value)
        elif kind == "key":
            s.add(n, "attribute", "control_key", dataset, None, value)
        else:
            path[kind] = value
            if {"path", "primary", "related"} <= path.keys():
                linked = s.add(n, "link", "linkpath", path["primary"], path["related"], path["path"])
                path = {}
    for d in dict.fromkeys(r[3] for r in list(s.rows) if r[1] == "entity"):
        if d not in typed:
            s.gap(None, "sme_question", f"{d} has no type")
    if not linked:
        s.gap(None, "sme_question", "no linkpaths")
    return s


SCANNERS: dict[str, Callable[..., Scan]] = {
    "natural": scan_natural,
    "mantis": scan_mantis,
    "sql_ddl": scan_ddl,
    "cobol_copybook": scan_copybook,
    "jcl": scan_jcl,
    "cics_csd": scan_csd,
    "adabas_fdt": scan_fdt,
    "ddm": scan_ddm,
    "supra_dir": scan_supra,
}


def scan(members: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All facts of members (name, dialect, object_type, text), with the string columns `keep`; an unknown dialect gives one gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, dialect, kind, text, *more in zip(*[batch.column(c).to_pylist() for c in ("name", "dialect", "object_type", "text", *keep)], strict=True):
                scanner = SCANNERS.get(dialect)
                found = scanner((text or "").split("\n"), kind).rows if scanner else [(None, "gap", "medium", None, "ambiguous_dialect", dialect, None, None)]
                rows += [(name, *r, *more) for r in found]
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int32(), pa.string(), *[pa.string()] * len(keep)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["member", "line_no", *COLUMNS, *keep])

    return members.select("name", "dialect", "object_type", "text", *keep).mapInArrow(run, SCHEMA + "".join(f", `{c}` string" for c in keep))


def facts_of(rows: DataFrame, fact: str) -> DataFrame:
    return rows.where(F.col("fact") == fact).drop("fact")
