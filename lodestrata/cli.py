"""Command line over a fact store. Exit 0: fine; 1: findings; 2: wrong use."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import measures
from lodestrata.plans import briefs, documents
from lodestrata.plans import derive as plans
from lodestrata.plans.reports import rules_register, whole


def load_config(path: str) -> dict:
    """The project's settings, YAML or JSON: sources (source sets) and options (redact, lexicon), both empty if not given."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    return {"sources": [], "options": {}} | (found or {})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata")
    p.add_argument("--store", required=True, help="folder of the fact store")
    p.add_argument("--config", help="project settings, YAML or JSON")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest", help="read a folder, or the sources of the settings")
    c.add_argument("path", nargs="?")
    c.add_argument("--glob", default="*")
    c.add_argument("--library")
    sub.add_parser("derive")
    sub.add_parser("coverage").add_argument("--json", action="store_true")
    c = sub.add_parser("gate")
    c.add_argument("--rule", action="append", default=[], help="METRIC:min|max:THRESHOLD")
    c = sub.add_parser("calibrate")
    c.add_argument("--dialect")
    c.add_argument("--top", type=int, default=30)
    c = sub.add_parser("brief")
    which = c.add_mutually_exclusive_group(required=True)
    which.add_argument("--module")
    which.add_argument("--entity")
    which.add_argument("--system", action="store_true")
    sub.add_parser("rules-register")
    c = sub.add_parser("test-plan")
    c.add_argument("--member")
    c.add_argument("--overlay", help="JSON lines of scenario, review_status, status")
    sub.add_parser("test-brief").add_argument("member")
    sub.add_parser("test-advisory")
    for name in ("validate", "test-validate"):
        sub.add_parser(name).add_argument("docs")
    c = sub.add_parser("sample-citations")
    c.add_argument("docs", nargs="?")
    c.add_argument("--n", type=int, default=3)
    c.add_argument("--judge", choices=["human", "llm", "report"], default="report")
    c.add_argument("--verdicts", help="JSON lines of id, accurate")
    sub.add_parser("export").add_argument("out")
    return p


def show(text: str | None, missing: str) -> int:
    print(text if text is not None else missing)
    return int(text is None)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestrata").getOrCreate()
    store = plans.FactStore(spark, args.store)
    config = load_config(args.config) if args.config else {"sources": [], "options": {}}
    options = config["options"]
    redact = options.get("redact") or {}
    patterns = redact.get("patterns") if redact.get("enabled") else None
    if args.command == "ingest":
        if not args.path and not config["sources"]:
            print("no path and no sources", file=sys.stderr)
            return 2
        done = plans.ingest(store, args.path or config["sources"], args.glob, args.library)
        for r in done.groupBy("action").count().orderBy("action").collect():
            print(f"{r['action']}: {r['count']}")
    elif args.command == "derive":
        print(json.dumps({r.metric: r.value for r in plans.derive(store).collect()}, sort_keys=True))
    elif args.command == "coverage":
        rows = {r.metric: r.value for r in plans.coverage(store).collect()}
        print(json.dumps(rows, sort_keys=True) if args.json else "\n".join(f"{k}: {v:g}" for k, v in rows.items()))
        for r in measures.histogram(briefs.gaps_of(store), "kind", "severity").orderBy(measures.by_severity(), "kind").collect() if not args.json else []:
            print(f"gap {r.kind} ({r.severity}): {r.n}")
    elif args.command == "gate":
        rules = [(m, k, float(t)) for m, k, t in (r.split(":") for r in args.rule)]
        if not rules:
            print("no rules", file=sys.stderr)
            return 2
        found = measures.gate(plans.coverage(store), rules).orderBy("metric").collect()
        for r in found:
            print(f"{'pass' if r.passed else 'FAIL'} {r.metric} {r.value:g} ({r.kind} {r.threshold:g})")
        return int(not all(r.passed for r in found))
    elif args.command == "calibrate":
        gaps = store["gap"].where(F.col("kind") == "unparsed_line")
        if args.dialect:
            gaps = gaps.join(store["member"].where(F.col("dialect") == args.dialect).select(F.col("name").alias("member")), "member", "left_semi")
        for r in measures.calibrate(gaps, "detail", ["member", "line_no"], args.top).collect():
            print(f"{r.n:6d} {r.token}: {r.sample}")
    elif args.command == "brief":
        if args.system:
            return show(briefs.text_of(briefs.system_brief(store)), "nothing read yet")
        if args.entity:
            return show(briefs.text_of(briefs.entity_briefs(store, options.get("lexicon")), args.entity), f"no entity {args.entity}")
        held = briefs.ambiguous_names(store).where(F.col("member") == args.module.upper()).first()
        if held:
            print(f"{args.module} is ambiguous: libraries {held['libraries']}")
            return 1
        return show(briefs.text_of(briefs.module_briefs(store, patterns, options.get("lexicon")), args.module), f"no member {args.module}")
    elif args.command == "rules-register":
        rows = rules_register(store["rule_candidate"], "member", ["line_no", "verb", "detail"], "verb", "detail", "line_no")
        for r in whole(rows).orderBy("report").toLocalIterator():
            print(r["text"])
    elif args.command == "test-plan":
        overlay = spark.read.schema("scenario string, review_status string, status string").json(args.overlay) if args.overlay else None
        left_out = briefs.plan_tests(store, args.member, overlay).collect()
        for r in whole(briefs.test_plan_register(store)).orderBy("report").toLocalIterator():
            print(r["text"])
        for r in left_out:
            print(f"left out, ambiguous: {r['member']} ({r['libraries']})")
    elif args.command == "test-brief":
        return show(briefs.text_of(briefs.test_case_briefs(store), args.member), f"no scenarios of {args.member}: run test-plan")
    elif args.command == "test-advisory":
        for r in whole(briefs.testability_report(store)).orderBy("report").toLocalIterator():
            print(f"# {r['report']}\n{r['text']}")
    elif args.command == "validate":
        bad = 0
        for r in documents.check(store, documents.read_docs(spark, args.docs)).orderBy("doc").toLocalIterator():
            bad += not r["ok"]
            print(f"{'ok' if r['ok'] else 'FAIL'} {r['doc']}: {r['citations']} citations, {r['invalid']} invalid, {len(r['uncited'])} uncited, missing {','.join(r['missing']) or 'nothing'}")
        return int(bad > 0)
    elif args.command == "test-validate":
        lost = documents.check_tests(store, documents.read_docs(spark, args.docs)).orderBy("doc", "scenario").collect()
        for r in lost:
            print(f"FAIL {r['doc']}: no scenario {r['scenario']}")
        return int(bool(lost))
    elif args.command == "sample-citations":
        if args.docs:
            documents.sample_citations(store, documents.read_docs(spark, args.docs), args.n)
        if args.judge != "report":
            if not args.verdicts:
                print("no verdicts given", file=sys.stderr)
                return 2
            try:
                documents.record_verdicts(store, spark.read.schema("id string, accurate boolean").json(args.verdicts), args.judge)
            except ValueError as e:
                print(e, file=sys.stderr)
                return 1
        r = documents.rates(store).first()
        print(json.dumps(r.asDict()))
    elif args.command == "export":
        print("\n".join(plans.export(store, args.out)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
