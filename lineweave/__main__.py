"""Command line: ``python -m lineweave VERB ...`` over a folder; results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from lineweave.api import Answer, Engine, doctor
from lineweave.operators.accounting import ledger_summary
from lineweave.operators.select import SelectRequest, TraceRequest
from lineweave.session import local_session
from lineweave.sources.records import read_ledger, render_report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lineweave")
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("find", "symbols", "usages", "evidence", "code"):
        sub.add_parser(verb).add_argument("query")
    read = sub.add_parser("read")
    read.add_argument("ranges", nargs="+")
    context = sub.add_parser("context")
    context.add_argument("query")
    context.add_argument("--budget", type=int, default=3000)
    context.add_argument("--include", action="append", default=[])
    trace = sub.add_parser("trace")
    trace.add_argument("symbol")
    trace.add_argument("--direction", default="dependencies")
    trace.add_argument("--max-depth", type=int, default=4)
    review = sub.add_parser("review")
    review.add_argument("--staged", action="store_true")
    review.add_argument("--range", dest="ref_range", default="")
    for verb in ("pack", "run-pack"):
        q = sub.add_parser(verb)
        q.add_argument("name")
        q.add_argument("query", nargs="?" if verb == "run-pack" else None)
        q.add_argument("--folder", default=".lineweave/packs")
    sub.add_parser("report").add_argument("ledger")
    sub.add_parser("doctor")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session()
    if a.verb == "doctor":
        report = doctor(spark)
        print(json.dumps(report))
        return 0 if report["ok"] else 1
    if a.verb == "report":
        print(render_report([r.asDict() for r in ledger_summary(read_ledger(spark, a.ledger)).collect()]))
        return 0
    e = Engine.of_folder(spark, a.root)
    if a.verb == "pack":
        print(json.dumps({"name": e.save_pack(a.folder, a.name, SelectRequest(a.query))["name"]}))
        return 0
    if a.verb == "run-pack":
        pack, stale = e.run_pack(a.folder, a.name)
        print(json.dumps({"name": pack["name"], "stale": stale, "context": pack["context"]}))
        return 0
    run = {
        "find": lambda: e.find_files(a.query), "symbols": lambda: e.find_symbols(a.query), "usages": lambda: e.find_usages(a.query), "evidence": lambda: e.find_evidence(a.query), "code": lambda: e.search_code(a.query), "read": lambda: e.read_code(a.ranges),
        "context": lambda: e.select_context(SelectRequest(a.query, a.budget, include=tuple(a.include))), "trace": lambda: e.trace_dependencies(TraceRequest(a.symbol, a.direction, a.max_depth)),
        "review": lambda: e.review_change(a.root, staged=a.staged, ref_range=a.ref_range),
    }
    answer: Answer = run[a.verb]()
    for line in answer.rows.toJSON().toLocalIterator():
        print(line)
    for note in answer.advice:
        print(note, file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
