"""``python -m burrow.cli build|serve|watch|rebuild``."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("burrow").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="burrow")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("build", "serve", "watch", "rebuild"):
        p = verbs.add_parser(verb)
        p.add_argument("--root", default=".")
        p.add_argument("--db")
        if verb == "build":
            p.add_argument("--force", action="store_true")
        if verb == "watch":
            p.add_argument("--stop", action="store_true")
        if verb == "rebuild":
            p.add_argument("--file", action="append", default=[])
            p.add_argument("--stdin", action="store_true")
    a = top.parse_args(argv)
    from burrow import config
    from burrow.plans import build, reports, store, tools
    from burrow.streaming import watch

    root = os.path.abspath(a.root)
    db = a.db or config.load(root).db_path or store.default_path(root)
    if a.verb == "build":
        report = build.build(session(), root, db, a.force)
        print(report.summary(db))
        print(report.notes(), file=sys.stderr)
    elif a.verb == "rebuild":
        wanted, files = watch.hook(sys.stdin.read()) if a.stdin else (True, [])
        if wanted:
            watch.send(root, [os.path.abspath(f) for f in [*a.file, *files]])
    elif a.verb == "watch":
        pid = watch.running(root)
        if a.stop:
            if pid:
                os.kill(pid, signal.SIGTERM)
            return 0 if pid else 1
        if pid:
            print(f"process {pid} watches {root} already", file=sys.stderr)
            return 1
        with watch.registered(root) as ended:
            query = watch.watch(session(), root, db)
            while query.isActive and not ended.wait(1):
                pass
            query.stop()
    else:
        try:
            engine = tools.Engine(session(), db)
        except FileNotFoundError as e:
            print(e, file=sys.stderr)
            return 1
        for line in sys.stdin:
            try:
                ask = json.loads(line)
                name, given = ask["name"], ask.get("arguments", {})
                text = reports.report(engine, name, given) if name in reports.REPORTS else tools.call(engine, name, given)
                print(json.dumps({"content": text}), flush=True)
            except (ValueError, TypeError, KeyError, LookupError) as e:
                print(json.dumps({"error": {"code": -32603, "message": str(e)}}), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
