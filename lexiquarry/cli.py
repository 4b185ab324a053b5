"""Command line: python -m lexiquarry.cli index|search|verify|bench|update|merge|watch|status ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiquarry")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "update", "merge"):
        sub.add_parser(name).add_argument("path")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--root", default=os.environ.get("LEXIQUARRY_ROOT", "."))
    s.add_argument("-n", "--limit", type=int, default=20)
    s.add_argument("--no-color", action="store_true")
    s.add_argument("--absolute", action="store_true")
    sub.add_parser("verify").add_argument("path", nargs="?", default=".")
    b = sub.add_parser("bench")
    b.add_argument("path")
    b.add_argument("-q", "--query", action="append")
    b.add_argument("--iterations", type=int, default=20)
    w = sub.add_parser("watch")
    w.add_argument("path")
    w.add_argument("--debounce-ms", type=int, default=500)
    w.add_argument("--periodic-reconcile-secs", type=int, default=600)
    t = sub.add_parser("status")
    t.add_argument("path", nargs="*")
    t.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = arguments().parse_args(argv)
    from .functions.display import commas, display_path, human_bytes, human_duration
    from .plans.parser import QueryError, parse
    from .sources.store import StoreError

    if args.command == "search":
        try:
            parse(args.query)  # a bad query fails before anything is opened
        except QueryError as e:
            print(f"error: {e}", file=sys.stderr)
            return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lexiquarry").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    from .engine import Engine, Root
    from .streaming.watch import Events

    try:
        if args.command == "index":
            s = Root(spark, args.path).build()
            print(f"{commas(s['docs_indexed'])} documents, {commas(s['tokens'])} tokens, {commas(s['unique_terms'])} terms, {human_bytes(s['bytes_on_disk'])}, {human_duration(s['seconds'])}")
        elif args.command == "search":
            root, began = Root(spark, args.root), time.perf_counter()
            for r in root.show(args.query, args.limit).collect():
                path = display_path(os.path.join(root.path, r.path), root.path, args.absolute)
                print(f"{r.score:8.3f}  {path}" + (f":{r.line_no}\n          {r.snippet}" if r.line_no else "\n          (no snippet)"))
            print(f"{commas(root.search(args.query).total())} matches in {human_duration(time.perf_counter() - began)}", file=sys.stderr)
        elif args.command == "verify":
            faults = Root(spark, args.path).verify()
            print("\n".join(faults) or "ok")
            return int(bool(faults))
        elif args.command == "bench":
            for row in Engine(spark).bench(args.path, args.query or ["the", "the AND of", '"of the"', "import OR include -test"], args.iterations):
                print(f"{row['query']:30} {row['matches']:>9,}  p50 {row['p50']:.1f} ms  mean {row['mean']:.1f}  min {row['min']:.1f}  max {row['max']:.1f}")
        elif args.command == "update":
            print(json.dumps(Root(spark, args.path).update()))
        elif args.command == "merge":
            print(f"{Root(spark, args.path).merge()} groups merged")
        elif args.command == "watch":
            Root(spark, args.path).watch(Events(), args.debounce_ms / 1000, args.periodic_reconcile_secs)
        elif args.command == "status":
            engine = Engine(spark)
            for path in args.path or ["."]:
                engine.add_root(path)
            rows = [r.asDict() for r in engine.status().collect()]
            print(json.dumps(rows) if args.json else "\n".join(f"{r['root']}: generation {r['generation']}, {commas(r['docs_indexed'])} documents, {human_bytes(r['bytes_on_disk'])}" for r in rows))
    except (StoreError, OSError) as e:
        print(f"error: {type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
