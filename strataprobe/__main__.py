"""Command line: python -m strataprobe TOOL ... Exit codes: 0 done, 2 bad input, 3 seed not resolved."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .functions.timestamps import user_datetime
from .plans import tools
from .sources.sinks import RunExists, first_of


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataprobe", description=__doc__)
    sub = p.add_subparsers(dest="tool", required=True)

    def tool(name: str, what: str, output: str = "analysis") -> argparse.ArgumentParser:
        t = sub.add_parser(name, help=what)
        t.add_argument("root")
        t.add_argument("--output", default=f"{output}/{name}")
        return t

    t = tool("inventory", "catalogue of files and coverage")
    t.add_argument("--max-scan-mb", type=int, default=50)
    t.add_argument("--max-lines", type=int, default=250_000)
    t.add_argument("--top-largest", type=int, default=25)
    t = tool("find", "exact identifier search")
    t.add_argument("--id", action="append", required=True, dest="ids")
    t.add_argument("--ignore-case", action="store_true")
    t.add_argument("--samples-per-file", type=int, default=3)
    t.add_argument("--sample-width", type=int, default=500)
    t = tool("window", "time-window extraction")
    t.add_argument("--start", required=True)
    t.add_argument("--end", required=True)
    t.add_argument("--assume-tz")
    t.add_argument("--include-static", action="store_true")
    t.add_argument("--include-profiles", action="store_true")
    t.add_argument("--overwrite", action="store_true")
    t = tool("history", "one allocation's history")
    t.add_argument("--alloc", required=True)
    t.add_argument("--samples", type=int, default=100)
    t.add_argument("--line-width", type=int, default=700)
    t.add_argument("--overwrite", action="store_true")
    t = tool("correlate", "merged timeline")
    for name in ("alloc", "node", "eval", "job", "text"):
        t.add_argument(f"--{name}", action="append", default=[], dest=f"{name}s")
    t.add_argument("--start")
    t.add_argument("--end")
    t.add_argument("--assume-tz")
    t.add_argument("--max-log-matches", type=int, default=500)
    t.add_argument("--line-width", type=int, default=700)
    t.add_argument("--include-debug-traffic", action="store_true")
    t.add_argument("--overwrite", action="store_true")
    t = tool("lineage", "allocation lineage")
    t.add_argument("--alloc", required=True)
    t.add_argument("--max-depth", type=int, default=50)
    t.add_argument("--overwrite", action="store_true")
    t = tool("trace", "evaluation trace")
    seed = t.add_mutually_exclusive_group(required=True)
    seed.add_argument("--eval", dest="evaluation")
    seed.add_argument("--alloc")
    t.add_argument("--max-depth", type=int, default=50)
    t.add_argument("--overwrite", action="store_true")
    t = tool("review", "reported identifiers against the capture")
    t.add_argument("--case-context", required=True)
    t.add_argument("--overwrite", action="store_true")
    t = tool("intake", "find the bundle in a case directory")
    t.add_argument("--bundle")
    t.add_argument("--case-context")
    t.add_argument("--max-depth", type=int, default=14)
    t.add_argument("--overwrite", action="store_true")
    return p


RUN = {
    "inventory": tools.inventory_bundle,
    "find": tools.find_identifiers,
    "window": tools.extract_window,
    "history": tools.alloc_history,
    "correlate": tools.correlate_timeline,
    "lineage": tools.alloc_lineage,
    "trace": tools.eval_trace,
    "review": tools.case_review,
    "intake": tools.case_intake,
}


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    name, root, zone = args.pop("tool"), args.pop("root"), args.pop("assume_tz", None)
    try:
        for bound in ("start", "end"):
            if bound in args:
                args[bound] = user_datetime(args[bound], zone)
        spark = SparkSession.builder.appName(f"strataprobe {name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        run = RUN[name](spark, root, **args)
        print(run)
        if name == "trace":
            found = json.loads((run / "relationships.json").read_text("utf-8"))
            print(first_of([f"{r['relation']} {r['src'][:8]} -> {r['dst'][:8]}" for r in found], 10, "relationships"))
    except tools.SeedError as e:
        print(e, file=sys.stderr)
        return 3
    except (tools.InputError, RunExists, ValueError, KeyError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
