"""Command line over Parquet tables: `python -m folio.cli COMMAND --in DIR --out DIR`. Every input is DIR/<name>.parquet, every result OUT/<name>.

Exit status: 0 done, 1 checks found errors, 2 a wrong call or input."""

from __future__ import annotations

import argparse
import json
import os
import sys

VERSION = "0.2.0"
#: Tables that each command reads; those behind the bar may be missing.
INPUTS = {
    "parse": "tex|pages",
    "understand": "claims refs links catalog",
    "plan": "units nodes",
    "spec": "units slides visuals known",
    "render": "slides visuals tables equations",
    "qa": "slides units plans citations visuals nodes known|evaluations dependencies boxes packages artifacts",
}


def doctor() -> dict:
    """Which libraries are there; ready if Spark and Arrow are."""
    import importlib.util
    import shutil

    found = {m: importlib.util.find_spec(m) is not None for m in ("pyspark", "pyarrow", "pandas", "numpy", "duckdb")}
    found["java"] = shutil.which("java") is not None or bool(os.environ.get("JAVA_HOME"))
    return {"version": VERSION, "found": found, "ready": all(found[m] for m in ("pyspark", "pyarrow", "pandas", "java"))}


def _tables(spark, where: str, command: str) -> dict:
    from pyspark.errors import AnalysisException

    needed, _, optional = INPUTS[command].partition("|")
    out = {n: spark.read.parquet(f"{where}/{n}.parquet") for n in needed.split()}
    for n in optional.split():
        try:
            out[n] = spark.read.parquet(f"{where}/{n}.parquet")
        except AnalysisException:
            continue
    return out


def run(spark, args: argparse.Namespace) -> int:
    from .plans import flows
    from .sinks.staged import write_tables

    t = _tables(spark, args.input, args.command)
    calls = {
        "parse": lambda: flows.parse_papers(t["tex"], t.get("pages")),
        "understand": lambda: flows.build_evidence(t["claims"], t["refs"], t["links"], t["catalog"]),
        "plan": lambda: flows.build_plan(t["units"], t["nodes"], args.mode, args.budget),
        "spec": lambda: flows.build_spec(t["units"], t["slides"], t["visuals"], t["known"]),
        "render": lambda: flows.render_deck(t["slides"], t["visuals"], t["tables"], t["equations"], args.slides),
        "qa": lambda: flows.run_qa(t, args.max_iterations),
    }
    results = calls[args.command]()
    if args.command == "qa" and results["actions"].limit(1).count():
        t["slides"].write.mode("ignore").parquet(f"{args.out}/slides_before_repair")  # kept as it first was
    write_tables(results, args.out)
    if args.command == "qa":
        return int(spark.read.parquet(f"{args.out}/status").where("status = 'fail'").limit(1).count() > 0)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folio", description="Papers to evidence, plans, slide specifications, elements and quality reports, on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version", help="print the version")
    sub.add_parser("doctor", help="print what is installed; status 1 if something needed is not")
    for name in INPUTS:
        c = sub.add_parser(name, help=f"reads {INPUTS[name].replace('|', ' and, if there, ')}")
        c.add_argument("--in", dest="input", required=True)
        c.add_argument("--out", required=True)
        if name == "plan":
            c.add_argument("--mode", default="paper-reading")
            c.add_argument("--budget", type=int)
        elif name == "render":
            c.add_argument("--slides", type=lambda s: [int(x) for x in s.split(",")])
        elif name == "qa":
            c.add_argument("--max-iterations", type=int, default=1)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "doctor":
        state = doctor()
        print(json.dumps(state, indent=2))
        return 0 if state["ready"] else 1
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    from .plans.flows import GateError

    spark = spark or SparkSession.builder.appName("folio").getOrCreate()
    try:
        return run(spark, args)
    except (GateError, ValueError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
