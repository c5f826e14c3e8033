"""Command line: python -m graphloom PATH... [options]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Analyzer
from .report import text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Analyse a JavaScript project as a property graph.")
    p.add_argument("paths", nargs="*")
    for flag in ("json", "mermaid", "swimlane", "clusters", "schema-audit", "schema-blocks", "map", "processes", "ci", "table"):
        p.add_argument(f"--{flag}", action="store_true")
    for name in ("root", "registry", "output", "query", "impact", "context"):
        p.add_argument(f"--{name}")
    p.add_argument("--schema", action="append")
    p.add_argument("--ext", default=".mjs,.js")
    p.add_argument("--direction", choices=("upstream", "downstream"), default="upstream")
    p.add_argument("--granularity", choices=("auto", "file", "symbol"), default="auto")
    p.add_argument("--depth", type=int, default=3)
    p.add_argument("--threshold", type=float, default=0.4)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.paths:
        parser().print_help()
        return 0
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    a = Analyzer(spark)
    a.analyze(args.paths, args.root, tuple(args.ext.split(",")), args.registry, args.schema)
    as_json = lambda rows: json.dumps(rows, indent=2, ensure_ascii=False, default=str)
    if args.query:
        df = a.query(args.query)
        if args.json:
            out = as_json(text.rows_of(df))
        else:
            out, n = text.as_tsv(df)
            print(f"{n} rows", file=sys.stderr)
    elif args.impact:
        rows = text.rows_of(a.impact(args.impact, args.direction, args.depth, args.granularity))
        out = as_json(rows) if args.json else text.impact_text(args.impact, rows)
    elif args.context:
        df = a.context(args.context)
        rows = text.rows_of(df)
        ids = [r["id"] for r in rows if r["part"] == "target"]
        out = as_json(rows) if args.json else text.context_text(args.context, rows, text.rows_of(a.result.graph.nodes.filter(F.col("id").isin(ids)).orderBy("ord")))
    elif args.clusters:
        rows = text.rows_of(a.clusters().orderBy(F.desc("size"), "community"))
        out = as_json(rows) if args.json else text.clusters_text(rows)
    elif args.schema_audit:
        rows = text.rows_of(a.result.schema_audit) if a.result.schema_audit is not None else None
        out = "no schemas" if rows is None else as_json(rows) if args.json else text.audit_text(rows)
    elif args.schema_blocks:
        out = "no schemas" if a.result.schema_graph is None else as_json(text.rows_of(a.schema_blocks())) if args.json else a.schema_blocks_text()
    elif args.map:
        rows = text.rows_of(a.map())
        out = as_json(rows) if args.json else text.map_text(rows)
    elif args.processes:
        rows = text.rows_of(a.processes(args.threshold))
        out = as_json(rows) if args.json else text.processes_text(rows, args.threshold)
    else:
        out = a.render("json" if args.json else "mermaid" if args.mermaid else "swimlane" if args.swimlane else "table" if args.table else "text")
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(out)
    else:
        print(out)
    return 0 if not args.ci or a.passes() else 1
