"""Command line: python -m lodegraph.cli --store DIR COMMAND ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from lodegraph.api import Engine
from lodegraph.operators.anchors import GOALS
from lodegraph.operators.traversal import DEFAULT_KINDS
from lodegraph.sources.scan import ScanOptions


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodegraph")
    p.add_argument("--store", required=True, help="folder of the stored snapshots, on storage the executors reach")
    p.add_argument("--repo", default=".", help="repository root")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index", help="scan and store a snapshot")
    c.add_argument("--rebuild", action="store_true")
    for name in ("include", "exclude", "force-include"):
        c.add_argument(f"--{name}", action="append", default=[])
    c.add_argument("--no-ignore-files", action="store_true")
    c = sub.add_parser("health", help="counts of the latest snapshot")
    c.add_argument("--integrity", action="store_true")
    for name in ("search", "symbols"):
        sub.add_parser(name).add_argument("query")
    for name in ("inspect-node", "inspect-edge"):
        sub.add_parser(name).add_argument("id", type=int)
    c = sub.add_parser("neighborhood")
    c.add_argument("symbol")
    c.add_argument("--depth", type=int, default=1)
    c.add_argument("--direction", choices=("out", "in", "both"), default="out")
    c.add_argument("--edge-kind", action="append", default=[])
    c.add_argument("--limit", type=int, default=50)
    c = sub.add_parser("context")
    c.add_argument("--symbol")
    c.add_argument("--file")
    c.add_argument("--line", type=int)
    c.add_argument("--goal", choices=GOALS, default="explain")
    c.add_argument("--budget", type=int, default=8000)
    c.add_argument("--max-items", type=int)
    c.add_argument("--format", choices=("markdown", "json", "text"), default="markdown")
    c.add_argument("--output")
    return p


def _lines(df: DataFrame, *columns: str) -> list[str]:
    """A result of bounded size, tab-separated."""
    return ["\t".join("" if r[c] is None else str(r[c]) for c in columns) for r in df.collect()]


def run(argv: list[str], spark: SparkSession | None = None) -> tuple[int, str]:
    """(exit code, output)."""
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodegraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine, repo = Engine(spark, a.store), os.path.abspath(a.repo)
    try:
        if a.command == "index":
            options = ScanOptions(tuple(a.include), tuple(a.exclude), tuple(a.force_include), not a.no_ignore_files)
            r = engine.index(repo, rebuild=a.rebuild, options=options)
            out = [f"snapshot {r.snapshot_id}: {r.mode}, {r.files} files, {r.cache_hits} cached, {r.cache_misses} extracted"]
        elif a.command == "health":
            out = [f"{k}: {v}" for k, v in sorted(engine.health(repo, a.integrity).items())]
        elif a.command == "symbols":
            out = _lines(engine.symbols(repo, a.query), "id", "score", "kind", "qualified_name", "file_path", "start_line")
        elif a.command == "search":
            symbols, chunks = engine.search(repo, a.query)
            out = ["symbols:", *_lines(symbols, "rank", "id", "score"), "chunks:", *_lines(chunks, "rank", "id", "score")]
        elif a.command in ("inspect-node", "inspect-edge"):
            df = engine.inspect_node(repo, a.id) if a.command == "inspect-node" else engine.inspect_edge(repo, a.id)
            row = df.first()
            if row is None:
                return 1, f"not found: {a.id}"
            out = [f"{k}: {v}" for k, v in row.asDict().items()]
        elif a.command == "neighborhood":
            nodes, edges = engine.neighborhood(repo, a.symbol, a.depth, a.direction, tuple(a.edge_kind) or DEFAULT_KINDS, a.limit)
            out = ["nodes:", *_lines(nodes, "depth", "node_id", "kind", "qualified_name"), "edges:", *_lines(edges, "depth", "edge_id", "kind", "src_node_id", "dst_node_id", "unresolved_dst")]
        else:
            text = engine.context(repo, symbol=a.symbol, file=a.file, line=a.line, goal=a.goal, budget=a.budget, max_items=a.max_items, output_format=a.format, output=a.output)
            out = [f"written: {a.output}"] if a.output else [text.rstrip("\n")]
    except (LookupError, ValueError) as problem:
        return 1, f"error: {problem}"
    return 0, "\n".join(out)


if __name__ == "__main__":
    code, said = run(sys.argv[1:])
    print(said, file=sys.stderr if code else sys.stdout)
    sys.exit(code)
