"""Where a question points: files, lines, symbols, for many requests at once.

Lookups by line are range joins; the file is always an equality key beside the range, so they stay
hash joins with a residual, and the best row a request is a map-side combined minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.search import search_symbols
from lodegraph.operators.traversal import first_per


_HELD: list[DataFrame] = []


def known(rows: DataFrame) -> DataFrame:
    """``rows``, of which a request has few, held and counted: what is joined with them is then planned by their real size."""
    rows = rows.persist()
    rows.count()
    _HELD.append(rows)
    return rows


def forget() -> None:
    """Let go of what ``known`` holds: for callers that have their answer."""
    while _HELD:
        _HELD.pop().unpersist()


def of(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is among that of ``keys``; a semi-join goes below the joins and windows that make the rows."""
    return rows.join(keys.select(column), column, "left_semi")


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "callable", 0).when(kind == "field", 1).when(kind == "type", 2).when(kind == "namespace", 3).otherwise(4)


def file_anchor(file: DataFrame, paths: DataFrame) -> DataFrame:
    """(request_id, path) requests with their file."""
    return paths.join(file.select("id", "path", "language", "line_count"), "path").select("request_id", F.col("id").alias("file_id"), "path", "language", "line_count")


def line_anchor(requests: DataFrame, file: DataFrame, node: DataFrame) -> DataFrame:
    """(request_id, file_id, line) requests with the smallest node that contains the line, if any; lines outside the file go."""
    held = requests.join(file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "line_count"), "file_id").where("line >= 1 AND line <= line_count")
    spans = of(node, requests, "file_id").where("start_line IS NOT NULL AND end_line IS NOT NULL").select(
        F.col("file_id").alias("f"), F.struct((F.col("end_line") - F.col("start_line")).alias("width"), kind_rank(F.col("kind")).alias("k"), (-F.col("start_line")).alias("s"), F.col("id").alias("id")).alias("key"),
        "start_line", "end_line", F.struct("kind", "name", "qualified_name", "symbol_key", "start_line", "end_line").alias("v"),
    )
    best = (
        held.join(spans, (F.col("file_id") == F.col("f")) & (F.col("start_line") <= F.col("line")) & (F.col("end_line") >= F.col("line")))
        .groupBy("request_id").agg(F.min_by("v", "key").alias("v"), F.min("key").alias("key"))
    )
    return held.join(best, "request_id", "left").select(
        "request_id", "file_id", "file_path", "line", F.col("key.id").alias("node_id"), F.col("v.kind").alias("node_kind"), F.col("v.name").alias("node_name"),
        F.col("v.qualified_name").alias("qualified_name"), F.col("v.symbol_key").alias("symbol_key"), F.col("v.start_line").alias("start_line"), F.col("v.end_line").alias("end_line"),
    )


def distance(line: Column, start: Column, end: Column) -> Column:
    return F.when(end < line, line - end).when(start > line, start - line).otherwise(0)


def nearest_chunk(requests: DataFrame, chunk: DataFrame) -> DataFrame:
    """(request_id, chunk_id): the smallest chunk that contains the line, else the nearest."""
    s, e, line = F.col("start_line"), F.col("end_line"), F.col("line")
    key = F.struct(F.when((s <= line) & (e >= line), 0).otherwise(1).alias("out"), distance(line, s, e).alias("d"), (e - s).alias("w"), s.alias("s"), F.col("id").alias("id"))
    return requests.join(chunk.select("file_id", "id", "start_line", "end_line"), "file_id").groupBy("request_id").agg(F.min(key).alias("key")).select("request_id", F.col("key.id").alias("chunk_id"), F.col("key.d").cast("long").alias("distance"))


def first_chunk(chunk: DataFrame) -> DataFrame:
    """(node_id, file_id, chunk_id and the chunk's columns): the first chunk of every node in each file."""
    key = F.struct("start_line", "id")
    v = F.struct(F.col("id").alias("chunk_id"), F.col("kind").alias("chunk_kind"), F.col("start_line").alias("chunk_start"), F.col("end_line").alias("chunk_end"), F.col("text").alias("chunk_text"), F.col("token_estimate").alias("chunk_tokens"))
    return chunk.where("node_id IS NOT NULL").groupBy("node_id", "file_id").agg(F.min_by(v, key).alias("v")).select("node_id", "file_id", "v.*")


def symbol_anchor(node: DataFrame, file: DataFrame, chunk: DataFrame, query: str) -> DataFrame:
    """The best symbol for a query and its first chunk."""
    top = search_symbols(node, file, query, 1).select(F.col("id").alias("node_id"), "file_id", "file_path", "kind", "name", "qualified_name", "start_line", "end_line", "score")
    return top.join(first_chunk(chunk).select("node_id", "file_id", "chunk_id", "chunk_start", "chunk_end"), ["node_id", "file_id"], "left")


GOALS = ("explain", "failure-modes", "dependencies", "call-neighborhood")


def request_problem(
    goal: str, budget: int, symbol: str | None, file: str | None, line: int | None, max_items: int | None, output_format: str, output: str | None = None
) -> str | None:
    """The first thing wrong with a request for context, or None."""
    rules = (
        (goal not in GOALS, f"unsupported goal: {goal}"),
        (output_format not in ("markdown", "json", "text"), f"unsupported format: {output_format}"),
        (budget <= 0, "budget must be positive"),
        (max_items is not None and max_items <= 0, "max items must be positive"),
        (symbol is None and file is None, "give a symbol or a file"),
        (symbol is not None and file is not None, "give a symbol or a file, not both"),
        (symbol is not None and line is not None, "a line goes with a file, not with a symbol"),
        (line is not None and line < 1, "line must be positive"),
        (symbol is not None and not symbol.strip(), "symbol must not be blank"),
        (output is not None and not _has_folder(output), f"no such folder for the output: {output}"),
    )
    return next((said for wrong, said in rules if wrong), None)


def _has_folder(path: str) -> bool:
    import os

    return os.path.isdir(os.path.dirname(os.path.realpath(os.path.expanduser(path))))


def relative_path(root: str, path: str) -> str | None:
    """A path inside the repository, relative to it with forward slashes; None outside."""
    import os

    full = os.path.normpath(path if os.path.isabs(path) else os.path.join(root, path))
    inside = os.path.relpath(full, os.path.normpath(root)).replace(os.sep, "/")
    return None if inside == ".." or inside.startswith("../") else inside


def file_origins(requests: DataFrame, node: DataFrame, chunk: DataFrame) -> DataFrame:
    """One row for every callable, type and field with a span in each request's file, with its first chunk, in order ``ord``."""
    order = [F.when(F.col("node_kind") == "callable", 0).when(F.col("node_kind") == "type", 1).otherwise(2), "start_line", "node_id"]
    named = node.where("kind IN ('callable', 'type', 'field') AND start_line IS NOT NULL AND end_line IS NOT NULL").select(
        F.col("id").alias("node_id"), "file_id", F.col("kind").alias("node_kind"), F.col("name").alias("node_name"), "qualified_name", "symbol_key", "start_line", "end_line"
    )
    rows = requests.select("request_id", "file_id", "file_path").join(of(named, requests, "file_id"), "file_id")
    rows = first_per(rows, ["request_id"], order, keep=1 << 30)
    return rows.join(first_chunk(of(chunk, requests, "file_id")), ["node_id", "file_id"], "left")
