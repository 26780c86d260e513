"""What a user calls: index a tree, ask for its health, search it, inspect it, and get context for a place in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import render
from lodegraph.operators import anchors as an
from lodegraph.operators import candidates as ca
from lodegraph.operators import health, ranking, search, selection, traversal
from lodegraph.sources.index import IndexResult, Store, run_index

FILE_MAX_ITEMS = 40


class NotIndexed(LookupError):
    """No snapshot of the repository is stored."""


class Engine:
    """One store of indexed repositories."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, Store(spark, store)

    def index(self, repo: str, **options) -> IndexResult:
        return run_index(self.spark, repo, self.store.root, **options)

    def _snapshot(self, repo: str) -> int:
        row = self.store.latest(repo)
        if row is None:
            raise NotIndexed(repo)
        return row.id

    def graph(self, repo: str):
        return self.store.graph(self._snapshot(repo))

    def health(self, repo: str, include_integrity: bool = False) -> dict:
        sid = self._snapshot(repo)
        out: dict = {r.key: r.value for r in self.store.read("index_stat", sid).orderBy("key").collect()}
        if include_integrity:
            g = self.store.graph(sid)
            tables = {"file": g.file, "node": g.node, "edge": g.edge, "chunk": g.chunk, "occurrence": g.occurrence, "diagnostic": g.diagnostic}
            fk = health.foreign_key_problems(tables).select("id", F.concat_ws(" ", "child", "fk_column", "parent").alias("problem"))
            checks = {"edges": health.edge_problems(g.edge), "spans": health.span_problems(g).select("id", "problem"), "foreign_keys": fk}
            out |= {f"integrity.{r.check_name}": r.status for r in health.summary(checks).collect()}
            out["integrity.storage"] = "ok" if all(health.physical_check(t) == "ok" for t in tables.values()) else "failed"
        return out

    def symbols(self, repo: str, query: str, limit: int = 20) -> DataFrame:
        g = self.graph(repo)
        return search.search_symbols(g.node, g.file, query, limit)

    def search(self, repo: str, query: str, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        """(symbols, chunks) as (id, score, rank), full text first."""
        g = self.graph(repo)
        like = search.search_chunks(g.chunk, g.file, query, limit)
        ranked = like.select("id", "score", F.row_number().over(search.Window.orderBy(F.desc("score"), F.lower("file_path"), "start_line", "id")).alias("rank"))
        return search.search(g.node, g.file, query, limit), search.merge(search.full_text(g.chunk.select("id", "text"), query, limit), ranked, limit)

    def inspect_node(self, repo: str, node_id: int) -> DataFrame:
        g = self.graph(repo)
        return search.inspect_node(g.node, g.file, node_id)

    def inspect_edge(self, repo: str, edge_id: int) -> DataFrame:
        g = self.graph(repo)
        return search.inspect_edge(g.edge, g.node, g.file, edge_id)

    def neighborhood(self, repo: str, symbol: str, depth: int = 1, direction: str = "out", edge_kinds: tuple[str, ...] = traversal.DEFAULT_KINDS, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        traversal.check(depth, limit, direction)
        g = self.graph(repo)
        seed = search.search_symbols(g.node, g.file, symbol, 1).first()
        if seed is None:
            raise LookupError(f"symbol not found: {symbol}")
        nodes, edges = traversal.neighborhood(g.edge, seed.id, depth, direction, edge_kinds, limit)
        return traversal.hydrate_nodes(nodes, g.node, g.file), traversal.hydrate_edges(edges, g.edge)

    def resolve_anchor(self, repo: str, file: str, line: int) -> DataFrame:
        g = self.graph(repo)
        return an.line_anchor(self._line_request(g, repo, file, line), g.file, g.node)

    def _line_request(self, g, repo: str, file: str, line: int) -> DataFrame:
        path = an.relative_path(repo, file)
        return g.file.where(F.col("path") == (path or "")).select(F.lit(0).cast("long").alias("request_id"), F.col("id").alias("file_id"), F.lit(line).cast("long").alias("line"))

    def context(self, repo: str, *, symbol: str | None = None, file: str | None = None, line: int | None = None, goal: str = "explain", budget: int = 8000, max_items: int | None = None, output_format: str = "markdown", output: str | None = None) -> str:
        """A bundle for a symbol, a line or a whole file, rendered and, if asked, written to a file."""
        wrong = an.request_problem(goal, budget, symbol, file, line, max_items, output_format, output)
        if wrong:
            raise ValueError(wrong)
        g = self.graph(repo)
        if symbol is not None:
            top = an.symbol_anchor(g.node, g.file, g.chunk, symbol).first()
            if top is None:
                raise LookupError(f"symbol not found: {symbol}")
            anchors = g.node.where(F.col("id") == top.node_id).join(g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id").select(
                F.lit(0).cast("long").alias("request_id"), "file_id", "file_path", F.col("start_line").alias("line"), F.col("id").alias("node_id"), F.col("kind").alias("node_kind"), F.col("name").alias("node_name"),
                "qualified_name", "symbol_key", "start_line", "end_line",
            )
        else:
            anchors = an.line_anchor(self._line_request(g, repo, file, line or 1), g.file, g.node)
        anchors = anchors.persist()
        anchor = anchors.first()
        if anchor is None:
            raise LookupError(f"not indexed, or beyond the file: {file}:{line}")
        query = {"goal": goal, "budget": budget} | {k: v for k, v in (("symbol", symbol), ("file", file), ("line", line)) if v is not None}
        of_file = symbol is None and line is None
        if of_file:
            max_items = max_items or FILE_MAX_ITEMS
            requests = anchors.select("request_id", "file_id", "file_path", "line")
            origins = an.file_origins(requests, g.node, g.chunk)
            required = ca.outline(origins)
            each = origins.select("request_id", "file_id", "file_path", F.col("start_line").alias("line"), "node_id", "node_kind", "node_name", "qualified_name", "symbol_key", "start_line", "end_line")
            parts = [ca.file_symbols(g, requests), ca.imports(g, anchors), _renumbered(ca.relationships(g, each)), ca.tests_of_origins(g, origins)]
            if goal == "call-neighborhood":
                parts.append(_renumbered(ca.callers(g, each)))
            if goal == "failure-modes":
                parts.append(ca.diagnostics(g, anchors))
            optional = ca.dedupe(ca.union(parts))
            if not optional.limit(1).count():
                optional = ca.fallback(g, requests)
            notes_of = each
        else:
            required, optional = ca.for_lines(g, anchors, goal)
            required = selection.compact(required, budget)
            notes_of = anchors
        asked = F.lit(symbol) if symbol is not None else None
        scored = [ranking.score(ca.with_anchor(c, anchors, asked), goal, of_file) for c in (required.select(*ca.COLUMNS), optional)]
        if of_file:
            capped = ca.cap_symbols(scored[1])
            scored[1] = capped.where("NOT capped").drop("capped")
            beyond = [{"name": _name(r), "reason": "max-items", "score": r.score} for r in capped.where("capped").orderBy("ord").collect()]
        else:
            beyond = []
        chosen = selection.select(scored[0], scored[1], budget, goal, max_items).orderBy("place").collect()  # one request's candidates
        items = [r for r in chosen if r.verdict == "selected"]
        notes = selection.grouped_notes(ca.unresolved_notes(g, notes_of)).orderBy("first").collect()
        bundle = {
            "query": query, "anchor": {"file": anchor.file_path, "line": anchor.line, "node_name": anchor.node_name, "qualified_name": anchor.qualified_name, "symbol_key": anchor.symbol_key},
            "index_health": self.health(repo),
            "items": [
                {"rank": k, "kind": r.kind, "file": r.file, "line_range": None if r.start_line is None else [r.start_line, r.end_line], "text": r.text, "score": r.score, "token_estimate": r.token_estimate, "confidence": r.confidence,
                 "score_trace": r.score_trace, "language": (r.symbol_key or "").split(":")[0] or None, "metadata": {c: r[c] for c in ("chunk_id", "edge_id", "edge_kind", "node_id", "node_kind", "node_name", "qualified_name", "symbol_key") if r[c] is not None}}
                for k, r in enumerate(items, 1)
            ],
            "omitted": beyond + [{"name": _name(r), "reason": r.verdict, "score": r.score} for r in chosen if r.verdict != "selected"],
            "uncertainty_notes": [r.note for r in notes],
            "trace": [{"stage": "anchor", "file": anchor.file_path, "line": anchor.line}, {"stage": "candidates", "optional_count": sum(r.place > 0 for r in chosen)}],
        }
        text = render.RENDERERS[output_format](bundle)
        an.forget()
        if output:
            with open(output, "w", encoding="utf-8") as f:
                f.write(text)
        return text


def _name(r) -> str:
    if r.file is None or r.start_line is None:
        return r.kind
    return f"{r.file}:{r.start_line}" + (f"-{r.end_line}" if r.end_line != r.start_line else "")


def _renumbered(df: DataFrame) -> DataFrame:
    """One order over the candidates of all of a file's origins."""
    w = search.Window.partitionBy("request_id").orderBy("ord", "edge_id")
    return df.withColumn("ord", F.row_number().over(w)).select(*ca.COLUMNS)
