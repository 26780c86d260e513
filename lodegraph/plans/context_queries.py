"""Registered queries of context planning: candidates, scores, selection, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text as tx
from lodegraph.operators import anchors as an
from lodegraph.operators import candidates as ca
from lodegraph.operators import ranking, selection
from lodegraph.plans import adapters
from lodegraph.plans.duck import quoted, snippet, tokens
from lodegraph.plans.graph import Graph
from lodegraph.plans.registry import ANCHORS, lines, register

_SHOWN = ["request_id", "ord", "kind", "file", "start_line", "end_line", "token_estimate", "confidence", "chunk_id", "edge_id", "node_name"]


def _show(df: DataFrame) -> DataFrame:
    return df.select(*_SHOWN, F.md5(F.col("text").cast("binary")).alias("text_md5"))


_SQL_SHOWN = ", ".join(_SHOWN) + ", md5(text) AS text_md5"
_NONE = {
    "request_id": "NULL", "family": "0", "ord": "1", "kind": "NULL", "file": "NULL", "start_line": "NULL", "end_line": "NULL", "text": "NULL", "token_estimate": "NULL", "confidence": "NULL", "chunk_id": "NULL", "edge_id": "NULL",
    "edge_kind": "NULL", "node_kind": "NULL", "node_name": "NULL", "qualified_name": "NULL", "symbol_key": "NULL", "is_vendor": "NULL", "diagnostic_relation": "NULL",
}
_KINDS = {"family": "INTEGER", "ord": "INTEGER", "kind": "VARCHAR", "file": "VARCHAR", "text": "VARCHAR", "confidence": "DOUBLE", "edge_kind": "VARCHAR", "node_kind": "VARCHAR", "node_name": "VARCHAR", "qualified_name": "VARCHAR", "symbol_key": "VARCHAR", "is_vendor": "BOOLEAN", "diagnostic_relation": "VARCHAR"}


def _row(source: str, **have: str) -> str:
    """A candidate table's SELECT in the common shape."""
    return "SELECT " + ", ".join(f"CAST({have.get(c, d)} AS {_KINDS.get(c, 'BIGINT')}) AS {c}" for c, d in _NONE.items()) + f" FROM {source}"


_OF_NODE = {"node_kind": "x.kind", "node_name": "x.name", "qualified_name": "x.qualified_name", "symbol_key": "x.symbol_key"}
_OF_CHUNK = {"start_line": "c.start_line", "end_line": "c.end_line", "text": "c.text", "token_estimate": "c.token_estimate", "chunk_id": "c.id"}


def _lines_of(source: str, s: str, e: str, **have: str) -> str:
    """Candidates from source lines ``s`` to ``e`` of ``d.text``; none outside the file."""
    t = snippet("d.text", s, e)
    return f"SELECT * FROM ({_row(source, start_line=s, end_line=e, text=t, token_estimate=tokens(t), **have)}) WHERE text IS NOT NULL"


def _ends_sql(edges: str, kind: str, family: int) -> str:
    base = f"{edges} e JOIN g_node x ON x.id = e.far JOIN g_file f ON f.id = x.file_id LEFT JOIN g_first_chunk c ON c.node_id = x.id AND c.file_id = x.file_id"
    common = {"request_id": "e.request_id", "family": str(family), "ord": "e.ord", "kind": kind, "file": "f.path", "edge_id": "e.id", "edge_kind": "e.kind"} | _OF_NODE
    by_chunk = _row(f"{base} WHERE c.id IS NOT NULL", **common, **_OF_CHUNK, confidence="least(x.confidence, e.confidence)")
    by_lines = _lines_of(f"{base} JOIN documents d ON d.doc_id = x.file_id WHERE c.id IS NULL AND x.start_line IS NOT NULL AND x.end_line IS NOT NULL", "x.start_line", "x.end_line", **common, confidence="e.confidence")
    return f"{by_chunk} UNION ALL {by_lines}"


_RANK_EDGE = "CASE e.kind WHEN 'calls' THEN 0 WHEN 'uses_type' THEN 1 ELSE 2 END"
_NEAR = "CASE WHEN c.end_line < a.line THEN a.line - c.end_line WHEN c.start_line > a.line THEN c.start_line - a.line ELSE 0 END"
_CHUNK_NODE = "g_chunk c JOIN g_file f ON f.id = c.file_id LEFT JOIN g_node x ON x.id = c.node_id"
_STEM = "lower(regexp_replace(string_split({}, '/')[-1], '(.)\\.[^.]*$', '\\1'))"

TABLES = ANCHORS | {
    "c_target": f"""SELECT * EXCLUDE (choice, rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY choice) AS rn FROM (
 SELECT *, 0 AS choice FROM ({_row("g_anchor a JOIN g_node x ON x.id = a.node_id JOIN g_first_chunk c ON c.node_id = a.node_id AND c.file_id = a.file_id", request_id="a.request_id", kind="'target.definition'", file="a.file_path", confidence="x.confidence", **_OF_CHUNK, **_OF_NODE)})
 UNION ALL SELECT *, 1 FROM ({_lines_of("g_anchor a JOIN documents d ON d.doc_id = a.file_id WHERE a.node_id IS NOT NULL", "a.start_line", "a.end_line", request_id="a.request_id", kind="'target.source'", file="a.file_path", confidence="0.5")})
 UNION ALL SELECT *, 2 FROM ({_lines_of("g_anchor a JOIN documents d ON d.doc_id = a.file_id", "a.line", "a.line", request_id="a.request_id", kind="'target.source'", file="a.file_path", confidence="0.5")}))) WHERE rn = 1""",
    "g_around": """SELECT * FROM (SELECT a.request_id, a.file_path, x.*, row_number() OVER (PARTITION BY a.request_id ORDER BY x.end_line - x.start_line, x.start_line DESC, x.id) AS rn FROM g_anchor a JOIN g_node x ON x.file_id = a.file_id
 AND x.kind IN ('namespace', 'type') AND x.start_line <= a.line AND x.end_line >= a.line AND x.id <> a.node_id) WHERE rn = 1""",
    "c_enclosing": f"""SELECT * EXCLUDE (choice, rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY choice) AS rn FROM (
 SELECT *, 0 AS choice FROM ({_row("g_around x JOIN g_first_chunk c ON c.node_id = x.id AND c.file_id = x.file_id", request_id="x.request_id", family="1", kind="'enclosing.' || x.kind", file="x.file_path", confidence="x.confidence", **_OF_CHUNK, **_OF_NODE)})
 UNION ALL SELECT *, 0 FROM ({_lines_of("g_around x JOIN documents d ON d.doc_id = x.file_id WHERE NOT EXISTS (SELECT 1 FROM g_first_chunk c WHERE c.node_id = x.id AND c.file_id = x.file_id)", "x.start_line", "x.end_line", request_id="x.request_id", family="1", kind="'enclosing.' || x.kind", file="x.file_path", confidence="x.confidence", **_OF_NODE)})
 UNION ALL SELECT *, 1 FROM ({_row("g_anchor a JOIN g_loose_chunk c ON c.file_id = a.file_id WHERE a.node_id IS NOT NULL", request_id="a.request_id", family="1", kind="'enclosing.file'", file="a.file_path", confidence="0.7", **_OF_CHUNK)})
 UNION ALL SELECT *, 2 FROM ({_lines_of("g_anchor a JOIN documents d ON d.doc_id = a.file_id WHERE a.node_id IS NOT NULL", "a.line", "a.line", request_id="a.request_id", family="1", kind="'enclosing.file'", file="a.file_path", confidence="0.5")}))) WHERE rn = 1""",
    "c_import": _row(
        f"(SELECT a.request_id, a.file_path, o.role, o.start_line, o.end_line, o.confidence, coalesce({snippet('d.text', 'o.start_line', 'o.end_line')}, o.text) AS text, row_number() OVER (PARTITION BY a.request_id ORDER BY o.start_line, o.id) AS ord FROM g_anchor a JOIN g_occurrence o ON o.file_id = a.file_id AND o.role IN ('import', 'include') LEFT JOIN documents d ON d.doc_id = a.file_id) q",
        request_id="request_id", family="3", ord="ord", kind="role", file="file_path", start_line="start_line", end_line="end_line", text="text", token_estimate=tokens("text"), confidence="confidence",
    ),
    "g_out": f"SELECT a.request_id, e.id, e.kind, e.dst_node_id AS far, e.confidence, row_number() OVER (PARTITION BY a.request_id ORDER BY {_RANK_EDGE}, e.start_line NULLS FIRST, e.id) AS ord FROM g_anchor a JOIN g_edge e ON e.src_node_id = a.node_id AND e.kind IN ('calls', 'uses_type', 'references') AND e.dst_node_id IS NOT NULL",
    "g_in": "SELECT a.request_id, e.id, e.kind, e.src_node_id AS far, e.confidence, row_number() OVER (PARTITION BY a.request_id ORDER BY e.start_line NULLS FIRST, e.id) AS ord FROM g_anchor a JOIN g_edge e ON e.dst_node_id = a.node_id AND e.kind = 'calls' AND e.src_node_id IS NOT NULL",
    "c_relation": _ends_sql("g_out", "CASE e.kind WHEN 'calls' THEN 'neighborhood.callee' WHEN 'uses_type' THEN 'neighborhood.type' ELSE 'neighborhood.reference' END", 4),
    "c_caller": _ends_sql("g_in", "'neighborhood.caller'", 5),
    "c_test": _row(
        f"""(SELECT a.request_id, c.*, f.path, x.kind AS xk, x.name AS xn, x.qualified_name AS xq, x.symbol_key AS xs, x.confidence AS xc, row_number() OVER (PARTITION BY a.request_id ORDER BY f.path, c.start_line, c.id) AS ord FROM {_CHUNK_NODE}
 JOIN g_anchor a ON a.node_name IS NOT NULL AND (f.is_test OR contains(lower(f.path), 'test')) AND (lower(f.path) LIKE '%' || lower(a.node_name) || '%' OR lower(coalesce(x.name, '')) LIKE '%' || lower(a.node_name) || '%' OR lower(coalesce(x.qualified_name, '')) LIKE '%' || lower(a.node_name) || '%')) c""",
        request_id="c.request_id", family="6", ord="c.ord", kind="'test.related'", file="c.path", confidence="coalesce(c.xc, 0.7)", node_kind="c.xk", node_name="c.xn", qualified_name="c.xq", symbol_key="c.xs", **_OF_CHUNK,
    ),
    "c_origin_test": _row(
        f"""(SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY o_ord, nth) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY request_id, id ORDER BY o_ord, nth) AS once FROM (
 SELECT o.request_id, o.ord AS o_ord, c.*, f.path, x.kind AS xk, x.name AS xn, x.qualified_name AS xq, x.symbol_key AS xs, x.confidence AS xc, row_number() OVER (PARTITION BY o.request_id, o.node_id ORDER BY f.path, c.start_line, c.id) AS nth FROM {_CHUNK_NODE}
 JOIN g_origin o ON o.node_name IS NOT NULL AND (f.is_test OR contains(lower(f.path), 'test')) AND (lower(f.path) LIKE '%' || lower(o.node_name) || '%' OR lower(coalesce(x.name, '')) LIKE '%' || lower(o.node_name) || '%' OR lower(coalesce(x.qualified_name, '')) LIKE '%' || lower(o.node_name) || '%'))
 WHERE nth <= 2) WHERE once = 1) c""",
        request_id="c.request_id", family="6", ord="c.ord", kind="'test.related'", file="c.path", confidence="coalesce(c.xc, 0.7)", node_kind="c.xk", node_name="c.xn", qualified_name="c.xq", symbol_key="c.xs", **_OF_CHUNK,
    ),
    "c_sibling": _row(
        f"""(SELECT a.request_id, c.*, f.path, x.kind AS xk, x.name AS xn, x.qualified_name AS xq, x.symbol_key AS xs, x.confidence AS xc, row_number() OVER (PARTITION BY a.request_id ORDER BY {_NEAR}, c.start_line, c.id) AS ord FROM {_CHUNK_NODE} JOIN g_anchor a ON a.file_id = c.file_id) c""",
        request_id="c.request_id", family="7", ord="c.ord", kind="'sibling.definition'", file="c.path", confidence="coalesce(c.xc, 0.7)", node_kind="c.xk", node_name="c.xn", qualified_name="c.xq", symbol_key="c.xs", **_OF_CHUNK,
    ),
    "g_said": f"""SELECT a.request_id, g.*, f.path, f.is_vendor, CASE WHEN f.is_vendor THEN 'vendor' WHEN f.path = a.file_path THEN 'anchor-file' ELSE 'related' END AS relation, coalesce({snippet('d.text', 'g.start_line', 'g.end_line')}, g.message) AS t,
 row_number() OVER (PARTITION BY a.request_id ORDER BY CASE WHEN g.file_id = a.file_id THEN 0 ELSE 1 END, f.path, g.start_line, g.id) AS ord FROM g_diagnostic g JOIN g_file f ON f.id = g.file_id LEFT JOIN documents d ON d.doc_id = g.file_id
 JOIN g_anchor a ON f.is_vendor OR f.path = a.file_path OR {_STEM.format('f.path')} IN ({_STEM.format('a.file_path')}, lower(coalesce(a.node_name, '')))""",
    "c_diagnostic": _row(
        "g_said g", request_id="g.request_id", family="2", ord="g.ord", kind="'diagnostic.parser'", file="g.path", start_line="g.start_line", end_line="g.end_line", text="g.t", token_estimate=tokens("g.t"),
        confidence="CASE WHEN g.is_vendor THEN 0.3 WHEN g.severity = 'error' THEN 0.8 ELSE 0.6 END", is_vendor="g.is_vendor", diagnostic_relation="g.relation",
    ),
    "c_required": "SELECT * FROM c_target UNION ALL SELECT * FROM c_enclosing",
    "c_test_left": "SELECT * FROM c_test t WHERE NOT EXISTS (SELECT 1 FROM c_required r WHERE r.request_id = t.request_id AND r.chunk_id = t.chunk_id)",
}


def base_of(goal: str) -> dict[str, str]:
    """The optional candidates of a goal as tables ``c_base`` and ``c_optional``."""
    parts = ["c_import", "c_relation", "c_test_left"] + (["c_diagnostic"] if goal == "failure-modes" else []) + (["c_caller"] if goal == "call-neighborhood" else [])
    return TABLES | {
        "c_base": " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts),
        "c_optional": "SELECT * FROM c_base UNION ALL SELECT * FROM c_sibling s WHERE s.chunk_id NOT IN (SELECT u.chunk_id FROM (SELECT * FROM c_base UNION ALL SELECT * FROM c_required) u WHERE u.request_id = s.request_id AND u.chunk_id IS NOT NULL)",
    }


def _family(fn, table: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        g = adapters.graph(spark, d)
        return _show(fn(g, lines(spark, d, g)))

    return query, f"SELECT {_SQL_SHOWN} FROM {table}", TABLES


for _name, _fn, _table in (
    ("cand_target", ca.target, "c_target"), ("cand_enclosing", ca.enclosing, "c_enclosing"), ("cand_imports", ca.imports, "c_import"), ("cand_relationships", ca.relationships, "c_relation"), ("cand_callers", ca.callers, "c_caller"),
    ("cand_tests", ca.tests, "c_test"), ("cand_siblings", ca.siblings, "c_sibling"), ("cand_diagnostics", ca.diagnostics, "c_diagnostic"),
):
    register(_name, *_family(_fn, _table))


def _origins(spark, d, g: Graph) -> DataFrame:
    asked = adapters.requests(spark, d).join(g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
    return an.file_origins(asked, g.node, g.chunk)


_ORIGIN_RANK = "CASE x.kind WHEN 'callable' THEN 0 WHEN 'type' THEN 1 ELSE 2 END"
FILE_TABLES = TABLES | {
    "g_origin": f"""SELECT r.request_id, r.file_id, f.path AS file_path, x.id AS node_id, x.kind AS node_kind, x.name AS node_name, x.qualified_name, x.symbol_key, x.start_line, x.end_line, c.id AS chunk_id, c.start_line AS chunk_start,
 row_number() OVER (PARTITION BY r.request_id ORDER BY {_ORIGIN_RANK}, x.start_line, x.id) AS ord
 FROM g_request r JOIN g_file f ON f.id = r.file_id JOIN g_node x ON x.file_id = r.file_id AND x.kind IN ('callable', 'type', 'field') AND x.start_line IS NOT NULL AND x.end_line IS NOT NULL LEFT JOIN g_first_chunk c ON c.node_id = x.id AND c.file_id = x.file_id""",
    "g_outline": """SELECT request_id, file_path, 'Symbols in ' || file_path || ':' || chr(10) || string_agg('- ' || node_kind || ' ' || coalesce(nullif(qualified_name, ''), nullif(node_name, ''), '<unnamed>') || ': ' ||
 CASE WHEN start_line = end_line THEN 'line ' || start_line ELSE 'lines ' || start_line || '-' || end_line END, chr(10) ORDER BY start_line, end_line, coalesce(node_name, ''), ord) || chr(10) AS text FROM g_origin GROUP BY 1, 2""",
    "f_outline": _row("g_outline", request_id="request_id", kind="'file.outline'", file="file_path", text="text", token_estimate=tokens("text"), confidence="0.7"),
    "f_symbol": _row(
        f"(SELECT r.request_id, c.*, f.path, x.kind AS xk, x.name AS xn, x.qualified_name AS xq, x.symbol_key AS xs, x.confidence AS xc, row_number() OVER (PARTITION BY r.request_id ORDER BY {_ORIGIN_RANK}, c.start_line, c.id) AS ord FROM {_CHUNK_NODE} JOIN g_request r ON r.file_id = c.file_id WHERE x.kind IN ('callable', 'type', 'field')) c",
        request_id="c.request_id", family="1", ord="c.ord", kind="'file.symbol'", file="c.path", confidence="coalesce(c.xc, 0.7)", node_kind="c.xk", node_name="c.xn", qualified_name="c.xq", symbol_key="c.xs", **_OF_CHUNK,
    ),
    "f_fallback": f"""SELECT * EXCLUDE (choice, rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY choice) AS rn FROM (
 SELECT *, 0 AS choice FROM ({_row("g_request r JOIN g_file f ON f.id = r.file_id JOIN g_loose_chunk c ON c.file_id = r.file_id", request_id="r.request_id", family="8", kind="'file.fallback'", file="f.path", confidence="0.7", **_OF_CHUNK)})
 UNION ALL SELECT *, 1 FROM ({_lines_of("g_request r JOIN g_file f ON f.id = r.file_id JOIN documents d ON d.doc_id = r.file_id", "1", "f.line_count", request_id="r.request_id", family="8", kind="'file.fallback'", file="f.path", confidence="0.5")}))) WHERE rn = 1""",
    "c_cand": "SELECT * FROM f_symbol UNION ALL SELECT * FROM c_import UNION ALL SELECT * FROM c_relation UNION ALL SELECT * FROM c_test",
    "c_unique": """SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY request_id, CASE WHEN chunk_id IS NOT NULL THEN 'chunk ' || chunk_id WHEN edge_id IS NOT NULL THEN 'edge ' || edge_id
 WHEN file IS NOT NULL OR start_line IS NOT NULL THEN 'range ' || coalesce(file, '') || ' ' || coalesce(CAST(start_line AS VARCHAR), '') || '-' || coalesce(CAST(end_line AS VARCHAR), '') ELSE 'text ' || kind || ' ' || sha256(text) END ORDER BY family, ord) AS n FROM c_cand) WHERE n = 1""",
}

register("file_origins", lambda s, d: _origins(s, d, adapters.graph(s, d)).select("request_id", "ord", "node_id", "node_kind", "start_line", "chunk_id"), "SELECT request_id, ord, node_id, node_kind, start_line, chunk_id FROM g_origin", FILE_TABLES)
register("file_outline", lambda s, d: _show(ca.outline(_origins(s, d, adapters.graph(s, d)))), f"SELECT {_SQL_SHOWN} FROM f_outline", FILE_TABLES)
register("cand_origin_tests", lambda s, d: _show(ca.tests_of_origins(adapters.graph(s, d), _origins(s, d, adapters.graph(s, d)))), f"SELECT {_SQL_SHOWN} FROM c_origin_test", FILE_TABLES)
register(
    "file_symbols_capped", lambda s, d: ca.cap_symbols(ca.file_symbols(adapters.graph(s, d), adapters.requests(s, d))).select("request_id", "ord", "chunk_id", "capped"),
    "SELECT request_id, ord, chunk_id, ord > 8 AS capped FROM f_symbol", FILE_TABLES,
)


def _fallback(spark, d):
    g = adapters.graph(spark, d)
    asked = adapters.requests(spark, d).join(g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
    return _show(ca.fallback(g, asked))


register("file_fallback", _fallback, f"SELECT {_SQL_SHOWN} FROM f_fallback", FILE_TABLES)


def file_candidates(spark, d, g: Graph) -> DataFrame:
    anchors = lines(spark, d, g)
    return ca.dedupe(ca.union([ca.file_symbols(g, adapters.requests(spark, d)), ca.imports(g, anchors), ca.relationships(g, anchors), ca.tests(g, anchors)]))


register("cand_dedupe", lambda s, d: _show(file_candidates(s, d, adapters.graph(s, d))), f"SELECT {_SQL_SHOWN} FROM c_unique", FILE_TABLES)

# scores -------------------------------------------------------------------------------------------


def _lw(*cs: str) -> str:
    return "lower(" + " || ' ' || ".join(f"coalesce({c}, '')" for c in cs) + ")"


def _has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_N = "lower(trim(coalesce({}, '')))"


def _relevance(goal: str) -> str:
    if goal == "failure-modes":
        t = _lw("c.kind", "c.file", "c.text", "c.node_name", "c.qualified_name", "c.symbol_key")
        return f"""CASE WHEN starts_with(c.kind, 'diagnostic.') THEN CASE WHEN coalesce(c.is_vendor, false) THEN 0.5 WHEN c.diagnostic_relation = 'anchor-file' THEN 4.0 WHEN c.diagnostic_relation = 'related' THEN 2.0 ELSE 0.0 END
 WHEN {_has(t, ranking.FAILURE_WORDS)} THEN 4.0 WHEN c.edge_kind = 'references' AND c.confidence < 0.6 THEN 1.0 ELSE 0.0 END"""
    if goal == "call-neighborhood":
        return "CASE WHEN c.kind = 'neighborhood.caller' THEN 2.0 WHEN c.kind = 'neighborhood.callee' THEN 1.8 WHEN c.edge_kind = 'calls' THEN 1.0 ELSE 0.0 END"
    if goal == "dependencies":
        t = _lw("c.kind", "c.file", "c.text", "c.node_name", "c.qualified_name")
        return f"""CASE WHEN c.kind IN ('import', 'include') THEN 2.0 WHEN c.edge_kind = 'uses_type' THEN 2.4 WHEN c.edge_kind = 'references' OR c.node_kind = 'field' THEN 2.0
 WHEN c.edge_kind = 'calls' AND {_has(t, ranking.CONSTRUCTOR_WORDS)} THEN 1.2 WHEN {_has(t, ranking.DEPENDENCY_WORDS)} THEN 1.0 ELSE 0.0 END"""
    return "0.0"


def score_sql(goal: str, of_file: bool, source: str) -> str:
    """Scores over candidates ``source`` with ``g_anchor``; the query is the file's path."""
    policy = "CASE coalesce(c.edge_kind, c.kind) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranking.policy(goal).items()) + " ELSE 0.0 END"
    needle = f"CASE WHEN {_N.format('a.file_path')} <> '' THEN {_N.format('a.file_path')} ELSE {_N.format('a.node_name') if not of_file else repr('')} END"
    lexical = f"CASE WHEN {needle} <> '' AND (" + " OR ".join(f"contains({_N.format('c.' + x)}, {needle})" for x in ("file", "text", "node_name", "qualified_name", "symbol_key")) + ") THEN 1.0 ELSE 0.0 END"
    shared = [
        policy, "CASE WHEN c.edge_id IS NOT NULL THEN 1.5 ELSE 0.0 END", lexical, "CASE WHEN starts_with(c.kind, 'test.') OR contains(lower(coalesce(c.file, '')), 'test') THEN 0.7 ELSE 0.0 END",
        "round(0.5 * least(greatest(c.confidence, 0.0), 1.0), 4)", "-round(0.8 * least(c.token_estimate / 1000.0, 1.0), 4)", _relevance(goal),
    ]
    if of_file:
        noise = "CASE WHEN c.kind IN ('import', 'include') THEN -0.8 WHEN c.kind = 'test.related' THEN -1.0 ELSE 0.0 END" if goal == "explain" else "0.0"
        shared += ["CASE WHEN c.kind = 'file.outline' THEN 4.0 ELSE 0.0 END", "CASE WHEN c.kind = 'file.symbol' THEN 2.2 ELSE 0.0 END", "CASE WHEN c.file = a.file_path THEN 1.4 ELSE 0.0 END", noise]
    else:
        exact = f"CASE WHEN {needle} <> '' AND {needle} IN ({', '.join(_N.format('c.' + x) for x in ('node_name', 'qualified_name', 'symbol_key'))}) THEN 3.0 ELSE 0.0 END"
        near = """CASE WHEN c.file = a.file_path AND c.start_line IS NOT NULL THEN CASE WHEN a.line BETWEEN c.start_line AND c.end_line THEN 1.2
 ELSE round(1.2 * (1.0 - least(abs(a.line - c.start_line), abs(a.line - c.end_line), 20) / 20.0), 4) END ELSE 0.0 END"""
        shared += ["CASE WHEN starts_with(c.kind, 'target.') THEN 5.0 ELSE 0.0 END", exact, near, "CASE WHEN starts_with(c.kind, 'enclosing.') THEN 0.8 ELSE 0.0 END"]
    total = " + ".join(f"CAST({p} AS DOUBLE)" for p in shared)
    return f"SELECT c.*, round({total}, 4) AS score FROM {source} c JOIN g_anchor a ON a.request_id = c.request_id"


def scored_lines(spark, d, goal: str) -> tuple[DataFrame, DataFrame]:
    g = adapters.graph(spark, d)
    anchors = lines(spark, d, g)
    required, optional = ca.for_lines(g, anchors, goal)
    return tuple(ranking.score(ca.with_anchor(c, anchors), goal) for c in (required, optional))


def scored_file(spark, d, goal: str) -> DataFrame:
    g = adapters.graph(spark, d)
    return ranking.score(ca.with_anchor(file_candidates(spark, d, g), lines(spark, d, g)), goal, of_file=True)


_BUDGET = 400
_KEY = {g: g.replace("-", "_") for g in an.GOALS}


def _select_sql(goal: str) -> dict[str, str]:
    """The greedy fold as a recursion that takes one ranked candidate of every request at a time."""
    bonus = "+ CASE WHEN starts_with(kind, 'diagnostic.') THEN CASE WHEN coalesce(is_vendor, false) THEN -5.0 ELSE 5.0 END ELSE 0.0 END" if goal == "failure-modes" else ""
    vendor = "len(list_intersect(string_split(lower(CASE WHEN file IS NULL OR start_line IS NULL THEN kind ELSE file END), '/'), ['external', 'third-party', 'third_party', 'vendor', 'vendors'])) > 0"
    overlap = "list_has_any([true], list_transform(s.ranges, lambda y: x.file = y.f AND ((x.start_line <= y.s AND x.end_line >= y.e)" + (" OR (x.start_line <= y.e AND y.s <= x.end_line)" if goal == "explain" else "") + ")))"
    has = "(x.file IS NOT NULL AND x.start_line IS NOT NULL AND NOT starts_with(x.kind, 'diagnostic.'))"
    verdict = f"""CASE WHEN {has} AND {overlap} THEN 'overlap' WHEN starts_with(x.kind, 'diagnostic.') AND coalesce(x.is_vendor, false) AND s.lost THEN 'budget' WHEN s.used + x.token_estimate <= {_BUDGET} THEN 'selected' ELSE 'budget' END"""
    return base_of(goal) | {
        "s_optional": score_sql(goal, False, "c_optional"),
        "s_start": "SELECT o.request_id, coalesce(r.used, 0) AS used, coalesce(r.ranges, []) AS ranges FROM (SELECT DISTINCT request_id FROM c_optional) o LEFT JOIN (SELECT request_id, sum(token_estimate) AS used, list({'f': file, 's': start_line, 'e': end_line}) FILTER (file IS NOT NULL AND start_line IS NOT NULL) AS ranges FROM c_required GROUP BY 1) r USING (request_id)",
        "s_rank": f"SELECT *, {vendor} AS vendor_name, row_number() OVER (PARTITION BY request_id ORDER BY -(score {bonus}) / greatest(token_estimate, 1), -(score {bonus}), coalesce(file, ''), coalesce(start_line, 0), coalesce(end_line, 0), family, ord) AS place FROM s_optional",
        "s_fold": f"""SELECT * FROM (WITH RECURSIVE fold(request_id, place, family, ord, verdict, used, ranges, lost) AS (
 SELECT request_id, CAST(0 AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CAST(used AS BIGINT), ranges, false FROM s_start
 UNION ALL SELECT request_id, place, family, ord, verdict, CASE WHEN verdict = 'selected' THEN used + tokens ELSE used END, CASE WHEN verdict = 'selected' AND has THEN list_append(ranges, {{'f': file, 's': start_line, 'e': end_line}}) ELSE ranges END, lost OR (verdict = 'budget' AND NOT vendor_name) FROM (
  SELECT x.request_id, x.place, x.family, x.ord, x.file, x.start_line, x.end_line, x.token_estimate AS tokens, x.vendor_name, {has} AS has, s.used, s.ranges, s.lost, {verdict} AS verdict FROM fold s JOIN s_rank x ON x.request_id = s.request_id AND x.place = s.place + 1)
 ) SELECT * FROM fold WHERE place > 0)""",
    }


for _goal in an.GOALS:
    _show_score = ["request_id", "kind", "family", "ord", "score"]
    register(f"score_line_{_KEY[_goal]}", lambda s, d, g=_goal: ca.union(list(scored_lines(s, d, g))).select(*_show_score),
             f"SELECT request_id, kind, family, ord, score FROM ({score_sql(_goal, False, 'c_required')}) UNION ALL SELECT request_id, kind, family, ord, score FROM ({score_sql(_goal, False, 'c_optional')})", base_of(_goal))
    register(f"score_file_{_KEY[_goal]}", lambda s, d, g=_goal: scored_file(s, d, g).select(*_show_score), f"SELECT request_id, kind, family, ord, score FROM ({score_sql(_goal, True, 'c_unique')})", FILE_TABLES)
    register(f"select_budget_{_KEY[_goal]}", lambda s, d, g=_goal: selection.verdicts(*scored_lines(s, d, g), _BUDGET, g).select("request_id", "place", "family", "ord", "kind", "verdict"),
             "SELECT f.request_id, f.place, f.family, f.ord, r.kind, f.verdict FROM s_fold f JOIN s_rank r ON r.request_id = f.request_id AND r.place = f.place", _select_sql(_goal))

# notes and compaction -----------------------------------------------------------------------------


def _notes(spark, d):
    g = adapters.graph(spark, d)
    rows = g.edge.where("unresolved_dst IS NOT NULL AND src_node_id IS NOT NULL").select(F.col("file_id").alias("request_id"), F.col("id").alias("ord"), F.col("kind").alias("edge_kind"), F.concat(F.element_at(F.array(*map(F.lit, ("self.", "a.size", " b  c.", "d:x.y", "e."))), (F.col("id") % 5 + 1).cast("int")), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("unresolved_dst"))).alias("unresolved"))
    return selection.grouped_notes(rows)


_LOW_SQL, _ACC_SQL = quoted(selection.LOW_VALUE), quoted(selection.ACCESSORS)
register(
    "notes_grouped", _notes,
    f"""SELECT request_id, 'unresolved ' || kind || ': ' || target || CASE WHEN n > 1 THEN ' (' || n || ' occurrences)' ELSE '' END AS note, first FROM (SELECT request_id, kind, target, count(*) AS n, min(id) AS first FROM (
 SELECT file_id AS request_id, id, kind, regexp_replace(trim(regexp_replace(u, '\\s+', ' ', 'g')), '\\.$', '') AS target FROM (SELECT *, (['self.', 'a.size', ' b  c.', 'd:x.y', 'e.'])[id % 5 + 1] || CASE WHEN id % 3 = 0 THEN '' ELSE unresolved_dst END AS u FROM g_edge WHERE unresolved_dst IS NOT NULL AND src_node_id IS NOT NULL))
 WHERE target <> '' AND target NOT IN ({_LOW_SQL}) AND string_split(target, '.')[1] NOT IN ({_LOW_SQL}) GROUP BY 1, 2, 3)
 WHERE NOT (n >= 2 AND contains(target, '.') AND NOT contains(target, ':') AND NOT contains(target, '->') AND string_split(target, '.')[-1] IN ({_ACC_SQL}))""",
)


def _compacted(spark, d):
    docs = adapters.table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("request_id"), F.lit("enclosing.type").alias("kind"), "text").withColumn("token_estimate", tx.token_estimate(F.col("text")))
    return selection.compact(rows, 900).select("request_id", "token_estimate", "original_token_estimate", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_MARK = "chr(10) || '... omitted remainder from compacted enclosing context ...' || chr(10)"
_MARK_LEN = len(selection.MARKER)
register(
    "compact_enclosing", _compacted,
    f"""WITH t AS (SELECT doc_id, text, {tokens('text')} AS tk, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS ls FROM documents),
 u AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda k: length(rtrim(array_to_string(list_slice(ls, 1, k), ''), ' ' || chr(9) || chr(10) || chr(13))) + {_MARK_LEN} > 1200) AS over FROM t),
 v AS (SELECT *, CASE WHEN len(over) = 0 THEN len(ls) ELSE over[1] - 1 END AS kept FROM u),
 w AS (SELECT doc_id, tk, text, CASE WHEN tk <= 300 THEN text WHEN len(ls) <= 2 OR kept = 0 THEN rtrim(substr(text, 1, {1200 - _MARK_LEN}), ' ' || chr(9) || chr(10) || chr(13)) || {_MARK} WHEN kept = len(ls) THEN text
  ELSE rtrim(array_to_string(list_slice(ls, 1, kept), ''), ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || '... omitted ' || (len(ls) - kept) || ' lines from compacted enclosing context ...' || chr(10) END AS c FROM v)
 SELECT doc_id AS request_id, {tokens('c')} AS token_estimate, CASE WHEN tk > 300 THEN tk END AS original_token_estimate, md5(c) AS text_md5 FROM w""",
)
