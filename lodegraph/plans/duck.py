"""DuckDB SQL twins: named tables that queries are assembled from, with what they need and nothing more."""

from __future__ import annotations

import re

from lodegraph.functions.text import LANGUAGES, PRUNED, VENDOR
from lodegraph.plans.adapters import BASE, EDGE_BASE, EXTENSIONS, ROLES

_LANG = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items())
_EXT = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS))
_ROLE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items())


def quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def line_count(t: str) -> str:
    return f"CASE WHEN {t} = '' THEN 0 ELSE length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN ends_with({t}, chr(10)) THEN 0 ELSE 1 END END"


def snippet(t: str, s: str, e: str) -> str:
    return (
        f"CASE WHEN {s} >= 1 AND {e} >= {s} AND {e} <= {line_count(t)} THEN array_to_string(list_slice(string_split({t}, chr(10)), CAST({s} AS BIGINT), CAST({e} AS BIGINT)), chr(10)) "
        f"|| CASE WHEN {e} < len(string_split({t}, chr(10))) THEN chr(10) ELSE '' END END"
    )


def tokens(t: str) -> str:
    return f"CAST((length({t}) + 3) // 4 AS BIGINT)"


LANGUAGE = f"CASE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) {_LANG} END"
TESTS = "contains(lower(path), '/test/') OR contains(lower(path), '/tests/') OR starts_with(string_split(lower(path), '/')[-1], 'test_') OR " + " OR ".join(
    f"ends_with(lower(path), '{e}')" for e in ("test.cpp", "test.java", "tests.java", "_test.go", "_test.py", "_test.rs")
)
_NODE_KEY = "coalesce(f.language, 'text') || ':' || f.path || '#' || x.qualified_name"

TABLES = {
    "nd": "SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM orders) AS m",
    "g_path": f"""SELECT doc_id, text, CASE WHEN doc_id % 11 = 0 THEN 'third_party/' ELSE '' END || 'src/' || source || '/' || lang || CASE WHEN doc_id % 5 = 0 THEN '/tests/' ELSE '/' END
 || 'doc_' || doc_id || CASE doc_id % 7 {_EXT} END AS path FROM documents""",
    "g_file": f"""SELECT doc_id AS id, CAST(1 AS BIGINT) AS snapshot_id, path, {LANGUAGE} AS language, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size_bytes, CAST({line_count('text')} AS BIGINT) AS line_count,
 ({TESTS}) AS is_test, (list_has_any(string_split(lower(path), '/'), ['auto-generated', 'autogen', 'gen', 'generated']) OR ends_with(lower(path), '.generated.java')) AS is_generated,
 list_has_any(string_split(lower(path), '/'), [{quoted(VENDOR)}]) AS is_vendor FROM g_path""",
    "g_line": "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents",
    "g_chunk": f"""SELECT CAST(doc_id * 100000 + pos AS BIGINT) AS id, doc_id AS file_id, CASE WHEN doc_id + n * pos < m THEN CAST(doc_id + n * pos + {BASE['orders']} AS BIGINT) END AS node_id,
 CASE WHEN doc_id + n * pos < m THEN 'definition' ELSE 'source' END AS kind, CAST(pos + 1 AS BIGINT) AS start_line, CAST(pos + 1 AS BIGINT) AS end_line, text, {tokens('text')} AS token_estimate FROM g_line, nd""",
    "g_named": "SELECT n_nationkey AS nk, n_name, n_regionkey AS rk, r_name || '.' || n_name AS nq FROM nation JOIN region ON n_regionkey = r_regionkey",
    "g_owned": "SELECT c_custkey, c_name, nq || '.' || c_name AS cq FROM customer JOIN g_named ON c_nationkey = nk",
    "g_bare": f"""SELECT {BASE['region']} + r_regionkey AS id, 'namespace' AS kind, r_name AS name, r_name AS qualified_name, r_regionkey % n AS file_id, 1 AS start_line, 1000 AS end_line, CAST(1.0 AS DOUBLE) AS confidence FROM region, nd
 UNION ALL SELECT {BASE['nation']} + nk, 'namespace', n_name, nq, nk % n, 1, 500, 1.0 FROM g_named, nd
 UNION ALL SELECT {BASE['customer']} + c_custkey, 'type', c_name, cq, c_custkey % n, c_custkey % 7 + 1, c_custkey % 7 + 6 + c_custkey % 11, 0.9 FROM g_owned, nd
 UNION ALL SELECT {BASE['supplier']} + s_suppkey, 'type', s_name, nq || '.' || s_name, s_suppkey % n, s_suppkey % 5 + 1, s_suppkey % 5 + 9, 0.9 FROM supplier JOIN g_named ON s_nationkey = nk, nd
 UNION ALL SELECT {BASE['part']} + p_partkey, 'type', p_name, p_brand || '.' || p_name, p_partkey % n, p_partkey % 9 + 1, p_partkey % 9 + 1 + p_partkey % 4, 0.8 FROM part, nd
 UNION ALL SELECT {BASE['orders']} + o_orderkey, 'callable', 'Order#' || o_orderkey, cq || '.Order#' || o_orderkey, o_orderkey % n, o_orderkey // n + 1, o_orderkey // n + 1 + o_orderkey % 3, 0.75
 FROM orders JOIN g_owned ON o_custkey = c_custkey, nd""",
    "g_node": f"""SELECT CAST(x.id AS BIGINT) AS id, CAST(1 AS BIGINT) AS snapshot_id, x.kind, f.language, x.name, x.qualified_name, {_NODE_KEY} AS symbol_key, CAST(x.file_id AS BIGINT) AS file_id,
 CAST(x.start_line AS BIGINT) AS start_line, CAST(x.end_line AS BIGINT) AS end_line, x.confidence, 'adapter' AS extractor FROM g_bare x LEFT JOIN g_file f ON f.id = x.file_id""",
    "g_item": "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem",
    "g_raw_edge": f"""SELECT {EDGE_BASE['nation']} + n_nationkey AS id, 'contains' AS kind, {BASE['region']} + n_regionkey AS src_node_id, {BASE['nation']} + n_nationkey AS dst_node_id, NULL AS unresolved_dst,
 n_nationkey % n AS file_id, NULL AS start_line, CAST(1.0 AS DOUBLE) AS confidence FROM nation, nd
 UNION ALL SELECT {EDGE_BASE['customer']} + c_custkey, 'contains', {BASE['nation']} + c_nationkey, {BASE['customer']} + c_custkey, NULL, c_custkey % n, NULL, 1.0 FROM customer, nd
 UNION ALL SELECT {EDGE_BASE['supplier']} + s_suppkey, 'contains', {BASE['nation']} + s_nationkey, {BASE['supplier']} + s_suppkey, NULL, s_suppkey % n, NULL, 1.0 FROM supplier, nd
 UNION ALL SELECT {EDGE_BASE['orders']} + o_orderkey, 'contains', {BASE['customer']} + o_custkey, {BASE['orders']} + o_orderkey, NULL, o_orderkey % n, NULL, 1.0 FROM orders, nd
 UNION ALL SELECT (l_orderkey * 1000 + rn) * 2, CASE WHEN l_linenumber % 3 = 0 THEN 'calls' ELSE 'references' END, {BASE['orders']} + l_orderkey,
  CASE WHEN l_returnflag <> 'R' THEN CASE WHEN l_linenumber % 3 = 0 THEN {BASE['orders']} + l_partkey % m ELSE {BASE['part']} + l_partkey END END, CASE WHEN l_returnflag = 'R' THEN 'part#' || l_partkey END,
  l_orderkey % n, CASE WHEN l_linenumber <> 7 THEN l_linenumber END, round(0.5 + l_discount * 5, 4) FROM g_item, nd
 UNION ALL SELECT (l_orderkey * 1000 + rn) * 2 + 1, 'uses_type', {BASE['orders']} + l_orderkey, {BASE['supplier']} + l_suppkey, NULL, l_orderkey % n, CASE WHEN l_linenumber <> 7 THEN l_linenumber END,
  round(0.5 + l_discount * 5, 4) FROM g_item, nd""",
    "g_edge": """SELECT CAST(id AS BIGINT) AS id, CAST(1 AS BIGINT) AS snapshot_id, kind, CAST(src_node_id AS BIGINT) AS src_node_id, CAST(dst_node_id AS BIGINT) AS dst_node_id, CAST(NULL AS VARCHAR) AS unresolved_src, unresolved_dst,
 CAST(file_id AS BIGINT) AS file_id, CAST(start_line AS BIGINT) AS start_line, CAST(start_line AS BIGINT) AS end_line, confidence, CAST(1.0 AS DOUBLE) AS weight, 'adapter' AS extractor FROM g_raw_edge""",
    "g_occurrence": f"""SELECT event_id AS id, CAST(user_id % n AS BIGINT) AS file_id, CASE event_type {_ROLE} END AS role, props AS text, CAST(event_id % 40 + 1 AS BIGINT) AS start_line,
 CAST(event_id % 40 + 1 AS BIGINT) AS end_line, CAST(0.8 AS DOUBLE) AS confidence FROM events, nd""",
    "g_diagnostic": """SELECT event_id AS id, CAST(1 AS BIGINT) AS snapshot_id, CASE WHEN event_id % 13 <> 0 THEN CAST(user_id % n AS BIGINT) END AS file_id, CASE WHEN value > 20 THEN 'error' ELSE 'warning' END AS severity,
 'parse_error' AS code, 'unexpected ' || props AS message, CAST(event_id % 30 + 1 AS BIGINT) AS start_line, CAST(event_id % 30 + 1 + event_id % 2 AS BIGINT) AS end_line FROM events, nd WHERE event_type = 'error'""",
    "g_request": "SELECT item_id AS request_id, CAST(item_id * 31 % n AS BIGINT) AS file_id, CAST(item_id % 5 + 1 AS BIGINT) AS line FROM benchmark, nd",
}

PRUNED_SQL = quoted(PRUNED)


def assemble(final: str, extra: dict[str, str] | None = None) -> str:
    """``final`` after the definitions of every table that it names, directly or through others."""
    known = TABLES | (extra or {})
    wanted: list[str] = []

    def need(sql: str) -> None:
        for name in known:
            if name not in wanted and re.search(rf"\b{name}\b", sql):
                need(known[name])
                if name not in wanted:
                    wanted.append(name)

    need(final)
    if not wanted:
        return final
    return "WITH " + ",\n".join(f"{w} AS MATERIALIZED ({known[w]})" for w in wanted) + "\n" + final
