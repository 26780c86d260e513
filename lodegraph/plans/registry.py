"""The graph engine's registered queries, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text as tx
from lodegraph.operators import anchors as an
from lodegraph.operators import health, incremental, resolve, search, traversal
from lodegraph.plans import adapters, duck
from lodegraph.plans.duck import LANGUAGE, PRUNED_SQL, TESTS, assemble, snippet, tokens
from lodegraph.sources import ignore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None, extra: dict[str, str] | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = assemble(sql, extra)


# search -------------------------------------------------------------------------------------------

_LOW = "lower(coalesce({}, ''))"
_S_NAMES = [_LOW.format(c) for c in ("x.name", "x.qualified_name", "x.symbol_key")]


def _symbol_sql(q: str, limit: int) -> str:
    eq, pre, sub = (" OR ".join(t.format(n) for n in _S_NAMES) for t in (f"{{}} = '{q}'", f"starts_with({{}}, '{q}')", f"contains({{}}, '{q}')"))
    return f"""SELECT x.id, x.kind, x.name, f.path AS file_path, CASE WHEN {eq} THEN 100 WHEN {pre} THEN 80 WHEN {sub} THEN 60 WHEN contains({_LOW.format('f.path')}, '{q}') THEN 40 ELSE 0 END AS score,
 lower(coalesce(nullif(x.qualified_name, ''), nullif(x.name, ''), '')) AS o1, {_LOW.format('f.path')} AS o2, coalesce(x.start_line, 0) AS o3
 FROM g_node x LEFT JOIN g_file f ON f.id = x.file_id"""


def _symbols(q: str, limit: int = 20):
    def query(spark, d):
        g = adapters.graph(spark, d)
        return search.search_symbols(g.node, g.file, q, limit).select("id", "kind", "name", "file_path", "score")

    inner = _symbol_sql(q.strip().lower(), limit)
    return query, f"SELECT id, kind, name, file_path, score FROM ({inner}) WHERE score > 0 ORDER BY score DESC, o1, o2, o3, id LIMIT {limit}"


for _name, _q in {"exact": "NATION_3", "prefix": " customer#00000001", "substr": "order#12", "path": "src4/en"}.items():
    register(f"symbol_search_{_name}", *_symbols(_q))


def _chunk_search(spark, d):
    g = adapters.graph(spark, d)
    return search.search_chunks(g.chunk, g.file, "The and", 50).select("id", "file_path", "start_line", "score")


register(
    "chunk_search", _chunk_search,
    """SELECT c.id, f.path AS file_path, c.start_line, CASE WHEN starts_with(lower(c.text), 'the and') THEN 80 ELSE 60 END AS score FROM g_chunk c JOIN g_file f ON f.id = c.file_id
 WHERE contains(lower(c.text), 'the and') ORDER BY score DESC, lower(f.path), c.start_line, c.id LIMIT 50""",
)

_ORDER_7 = adapters.BASE["orders"] + 7


def _inspect_node(spark, d):
    g = adapters.graph(spark, d)
    return search.inspect_node(g.node, g.file, _ORDER_7)


register("inspect_node", _inspect_node, f"SELECT x.*, f.path AS file_path FROM g_node x LEFT JOIN g_file f ON f.id = x.file_id WHERE x.id = {_ORDER_7}")


def _inspect_edge(spark, d):
    g = adapters.graph(spark, d)
    return search.inspect_edge(g.edge, g.node, g.file, 10_002).drop("snapshot_id", "extractor")


register(
    "inspect_edge", _inspect_edge,
    """SELECT e.* EXCLUDE (snapshot_id, extractor), f.path AS file_path, s.name AS src_name, s.qualified_name AS src_qualified_name, s.kind AS src_kind, t.name AS dst_name, t.qualified_name AS dst_qualified_name, t.kind AS dst_kind
 FROM g_edge e LEFT JOIN g_file f ON f.id = e.file_id LEFT JOIN g_node s ON s.id = e.src_node_id LEFT JOIN g_node t ON t.id = e.dst_node_id WHERE e.id = 10002""",
)

_BM25 = {
    "t_sym": "SELECT x.id, concat_ws(' ', coalesce(x.name, ''), coalesce(x.qualified_name, ''), coalesce(x.symbol_key, ''), coalesce(f.path, '')) AS text FROM g_node x LEFT JOIN g_file f ON f.id = x.file_id",
    "t_chunk": "SELECT id, text FROM g_chunk",
}


def _bm25_sql(docs: str, words: list[str]) -> str:
    """BM25 of single-word terms."""
    toks = f"list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda w: w <> '')"
    hits = " UNION ALL ".join(f"SELECT id, dl, {k} AS phrase, len(list_filter(ws, lambda w: w = '{w}')) AS f FROM bm_t" for k, w in enumerate(words))
    return f"""SELECT id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avglen))) AS bm25 FROM
 (WITH bm_t AS MATERIALIZED (SELECT id, {toks} AS ws, len({toks}) AS dl FROM {docs}), bm_h AS MATERIALIZED (SELECT * FROM ({hits}) WHERE f > 0)
  SELECT h.id, h.dl, h.f, count(*) OVER (PARTITION BY phrase) AS df, (SELECT count(*) FROM bm_t) AS n, (SELECT avg(dl) FROM bm_t) AS avglen FROM bm_h h) GROUP BY id HAVING count(*) = {len(words)}"""


def _full_text(which: str, words: list[str]):
    def query(spark, d):
        g = adapters.graph(spark, d)
        docs = search.symbol_documents(g.node, g.file) if which == "t_sym" else g.chunk.select("id", "text")
        top = search.bm25(docs, " ".join(words)).withColumn("bm25", F.round("bm25", 6))
        return top.orderBy("bm25", "id").limit(50)

    return query, f"SELECT id, round(bm25, 6) AS bm25 FROM ({_bm25_sql(which, words)}) ORDER BY 2, 1 LIMIT 50", _BM25


register("fts_symbol_bm25", *_full_text("t_sym", ["nation", "17"]))
register("fts_chunk_bm25", *_full_text("t_chunk", ["and", "of"]))


def _merged(spark, d):
    g = adapters.graph(spark, d)
    return search.search(g.node, g.file, "src4 en", 30)


register(
    "search_merged", lambda s, d: search.search((g := adapters.graph(s, d)).node, g.file, "nation_17", 30),
    f"""SELECT id, score, row_number() OVER (ORDER BY list, rank) AS rank FROM (SELECT id, min(struct_pack(list := list, rank := rank, score := score)) AS m, m.list AS list, m.rank AS rank, m.score AS score FROM (
 SELECT id, 120 AS score, 0 AS list, row_number() OVER (ORDER BY round(bm25, 9), id) AS rank FROM m_fts UNION ALL
 SELECT id, score, 1 AS list, row_number() OVER (ORDER BY score DESC, o1, o2, o3, id) AS rank FROM m_like) WHERE rank <= 30 GROUP BY id) ORDER BY list, rank LIMIT 30""",
    _BM25 | {"m_like": f"SELECT * FROM ({_symbol_sql('region_2', 30)}) WHERE score > 0", "m_fts": _bm25_sql("t_sym", ["region", "2"])},
)
del ORACLE_SQL["search_merged"]  # its query is a phrase, which the twin doesn't match


register(
    "search_merged_words", _merged,
    """SELECT id, score, row_number() OVER (ORDER BY list, rank) AS rank FROM (SELECT id, m.list AS list, m.rank AS rank, m.score AS score FROM (SELECT id, min(struct_pack(list := list, rank := rank, score := score)) AS m FROM (
 SELECT id, 120 AS score, 0 AS list, row_number() OVER (ORDER BY round(bm25, 9), id) AS rank FROM m_fts UNION ALL
 SELECT id, score, 1 AS list, row_number() OVER (ORDER BY score DESC, o1, o2, o3, id) AS rank FROM m_like) WHERE rank <= 30 GROUP BY id)) ORDER BY list, rank LIMIT 30""",
    _BM25 | {"m_like": f"SELECT * FROM ({_symbol_sql('src4 en', 30)}) WHERE score > 0", "m_fts": _bm25_sql("t_sym", ["src4", "en"])},
)

# traversal ----------------------------------------------------------------------------------------

_DEFAULT = duck.quoted(traversal.DEFAULT_KINDS)


def _steps_sql(direction: str) -> str:
    out = f"SELECT src_node_id AS hub, id, kind, start_line, 0 AS place, dst_node_id AS adjacent FROM g_edge WHERE src_node_id IS NOT NULL AND kind IN ({_DEFAULT})"
    into = f"SELECT dst_node_id AS hub, id, kind, start_line, 1 AS place, src_node_id AS adjacent FROM g_edge WHERE dst_node_id IS NOT NULL AND kind IN ({_DEFAULT})"
    return {"out": out, "in": into}.get(direction, f"{out} UNION ALL {into}")


def _neighborhood(seed: int, depth: int, direction: str, limit: int, nodes: bool):
    def query(spark, d):
        g = adapters.graph(spark, d)
        found, edges = traversal.neighborhood(g.edge, seed, depth, direction, limit=limit)
        if nodes:
            return traversal.hydrate_nodes(found, g.node, g.file).select("node_id", "depth", "kind", "qualified_name", "file_path")
        return traversal.hydrate_edges(edges, g.edge).select("edge_id", "depth", "kind", "src_node_id", "dst_node_id", "unresolved_dst")

    extra = {"n_steps": _steps_sql(direction), "n_v0": f"SELECT CAST({seed} AS BIGINT) AS node_id, 0 AS depth", "n_e0": "SELECT CAST(NULL AS BIGINT) AS edge_id, 0 AS depth, CAST(NULL AS BIGINT) AS o WHERE false"}
    order = "hub, kind, start_line NULLS FIRST, id, place"
    for k in range(1, depth + 1):
        p = k - 1
        extra[f"n_r{k}"] = f"SELECT s.*, row_number() OVER (ORDER BY {order}) AS o FROM n_steps s JOIN n_v{p} v ON v.node_id = s.hub AND v.depth = {p} WHERE (SELECT count(*) FROM n_v{p}) < {limit} OR {p} = 0"
        extra[f"n_a{k}"] = f"SELECT adjacent AS node_id, min(o) AS o FROM n_r{k} WHERE adjacent IS NOT NULL AND adjacent NOT IN (SELECT node_id FROM n_v{p}) GROUP BY 1 ORDER BY 2 LIMIT (SELECT greatest({limit} - count(*), 0) FROM n_v{p})"
        extra[f"n_v{k}"] = f"SELECT * FROM n_v{p} UNION ALL SELECT node_id, {k} FROM n_a{k}"
        extra[f"n_e{k}"] = f"""SELECT * FROM n_e{p} UNION ALL SELECT * FROM (SELECT id AS edge_id, {k} AS depth, min(o) AS o FROM (SELECT id, hub, min(o) AS o, bool_and(adjacent IS NULL OR adjacent IN (SELECT node_id FROM n_v{k})) AS ok FROM n_r{k} GROUP BY id, hub)
 WHERE ok AND id NOT IN (SELECT edge_id FROM n_e{p}) GROUP BY 1 ORDER BY 3 LIMIT (SELECT greatest({limit} - count(*), 0) FROM n_e{p}))"""
    if nodes:
        sql = f"SELECT v.node_id, CAST(v.depth AS INTEGER) AS depth, x.kind, x.qualified_name, f.path AS file_path FROM n_v{depth} v JOIN g_node x ON x.id = v.node_id LEFT JOIN g_file f ON f.id = x.file_id"
    else:
        # in order: DuckDB hangs over the join as it is when a LIMIT is put around it
        sql = f"SELECT e.edge_id, CAST(e.depth AS INTEGER) AS depth, x.kind, x.src_node_id, x.dst_node_id, x.unresolved_dst FROM n_e{depth} e JOIN g_edge x ON x.id = e.edge_id ORDER BY e.edge_id"
    return query, sql, extra


_ORDER_11, _SUPPLIER_3 = adapters.BASE["orders"] + 11, adapters.BASE["supplier"] + 3
register("neighborhood_out_d1", *_neighborhood(_ORDER_11, 1, "out", 50, True))
register("neighborhood_out_d1_edges", *_neighborhood(_ORDER_11, 1, "out", 50, False))
register("neighborhood_in_d1", *_neighborhood(_SUPPLIER_3, 1, "in", 50, True))
register("neighborhood_both_d2_limit", *_neighborhood(_ORDER_11, 2, "both", 40, True))
register("neighborhood_both_d2_limit_edges", *_neighborhood(_ORDER_11, 2, "both", 40, False))


def _reach(spark, d):
    g = adapters.graph(spark, d)
    seeds = spark.createDataFrame([(0, adapters.BASE["region"]), (1, adapters.BASE["region"] + 1)], "request_id long, node_id long")
    return traversal.reachable(g.edge, seeds, 2, ("contains",))


register(
    "reachability_recursive", _reach,
    f"""SELECT request_id, node_id, CAST(min(depth) AS INTEGER) AS depth FROM (WITH RECURSIVE r(request_id, node_id, depth) AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST({adapters.BASE['region']} AS BIGINT), 0), (1, {adapters.BASE['region'] + 1}, 0))
 UNION SELECT request_id, dst_node_id, depth + 1 FROM r JOIN g_edge ON src_node_id = node_id AND kind = 'contains' WHERE depth < 2 AND dst_node_id IS NOT NULL) SELECT * FROM r) GROUP BY 1, 2""",
)

# anchors ------------------------------------------------------------------------------------------

_RANK = "CASE x.kind WHEN 'callable' THEN 0 WHEN 'field' THEN 1 WHEN 'type' THEN 2 WHEN 'namespace' THEN 3 ELSE 4 END"
ANCHORS = {
    "g_anchor": f"""SELECT r.request_id, r.file_id, f.path AS file_path, r.line, b.id AS node_id, b.kind AS node_kind, b.name AS node_name, b.qualified_name, b.symbol_key, b.start_line, b.end_line
 FROM g_request r JOIN g_file f ON f.id = r.file_id AND r.line BETWEEN 1 AND f.line_count
 LEFT JOIN (SELECT r2.request_id AS rid, x.*, row_number() OVER (PARTITION BY r2.request_id ORDER BY x.end_line - x.start_line, {_RANK}, x.start_line DESC, x.id) AS rn
            FROM g_request r2 JOIN g_node x ON x.file_id = r2.file_id AND x.start_line <= r2.line AND x.end_line >= r2.line) b ON b.rid = r.request_id AND b.rn = 1""",
    "g_first_chunk": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, file_id ORDER BY start_line, id) AS rn FROM g_chunk WHERE node_id IS NOT NULL) WHERE rn = 1",
    "g_loose_chunk": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN kind = 'file' THEN 0 ELSE 1 END, start_line, id) AS rn FROM g_chunk WHERE node_id IS NULL) WHERE rn = 1",
}


def lines(spark, d, g):
    """Anchors of all requests; every family of candidates starts from them, so they are held (a row a request)."""
    return an.known(an.line_anchor(adapters.requests(spark, d), g.file, g.node))


register("anchor_smallest_node", lambda s, d: lines(s, d, adapters.graph(s, d)), "SELECT * FROM g_anchor", ANCHORS)


def _anchor_file(spark, d):
    g = adapters.graph(spark, d)
    asked = adapters.requests(spark, d).join(g.file.select(F.col("id").alias("file_id"), "path"), "file_id").select("request_id", "path")
    return an.file_anchor(g.file, asked)


register("anchor_file", _anchor_file, "SELECT r.request_id, f.id AS file_id, f.path, f.language, f.line_count FROM g_request r JOIN g_file f ON f.id = r.file_id")
register(
    "anchor_nearest_chunk", lambda s, d: an.nearest_chunk(adapters.requests(s, d).withColumn("line", F.col("line") * 9), adapters.graph(s, d).chunk),
    """SELECT request_id, id AS chunk_id, distance FROM (SELECT r.request_id, c.id, CAST(CASE WHEN c.end_line < r.line * 9 THEN r.line * 9 - c.end_line WHEN c.start_line > r.line * 9 THEN c.start_line - r.line * 9 ELSE 0 END AS BIGINT) AS distance,
 row_number() OVER (PARTITION BY r.request_id ORDER BY CASE WHEN r.line * 9 BETWEEN c.start_line AND c.end_line THEN 0 ELSE 1 END, distance, c.end_line - c.start_line, c.start_line, c.id) AS rn FROM g_request r JOIN g_chunk c ON c.file_id = r.file_id) WHERE rn = 1""",
)


def _anchor_symbol(spark, d):
    g = adapters.graph(spark, d)
    return an.symbol_anchor(g.node, g.file, g.chunk, "Order#10").select("node_id", "file_id", "name", "score", "chunk_id", "chunk_start")


register(
    "anchor_symbol", _anchor_symbol,
    f"""SELECT s.id AS node_id, x.file_id, s.name, s.score, c.id AS chunk_id, c.start_line AS chunk_start FROM (SELECT * FROM ({_symbol_sql('order#10', 1)}) WHERE score > 0 ORDER BY score DESC, o1, o2, o3, id LIMIT 1) s JOIN g_node x ON x.id = s.id
 LEFT JOIN g_first_chunk c ON c.node_id = s.id AND c.file_id = x.file_id""", ANCHORS,
)


def _snippets(spark, d):
    g = adapters.graph(spark, d)
    rows = adapters.requests(spark, d).join(g.source, "file_id").join(g.file.select(F.col("id").alias("file_id"), "line_count"), "file_id")
    cut = tx.snippet_with_context(F.col("text"), F.col("line"), F.col("line") + 1, 2)
    return rows.select("request_id", cut.alias("text"), F.substring(tx.byte_range(F.col("text").cast("binary"), F.lit(2), F.lit(9)), 1, 7).alias("b")).select("request_id", "text", F.hex("b").alias("bytes"))


register(
    "snippet_context", _snippets,
    f"""SELECT r.request_id, CASE WHEN r.line + 1 <= f.line_count THEN {snippet('d.text', 'greatest(r.line - 2, 1)', 'least(r.line + 3, f.line_count)')} END AS text, CASE WHEN strlen(d.text) >= 9 THEN substr(hex(encode(d.text)), 5, 14) END AS bytes
 FROM g_request r JOIN documents d ON d.doc_id = r.file_id JOIN g_file f ON f.id = r.file_id""",
)

# resolution ---------------------------------------------------------------------------------------

_TYPES = """SELECT language, name, min(symbol_key) AS symbol_key FROM (SELECT DISTINCT language, symbol_key, unnest([name, qualified_name, string_split(string_split(qualified_name, '.')[-1], '::')[-1]]) AS name FROM g_node
 WHERE kind = 'type' AND symbol_key IS NOT NULL AND language IS NOT NULL) WHERE name IS NOT NULL AND name <> '' GROUP BY 1, 2 HAVING count(DISTINCT symbol_key) = 1"""
register("type_resolution_unique", lambda s, d: resolve.unique_types(adapters.graph(s, d).node), "SELECT * FROM g_types", {"g_types": _TYPES})


def _edge_facts(spark, d, g):
    """Type uses as facts before persistence: by keys, every second one unresolved under the type's name."""
    src = g.node.select(F.col("id").alias("src_node_id"), F.col("symbol_key").alias("src_key"))
    dst = g.node.select(F.col("id").alias("dst_node_id"), F.col("symbol_key").alias("k"), F.col("name").alias("nm"))
    e = g.edge.where("kind = 'uses_type'").select("id", "kind", "src_node_id", "dst_node_id").join(src, "src_node_id").join(dst, "dst_node_id")
    lost = F.col("id") % 4 == 1
    return e.select("id", "kind", "src_key", F.when(~lost, F.col("k")).alias("dst_key"), F.lit(None).cast("string").alias("unresolved_src"), F.when(lost, F.col("nm")).alias("unresolved_dst"))


_FACTS = {
    "g_types": _TYPES,
    "g_fact": """SELECT e.id, e.kind, s.symbol_key AS src_key, CASE WHEN e.id % 4 <> 1 THEN t.symbol_key END AS dst_key, CASE WHEN e.id % 4 = 1 THEN t.name END AS unresolved_dst
 FROM g_edge e JOIN g_node s ON s.id = e.src_node_id JOIN g_node t ON t.id = e.dst_node_id WHERE e.kind = 'uses_type'""",
}


def _edges_resolved(spark, d):
    g = adapters.graph(spark, d)
    return resolve.resolve_edges(_edge_facts(spark, d, g), resolve.unique_types(g.node)).select("id", "src_key", "dst_key", "unresolved_dst")


register(
    "edges_resolved", _edges_resolved,
    """SELECT f.id, f.src_key, coalesce(f.dst_key, t.symbol_key) AS dst_key, CASE WHEN t.symbol_key IS NULL THEN f.unresolved_dst END AS unresolved_dst
 FROM g_fact f LEFT JOIN g_types t ON f.dst_key IS NULL AND f.unresolved_dst = t.name AND string_split(f.src_key, ':')[1] = t.language""", _FACTS,
)


def _occurrences_resolved(spark, d):
    g = adapters.graph(spark, d)
    lang = g.file.select(F.col("id").alias("file_id"), "language")
    named = g.occurrence.where("role = 'type_reference'").join(lang, "file_id").select("id", "role", "language", F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 40).cast("string"), 9, "0")).alias("text"), F.lit(None).cast("string").alias("resolved_key"))
    return resolve.resolve_occurrences(named, resolve.unique_types(g.node)).select("id", "text", "resolved_key")


register(
    "occurrences_resolved", _occurrences_resolved,
    """SELECT o.id, o.text, t.symbol_key AS resolved_key FROM (SELECT o.id, f.language, 'Supplier#' || lpad(CAST(o.id % 40 AS VARCHAR), 9, '0') AS text FROM g_occurrence o JOIN g_file f ON f.id = o.file_id WHERE o.role = 'type_reference') o
 LEFT JOIN g_types t ON t.language = o.language AND t.name = o.text""", _FACTS,
)


def _keyed_by_name(g):
    """Nodes under colliding keys: language and name only, as redefinitions are."""
    return g.node.withColumn("symbol_key", F.concat(F.coalesce("language", F.lit("text")), F.lit(":"), "name"))


register("symbol_key_last_wins", lambda s, d: resolve.last_wins(_keyed_by_name(adapters.graph(s, d))), "SELECT coalesce(language, 'text') || ':' || name AS symbol_key, max(id) AS node_id FROM g_node GROUP BY 1")


def _dangling(spark, d):
    g = adapters.graph(spark, d)
    facts = _edge_facts(spark, d, g).withColumn("dst_key", F.when(F.col("id") % 10 == 3, F.concat("dst_key", F.lit("?"))).otherwise(F.col("dst_key")))
    return resolve.attach(facts, resolve.last_wins(g.node)).select("id", "src_node_id", "dst_node_id", "unresolved_src", "unresolved_dst")


register(
    "dangling_to_unresolved", _dangling,
    """SELECT f.id, s.node_id AS src_node_id, t.node_id AS dst_node_id, CASE WHEN s.node_id IS NULL THEN f.src_key END AS unresolved_src, coalesce(f.unresolved_dst, CASE WHEN t.node_id IS NULL THEN f.dk END) AS unresolved_dst
 FROM (SELECT *, CASE WHEN id % 10 = 3 THEN dst_key || '?' ELSE dst_key END AS dk FROM g_fact) f LEFT JOIN g_keys s ON s.symbol_key = f.src_key LEFT JOIN g_keys t ON t.symbol_key = f.dk""",
    _FACTS | {"g_keys": "SELECT symbol_key, max(id) AS node_id FROM g_node WHERE symbol_key IS NOT NULL GROUP BY 1"},
)


def _path_ids(spark, d):
    g = adapters.graph(spark, d)
    facts = g.diagnostic.join(g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id", "left").drop("file_id").select("id", F.when(F.col("id") % 7 != 0, F.col("file_path")).alias("file_path"))
    return resolve.attach_files(facts, g.file).select("id", "file_id")


register("path_to_file_id", _path_ids, "SELECT id, CASE WHEN id % 7 <> 0 THEN file_id END AS file_id FROM g_diagnostic")
register(
    "id_assignment", lambda s, d: resolve.number(adapters.graph(s, d).chunk.select("file_id", "start_line", F.col("id").alias("chunk_id")), "file_id", ["start_line"], "new_id"),
    "SELECT id AS chunk_id, file_id, start_line, row_number() OVER (ORDER BY file_id, start_line) AS new_id FROM g_chunk",
)

# health -------------------------------------------------------------------------------------------

register(
    "index_stats", lambda s, d: health.index_stats(adapters.graph(s, d)),
    " UNION ALL ".join(f"SELECT '{t}s' AS key, CAST(count(*) AS VARCHAR) AS value FROM g_{t}" for t in ("file", "node", "edge", "occurrence", "chunk", "diagnostic"))
    + " UNION ALL SELECT 'unresolved_references', CAST(count(unresolved_src) + count(unresolved_dst) AS VARCHAR) FROM g_edge UNION ALL SELECT 'language.' || coalesce(language, 'unknown'), CAST(count(*) AS VARCHAR) FROM g_file GROUP BY 1",
)


def _broken_edges(g):
    """Edges with some ends knocked out."""
    return g.edge.withColumn("src_node_id", F.when(F.col("id") % 97 != 0, F.col("src_node_id"))).withColumn("dst_node_id", F.when(F.col("id") % 89 != 0, F.col("dst_node_id")))


_BROKEN = {"g_broken": "SELECT * REPLACE (CASE WHEN id % 97 <> 0 THEN src_node_id END AS src_node_id, CASE WHEN id % 89 <> 0 THEN dst_node_id END AS dst_node_id) FROM g_edge"}
_EDGE_PROBLEMS = """SELECT id, 'edge ' || id || ' has unresolved ' || kind || ' endpoint' AS problem FROM g_broken
 WHERE (src_node_id IS NULL AND unresolved_src IS NULL) OR (dst_node_id IS NULL AND unresolved_dst IS NULL AND kind NOT IN ('contains', 'defines', 'declares', 'diagnostic_for'))"""
register("integrity_edges", lambda s, d: health.edge_problems(_broken_edges(adapters.graph(s, d))), _EDGE_PROBLEMS, _BROKEN)


def _shifted(g):
    """Spans with some lines out of place."""
    from dataclasses import replace

    out = {}
    for t in ("node", "edge", "diagnostic", "occurrence", "chunk"):
        df = getattr(g, t)
        out[t] = df.withColumn("start_line", F.when(F.col("id") % 101 == 0, F.col("start_line") - 100).when(F.col("id") % 103 == 0, F.col("start_line") + 1000).otherwise(F.col("start_line")))
    out["node"] = out["node"].withColumn("file_id", F.when(F.col("id") % 107 == 0, F.lit(-5).cast("long")).otherwise(F.col("file_id")))
    return replace(g, **out)


_MOVE = "CASE WHEN id % 101 = 0 THEN start_line - 100 WHEN id % 103 = 0 THEN start_line + 1000 ELSE start_line END"
_SPAN_SQL = " UNION ALL ".join(
    f"SELECT {k} AS place, '{t}' AS t, id, {'CASE WHEN id % 107 = 0 THEN -5 ELSE file_id END' if t == 'node' else 'file_id'} AS file_id, {_MOVE} AS sl, end_line AS el FROM g_{t}" for k, t in enumerate(("node", "edge", "diagnostic", "occurrence", "chunk"))
)
_SPAN_CHECKS = [(3, "s.sl > s.el", "has start_line after end_line"), (4, "s.sl < 1", "has non-positive start_line"), (5, "s.el < 1", "has non-positive end_line"), (6, "s.file_id IS NOT NULL AND f.id IS NULL", "references a file outside the snapshot"), (9, "s.sl > f.line_count", "start_line exceeds file line count"), (10, "s.el > f.line_count", "end_line exceeds file line count")]
register(
    "integrity_spans", lambda s, d: health.span_problems(_shifted(adapters.graph(s, d))),
    " UNION ALL ".join(f"SELECT s.place, s.id, {n} AS nth, s.t || ' ' || s.id || ' {m}' AS problem FROM g_spans s LEFT JOIN g_file f ON f.id = s.file_id WHERE {c}" for n, c, m in _SPAN_CHECKS), {"g_spans": _SPAN_SQL},
)


def _fk(spark, d):
    g = adapters.graph(spark, d)
    chunk = g.chunk.withColumn("file_id", F.when(F.col("id") % 997 == 0, F.lit(-1).cast("long")).otherwise(F.col("file_id")))
    return health.foreign_key_problems({"file": g.file.drop("snapshot_id"), "node": g.node.drop("snapshot_id"), "edge": g.edge.drop("snapshot_id"), "chunk": chunk, "occurrence": g.occurrence, "diagnostic": g.diagnostic.drop("snapshot_id")})


def _fk_sql() -> str:
    parts = []
    for child, column, parent in (("node", "file_id", "file"), ("edge", "src_node_id", "node"), ("edge", "dst_node_id", "node"), ("edge", "file_id", "file"), ("occurrence", "file_id", "file"), ("chunk", "node_id", "node"), ("diagnostic", "file_id", "file")):
        parts.append(f"SELECT '{child}' AS child, '{column}' AS fk_column, '{parent}' AS parent, id FROM g_{child} c WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM g_{parent})")
    parts.append("SELECT 'chunk', 'file_id', 'file', id FROM g_chunk WHERE id % 997 = 0")
    return " UNION ALL ".join(parts)


register("integrity_fk", _fk, _fk_sql())


def _summary(spark, d):
    g = adapters.graph(spark, d)
    return health.summary({"edges": health.edge_problems(_broken_edges(g)), "sound_edges": health.edge_problems(g.edge), "spans": health.span_problems(g).select("id", "problem")})


register(
    "integrity_summary", _summary,
    """SELECT 'edges' AS check_name, 'failed (' || count(*) || ')' AS status, string_agg(CASE WHEN rn <= 10 THEN problem END, '; ' ORDER BY id) AS problems FROM (SELECT *, row_number() OVER (ORDER BY id, problem) AS rn FROM g_problem)
 UNION ALL SELECT 'sound_edges', 'ok', '' UNION ALL SELECT 'spans', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'failed (' || count(*) || ')' END, coalesce(string_agg(CASE WHEN rn <= 10 THEN problem END, '; ' ORDER BY id, problem), '')
 FROM (SELECT *, row_number() OVER (ORDER BY id, problem) AS rn FROM g_sound_spans)""",
    _BROKEN | {
        "g_problem": _EDGE_PROBLEMS,
        "g_all_spans": " UNION ALL ".join(f"SELECT '{t}' AS t, id, file_id, start_line AS sl, end_line AS el FROM g_{t}" for t in ("node", "edge", "diagnostic", "occurrence", "chunk")),
        "g_sound_spans": " UNION ALL ".join(f"SELECT s.id, s.t || ' ' || s.id || ' {m}' AS problem FROM g_all_spans s LEFT JOIN g_file f ON f.id = s.file_id WHERE {c}" for _, c, m in _SPAN_CHECKS),
    },
)

# incremental --------------------------------------------------------------------------------------

register("scan_order", lambda s, d: adapters.graph(s, d).file.select("id", F.substring(F.sha2(tx.scan_key(F.col("path")).cast("binary"), 256), 1, 16).alias("k")),
         "SELECT id, substr(sha256(array_to_string(list_transform(string_split(path, '/'), lambda p, i: CASE WHEN i = len(string_split(path, '/')) THEN '0' ELSE '1' END || p), chr(1))), 1, 16) AS k FROM g_file")
_SCAN_KEY = "array_to_string(list_transform(string_split(path, '/'), lambda p, i: CASE WHEN i = len(string_split(path, '/')) THEN '0' ELSE '1' END || p), chr(1))"
register(
    "fingerprint", lambda s, d: incremental.fingerprint(adapters.graph(s, d).file.withColumn("root", F.coalesce("language", F.lit("none"))), ["root"]),
    f"SELECT coalesce(language, 'none') AS root, sha256(string_agg(path || chr(0) || content_hash || chr(0), '' ORDER BY {_SCAN_KEY})) AS fingerprint FROM g_file GROUP BY 1",
)


def _cache(spark, d):
    """Cached facts of two files in three, some under another hash or version, some unreadable."""
    f = adapters.graph(spark, d).file
    i = F.col("id")
    return f.where("id % 3 <> 0").select(
        "path", "language", F.when(i % 5 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"), F.when(i % 7 == 1, "v0").otherwise("v1").alias("cache_version"),
        F.when(i % 11 == 0, "[broken").otherwise(F.concat(F.lit('{"n":'), i.cast("string"), F.lit("}"))).alias("facts_json"), F.timestamp_seconds(F.lit(1_700_000_000) + i).alias("updated_at"),
    )


register("cache_hits_misses", lambda s, d: incremental.cache_probe(adapters.graph(s, d).file.where("language IS NOT NULL"), _cache(s, d), "v1").select("id", "path", "hit"),
         "SELECT id, path, (id % 3 <> 0 AND id % 5 <> 0 AND id % 7 <> 1 AND id % 11 <> 0) AS hit FROM g_file WHERE language IS NOT NULL")
register("index_mode", lambda s, d: incremental.mode(incremental.cache_probe(adapters.graph(s, d).file.where("language IS NOT NULL"), _cache(s, d), "v1")),
         "SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, CASE WHEN count(*) FILTER (hit) = 0 THEN 'full' ELSE 'incremental' END AS mode FROM (SELECT (id % 3 <> 0 AND id % 5 <> 0 AND id % 7 <> 1 AND id % 11 <> 0) AS hit FROM g_file WHERE language IS NOT NULL)")


def _upsert(spark, d):
    old = _cache(spark, d).where("language IS NOT NULL")
    new = old.where("path LIKE '%/en/%'").withColumn("facts_json", F.lit('{"new":1}')).withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 DAY"))
    return incremental.cache_upsert(old, new).select("path", "content_hash", "cache_version", "facts_json")


register("cache_upsert", _upsert,
         """SELECT path, CASE WHEN id % 5 = 0 THEN 'stale' ELSE content_hash END AS content_hash, CASE WHEN id % 7 = 1 THEN 'v0' ELSE 'v1' END AS cache_version,
 CASE WHEN contains(path, '/en/') THEN '{"new":1}' WHEN id % 11 = 0 THEN '[broken' ELSE '{"n":' || id || '}' END AS facts_json FROM g_file WHERE id % 3 <> 0 AND language IS NOT NULL""")  # fmt: skip


def _latest(spark, d):
    orders = adapters.table(spark, d, "orders")
    repo = adapters.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("/root/"), "c_mktsegment").alias("root_path"))
    return incremental.latest_snapshot(orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo_id"), F.col("o_orderdate").alias("indexed_at")), repo)


register("latest_snapshot", _latest, "SELECT root_path, o_orderkey AS snapshot_id FROM (SELECT '/root/' || c_mktsegment AS root_path, o_orderkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rn = 1")

# scanning -----------------------------------------------------------------------------------------


def _file_columns(*names: str):
    return lambda s, d: adapters.graph(s, d).file.select("id", *names)


register("scan_language", _file_columns("path", "language"), f"SELECT doc_id AS id, path, {LANGUAGE} AS language FROM g_path")
register("scan_is_test", _file_columns("is_test"), f"SELECT doc_id AS id, ({TESTS}) AS is_test FROM g_path")
register("scan_vendor", _file_columns("is_vendor", "is_generated"), "SELECT id, is_vendor, is_generated FROM g_file")
register("scan_line_count", _file_columns("line_count", "size_bytes"), "SELECT id, line_count, size_bytes FROM g_file")
register("scan_hash", _file_columns("content_hash"), "SELECT id, content_hash FROM g_file")
register("token_estimate", lambda s, d: adapters.graph(s, d).chunk.select("id", "token_estimate"), f"SELECT id, {tokens('text')} AS token_estimate FROM g_chunk")


def _urls(spark, d):
    """Page urls' paths as file paths."""
    return adapters.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_replace(F.regexp_extract("url", "^[^:]*://([^?#]*)", 1), "/$", "").alias("path"))


_URLS = {"u_path": "SELECT page_id AS id, regexp_replace(regexp_extract(url, '^[^:]*://([^?#]*)', 1), '/$', '') AS path FROM pages"}
register("scan_prune", lambda s, d: _urls(s, d).select("id", tx.is_pruned(F.concat(F.when(F.col("id") % 5 == 0, "bazel-x/").when(F.col("id") % 7 == 0, "a/target/").otherwise(""), "path")).alias("pruned")),
         f"SELECT id, len(list_filter(list_slice(string_split(p, '/'), 1, len(string_split(p, '/')) - 1), lambda x: x IN ({PRUNED_SQL}) OR starts_with(x, 'bazel-'))) > 0 AS pruned FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'bazel-x/' WHEN id % 7 = 0 THEN 'a/target/' ELSE '' END || path AS p FROM u_path)", _URLS)
_SPECS = [("", ["*.html", "!*5.html", "www.*/"]), ("www.cheap-pills.example.com", ["!de/", "/de/6*"])]


def _ignored(spark, d):
    specs = [(base, ignore.compile_lines(ls)) for base, ls in _SPECS]
    return _urls(spark, d).select("id", ignore.ignored(F.col("path"), specs).alias("ignored"))


register("scan_ignore_last_match", _ignored, """SELECT id, CASE WHEN starts_with(path, 'www.cheap-pills.example.com/de/6') THEN true WHEN starts_with(path, 'www.cheap-pills.example.com/de/') THEN false
 WHEN regexp_matches(path, '^www\\.[^/]*/') THEN true WHEN regexp_matches(path, '5\\.html(/|$)') THEN false WHEN regexp_matches(path, '\\.html(/|$)') THEN true ELSE false END AS ignored FROM u_path""", _URLS)


def _include(spark, d):
    from lodegraph.sources.scan import ScanOptions, should_include

    options = ScanOptions(include=("*/en/",), exclude=("*.html",), force_include=("**/1*",))
    return _urls(spark, d).select("id", should_include(F.col("path"), options, [("", ignore.compile_lines(["www.*/"]))]).alias("included"))


register("scan_include", _include, f"""SELECT id, CASE WHEN regexp_matches(path, '(^|/)1[^/]*(/|$)') THEN true WHEN len(list_filter(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), lambda x: x IN ({PRUNED_SQL}) OR starts_with(x, 'bazel-'))) > 0 THEN false
 WHEN regexp_matches(path, '^(.*/)?www\\.[^/]*/') THEN false WHEN regexp_matches(path, '\\.html(/|$)') THEN false ELSE regexp_matches(path, '^[^/]*/en/') END AS included FROM u_path""", _URLS)


def _validated(spark, d):
    """Documents' bytes, some with a NUL or a stray continuation byte put in."""
    from lodegraph.sources.scan import validate

    t = F.col("text").cast("binary")
    spoilt = F.when(F.col("doc_id") % 9 == 0, F.concat(F.substring(t, 1, 40), F.lit(b"\x00"), t)).when(F.col("doc_id") % 9 == 1, F.concat(t, F.lit(b"\xff"))).otherwise(t)
    v = validate(spoilt)
    return adapters.table(spark, d, "documents").select("doc_id", v.alias("v")).select("doc_id", "v.code", "v.byte_offset")


register("scan_validate", _validated, """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'binary_source' WHEN 1 THEN 'invalid_utf8' END AS code,
 CAST(CASE doc_id % 9 WHEN 0 THEN least(strlen(text), 40) WHEN 1 THEN strlen(text) END AS BIGINT) AS byte_offset FROM documents""")
