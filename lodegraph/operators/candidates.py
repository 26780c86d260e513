"""Context candidates: one batched join for each family, for many anchors at once.

Anchors: request_id, file_id, file_path, line, node_id, node_kind, node_name, qualified_name, symbol_key,
start_line, end_line. Candidates share one shape (``COLUMNS``); ``family`` and ``ord`` give their order.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import text as tx
from lodegraph.operators.anchors import distance, first_chunk, known, of
from lodegraph.operators.traversal import first_per
from lodegraph.plans.graph import Graph

COLUMNS = {
    "request_id": "long", "family": "int", "ord": "int", "kind": "string", "file": "string", "start_line": "long", "end_line": "long", "text": "string", "token_estimate": "long", "confidence": "double",
    "chunk_id": "long", "edge_id": "long", "edge_kind": "string", "node_id": "long", "node_kind": "string", "node_name": "string", "qualified_name": "string", "symbol_key": "string", "required": "boolean",
    "is_vendor": "boolean", "diagnostic_relation": "string", "callable_kind": "string",
}
SYMBOL_LIMIT, TESTS_PER_ORIGIN = 8, 2
#: Characters of a name by which the rows that may hold it are found.
GRAM = 6
_RELATION = {"calls": ("neighborhood.callee", 3.4), "uses_type": ("neighborhood.type", 3.2), "references": ("neighborhood.reference", 3.1)}


def shape(df: DataFrame, family: int, kind: str | Column, required: bool = False) -> DataFrame:
    """``df`` in the common shape; what it lacks is null."""
    have = set(df.columns)
    fixed = {"family": F.lit(family), "kind": F.lit(kind) if isinstance(kind, str) else kind, "required": F.lit(required)}
    return df.select(*(fixed.get(c, F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def around(g: Graph, asked: DataFrame) -> Graph:
    """``g`` with the files, chunks, occurrences and source of the files asked for (file_id) only."""
    return replace(
        g, file=of(g.file.withColumnRenamed("id", "file_id"), asked, "file_id").withColumnRenamed("file_id", "id"), **{t: of(getattr(g, t), asked, "file_id") for t in ("chunk", "occurrence", "source")}
    )


def _with_nodes_of_chunks(g: Graph) -> Graph:
    """``g``, of a few files, with only the nodes that its chunks name."""
    ids = known(g.chunk.where("node_id IS NOT NULL").select(F.col("node_id").alias("id")))
    return replace(g, node=of(g.node, ids, "id"))


def chunk_rows(g: Graph) -> DataFrame:
    """Chunks with their file's path and what is known of their node; a missing node's confidence is 0.7."""
    node = g.node.select(F.col("id").alias("node_id"), F.col("kind").alias("node_kind"), F.col("name").alias("node_name"), "qualified_name", "symbol_key", F.col("confidence").alias("c"))
    path = g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file"), "is_test")
    rows = g.chunk.select(F.col("id").alias("chunk_id"), "node_id", F.col("kind").alias("chunk_kind"), "file_id", "start_line", "end_line", "text", "token_estimate").join(path, "file_id")
    return rows.join(node, "node_id", "left").withColumn("confidence", F.coalesce("c", F.lit(0.7))).drop("c")


def _snippets(rows: DataFrame, g: Graph) -> DataFrame:
    """``rows`` (file_id, start_line, end_line) with the text of their lines; rows outside their file go."""
    with_text = rows.join(g.source.withColumnRenamed("text", "__t"), "file_id")
    return with_text.withColumn("text", tx.snippet(F.col("__t"), F.col("start_line"), F.col("end_line"))).drop("__t").where("text IS NOT NULL").withColumn("token_estimate", tx.token_estimate(F.col("text")))


def target(g: Graph, anchors: DataFrame) -> DataFrame:
    """The anchor node's first chunk, else its lines, else the anchor's line; one a request."""
    g = around(g, anchors)
    own = anchors.join(first_chunk(g.chunk), ["node_id", "file_id"])
    node = of(g.node.select(F.col("id").alias("node_id"), F.col("confidence")), anchors, "node_id")
    known = ["request_id", "file_id", "node_id", "node_kind", "node_name", "qualified_name", "symbol_key"]
    by_chunk = own.join(node, "node_id").select(
        *known, F.col("file_path").alias("file"), F.col("chunk_start").alias("start_line"), F.col("chunk_end").alias("end_line"), F.col("chunk_text").alias("text"), F.col("chunk_tokens").alias("token_estimate"), "confidence", "chunk_id",
        F.lit("target.definition").alias("k"), F.lit(0).alias("choice"),
    )
    half = F.lit(0.5).alias("confidence")
    lines = anchors.where("node_id IS NOT NULL").select("request_id", "file_id", "node_id", F.col("file_path").alias("file"), "start_line", "end_line", half, F.lit("target.source").alias("k"), F.lit(1).alias("choice"))
    line = anchors.select("request_id", "file_id", "node_id", F.col("file_path").alias("file"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), half, F.lit("target.source").alias("k"), F.lit(2).alias("choice"))
    options = by_chunk.unionByName(_snippets(lines.unionByName(line), g), allowMissingColumns=True)
    return shape(first_per(options, ["request_id"], ["choice"]), 0, F.col("k"), True)


def enclosing(g: Graph, anchors: DataFrame) -> DataFrame:
    """The smallest other namespace or type around the anchor's line, by its chunk or its lines; without one, the file's
    first chunk that has no node, or the line. Requests without a node have none."""
    g = around(g, anchors)
    a = anchors.where("node_id IS NOT NULL").select("request_id", "file_id", "file_path", "line", F.col("node_id").alias("anchor_node"))
    n = of(g.node, a, "file_id").where("kind IN ('namespace', 'type') AND start_line IS NOT NULL AND end_line IS NOT NULL").select(
        F.col("id").alias("node_id"), "file_id", F.col("kind").alias("node_kind"), F.col("name").alias("node_name"), "qualified_name", "symbol_key", "start_line", "end_line", "confidence"
    )
    held = a.join(n, "file_id").where("start_line <= line AND end_line >= line AND node_id <> anchor_node")
    best = first_per(held, ["request_id"], [F.col("end_line") - F.col("start_line"), F.desc("start_line"), "node_id"]).drop("ord")
    kind = F.concat(F.lit("enclosing."), "node_kind")
    with_chunk = best.join(first_chunk(g.chunk), ["node_id", "file_id"], "left")
    by_chunk = with_chunk.where("chunk_id IS NOT NULL").select(
        "request_id", "file_id", "node_id", "node_kind", "node_name", "qualified_name", "symbol_key", "confidence", F.col("file_path").alias("file"), F.col("chunk_start").alias("start_line"), F.col("chunk_end").alias("end_line"),
        F.col("chunk_text").alias("text"), F.col("chunk_tokens").alias("token_estimate"), "chunk_id", kind.alias("k"), F.lit(0).alias("choice"),
    )
    by_lines = _snippets(with_chunk.where("chunk_id IS NULL").select("request_id", "file_id", "node_id", "node_kind", "node_name", "qualified_name", "symbol_key", "confidence", F.col("file_path").alias("file"), "start_line", "end_line", kind.alias("k"), F.lit(0).alias("choice")), g)
    loose = g.chunk.where("node_id IS NULL").groupBy("file_id").agg(F.min_by(F.struct(F.col("id").alias("chunk_id"), "start_line", "end_line", "text", "token_estimate"), F.struct(F.when(F.col("kind") == "file", 0).otherwise(1), "start_line", "id")).alias("v"))
    by_file = a.join(loose, "file_id").select("request_id", "file_id", F.col("file_path").alias("file"), "v.*", F.lit(0.7).alias("confidence"), F.lit("enclosing.file").alias("k"), F.lit(1).alias("choice"))
    by_line = _snippets(a.select("request_id", "file_id", F.col("file_path").alias("file"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(0.5).alias("confidence"), F.lit("enclosing.file").alias("k"), F.lit(2).alias("choice")), g)
    options = by_chunk
    for p in (by_lines, by_file, by_line):
        options = options.unionByName(p, allowMissingColumns=True)
    return shape(first_per(options, ["request_id"], ["choice"]), 1, F.col("k"), True)


def imports(g: Graph, anchors: DataFrame) -> DataFrame:
    """Imports and includes of the anchor's file, with their whole source lines where those exist."""
    g = around(g, anchors)
    rows = anchors.select("request_id", "file_id", F.col("file_path").alias("file")).join(g.occurrence.where("role IN ('import', 'include')").select("id", "file_id", "role", F.col("text").alias("own"), "start_line", "end_line", "confidence"), "file_id")
    rows = rows.join(g.source.withColumnRenamed("text", "__t"), "file_id", "left")
    rows = rows.withColumn("text", F.coalesce(tx.snippet(F.col("__t"), F.col("start_line"), F.col("end_line")), "own")).withColumn("token_estimate", tx.token_estimate(F.col("text")))
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("request_id").orderBy("start_line", "id")))
    return shape(rows, 3, F.col("role"))


def _ends(g: Graph, rows: DataFrame, far: str, kind: Column) -> DataFrame:
    """Edges of anchors (edge_id, edge_kind, edge_confidence, ``far`` node) as candidates: the far node's first chunk, else its lines."""
    node = g.node.select(F.col("id").alias("node_id"), "file_id", F.col("kind").alias("node_kind"), F.col("name").alias("node_name"), "qualified_name", "symbol_key", F.col("start_line").alias("ns"), F.col("end_line").alias("ne"), F.col("confidence").alias("nc"))
    rows = known(rows.withColumn("node_id", F.col(far)).drop(far))
    rows = known(rows.join(of(node, rows, "node_id"), "node_id"))
    g = around(g, rows)
    path = g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    ends = rows.join(path, "file_id").join(first_chunk(g.chunk), ["node_id", "file_id"], "left").withColumn("k", kind)
    by_chunk = ends.where("chunk_id IS NOT NULL").withColumns({"start_line": F.col("chunk_start"), "end_line": F.col("chunk_end"), "text": F.col("chunk_text"), "token_estimate": F.col("chunk_tokens"), "confidence": F.least("nc", "edge_confidence")})
    by_lines = _snippets(ends.where("chunk_id IS NULL AND ns IS NOT NULL AND ne IS NOT NULL").withColumns({"start_line": F.col("ns"), "end_line": F.col("ne"), "confidence": F.col("edge_confidence")}), g)
    return by_chunk.unionByName(by_lines)


def relationships(g: Graph, anchors: DataFrame) -> DataFrame:
    """What the anchor calls, uses and references, as far as it is resolved."""
    rank = F.when(F.col("edge_kind") == "calls", 0).when(F.col("edge_kind") == "uses_type", 1).otherwise(2)
    e = g.edge.where(F.col("kind").isin(*_RELATION)).select(F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"), F.col("src_node_id").alias("a"), "dst_node_id", F.col("confidence").alias("edge_confidence"), F.col("start_line").alias("edge_line"))
    a = anchors.select("request_id", F.col("node_id").alias("a"))
    rows = a.join(of(e, a, "a"), "a").where("dst_node_id IS NOT NULL").withColumn("ord", F.row_number().over(Window.partitionBy("request_id").orderBy(rank, "edge_line", "edge_id"))).drop("a")
    kind = F.try_element_at(F.create_map(*(F.lit(x) for k, v in _RELATION.items() for x in (k, v[0]))), F.col("edge_kind"))
    return shape(_ends(g, rows, "dst_node_id", kind), 4, F.col("k"))


def unresolved_notes(g: Graph, anchors: DataFrame) -> DataFrame:
    """(request_id, ord, edge_kind, unresolved): what the anchor leads to without a node."""
    rank = F.when(F.col("edge_kind") == "calls", 0).when(F.col("edge_kind") == "uses_type", 1).otherwise(2)
    e = g.edge.where(F.col("kind").isin(*_RELATION) & F.col("dst_node_id").isNull() & F.col("unresolved_dst").isNotNull())
    rows = anchors.select("request_id", "node_id").join(e.select(F.col("src_node_id").alias("node_id"), F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"), F.col("unresolved_dst").alias("unresolved"), "start_line"), "node_id")
    return rows.select("request_id", F.row_number().over(Window.partitionBy("request_id").orderBy(rank, "start_line", "edge_id")).alias("ord"), "edge_kind", "unresolved")


def callers(g: Graph, anchors: DataFrame) -> DataFrame:
    """What calls the anchor."""
    e = g.edge.where("kind = 'calls' AND src_node_id IS NOT NULL").select(F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"), F.col("dst_node_id").alias("a"), "src_node_id", F.col("confidence").alias("edge_confidence"), F.col("start_line").alias("edge_line"))
    a = anchors.select("request_id", F.col("node_id").alias("a"))
    calling = known(of(e.select("a", "src_node_id"), a, "a"))  # all edges of these nodes are few, and what makes edges needs no more of them
    rows = a.join(of(e, calling, "src_node_id"), "a").withColumn("ord", F.row_number().over(Window.partitionBy("request_id").orderBy("edge_line", "edge_id"))).drop("a")
    return shape(_ends(g, rows, "src_node_id", F.lit("neighborhood.caller")), 5, F.col("k"))


def tests(g: Graph, anchors: DataFrame) -> DataFrame:
    """Chunks of test files whose path or node is named like the anchor; the name is a pattern, so its ``_`` and ``%`` match more."""
    asked = anchors.where("node_name IS NOT NULL").select("request_id", F.lower("node_name").alias("needle"))
    hits = _named_like(g, asked.select("needle").distinct()).join(asked, "needle")
    return shape(hits.withColumn("ord", F.row_number().over(Window.partitionBy("request_id").orderBy("file", "start_line", "chunk_id"))), 6, "test.related")


def _named_like(g: Graph, needles: DataFrame) -> DataFrame:
    """Chunks of test files with every needle that their path or node's name is like.

    A pattern has no equality key, but its longest stretch without wildcards does: the last ``GRAM`` characters of it, which a
    row must hold. Shorter ones go by the empty string, which all rows hold. The needles are a name or two dozen a request, so they are
    broadcast, the rows stay where they are.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = chunk_rows(g).where(F.col("is_test") | F.contains(F.lower("file"), F.lit("test")))
    parts = F.transform(F.split("needle", "[%_]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    longest = F.array_max(parts)["p"]
    needles = needles.withColumns({"gram": F.when(F.length(longest) >= GRAM, F.right(longest, F.lit(GRAM))).otherwise(""), "plain": F.size(parts) == 1})
    named = F.concat_ws("\n", F.lower("file"), low("node_name"), low("qualified_name"))
    places = F.when(F.length("named") >= GRAM, F.sequence(F.lit(1), F.length("named") - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(places, lambda i: F.substring(F.col("named"), i, F.lit(GRAM)))))
    like = lambda c: F.when(F.col("plain"), F.contains(c, F.col("needle"))).otherwise(F.like(c, F.concat(F.lit("%"), "needle", F.lit("%")), F.lit("\x01")))
    found = rows.withColumn("named", named).withColumn("gram", F.explode(grams)).drop("named").join(F.broadcast(needles), "gram")
    return found.where(like(F.lower("file")) | like(low("node_name")) | like(low("qualified_name"))).drop("gram", "plain")


def tests_of_origins(g: Graph, origins: DataFrame) -> DataFrame:
    """As ``tests`` for every origin of a file: the first ``TESTS_PER_ORIGIN`` of each, a chunk once, in the origins' order.

    Origins of one name have the same tests, so each name is looked up once.
    """
    named = origins.where("node_name IS NOT NULL").select("request_id", F.col("ord").alias("origin_ord"), F.lower("node_name").alias("needle"))
    first = F.row_number().over(Window.partitionBy("needle").orderBy("file", "start_line", "chunk_id"))
    named = known(named)
    hits = _named_like(g, named.select("needle").distinct()).withColumn("nth", first).where(F.col("nth") <= TESTS_PER_ORIGIN)
    once = F.row_number().over(Window.partitionBy("request_id", "chunk_id").orderBy("origin_ord", "nth"))
    rows = named.join(hits, "needle").withColumn("once", once).where("once = 1")
    return shape(rows.withColumn("ord", F.row_number().over(Window.partitionBy("request_id").orderBy("origin_ord", "nth"))), 6, "test.related")


def siblings(g: Graph, anchors: DataFrame) -> DataFrame:
    """The other chunks of the anchor's file, nearest first."""
    a = anchors.select("request_id", "file_id", "line")
    rows = chunk_rows(_with_nodes_of_chunks(around(g, a))).join(a, "file_id")
    near = distance(F.col("line"), F.col("start_line"), F.col("end_line"))
    return shape(rows.withColumn("ord", F.row_number().over(Window.partitionBy("request_id").orderBy(near, "start_line", "chunk_id"))), 7, "sibling.definition")


def without_used(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates whose chunk no other candidate of the request has."""
    return candidates.join(used.where("chunk_id IS NOT NULL").select("request_id", "chunk_id").distinct(), ["request_id", "chunk_id"], "left_anti").select(*COLUMNS)


def _stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def diagnostics(g: Graph, anchors: DataFrame) -> DataFrame:
    """Diagnostics of the anchor's file, of files named like it or its node, and of vendored files."""
    path = g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    d = g.diagnostic.join(path, "file_id").withColumn("is_vendor", tx.is_vendor(F.col("file"))).withColumn("stem", _stem(F.col("file")))
    stem, name = _stem(F.col("file_path")), F.lower("node_name")
    # one equality key instead of an OR: vendored rows go to every request, the others by path or stem; a few short keys a request are broadcast
    by = lambda letter, c: F.concat(F.lit(letter), c)
    stems = F.transform(F.filter(F.array_distinct(F.array(stem, F.coalesce(name, stem))), lambda s: s != ""), lambda s: by("s", s))
    asked = anchors.select("request_id", F.col("file_id").alias("anchor_file_id"), F.col("file_path").alias("af"), F.explode(F.concat(F.array(F.lit("v"), by("f", F.col("file_path"))), stems)).alias("key"))
    rows = d.withColumn("key", F.explode(F.when(F.col("is_vendor"), F.array(F.lit("v"))).otherwise(F.array(by("f", F.col("file")), by("s", F.col("stem"))))))
    rows = rows.join(F.broadcast(asked.select("key")), "key", "left_semi").join(g.source.withColumnRenamed("text", "__t"), "file_id", "left")
    rows = rows.withColumn("text", F.coalesce(tx.snippet(F.col("__t"), F.col("start_line"), F.col("end_line")), "message")).withColumn("token_estimate", tx.token_estimate(F.col("text"))).drop("__t")
    rows = rows.join(F.broadcast(asked), "key").where(~F.startswith("key", F.lit("s")) | (F.col("file") != F.col("af")))  # texts are cut before they are handed to every request
    rows = rows.withColumn("diagnostic_relation", F.when(F.col("is_vendor"), "vendor").when(F.startswith("key", F.lit("f")), "anchor-file").otherwise("related"))
    rows = rows.withColumn("confidence", F.when(F.col("is_vendor"), 0.3).when(F.col("severity") == "error", 0.8).otherwise(0.6))
    order = Window.partitionBy("request_id").orderBy(F.when(F.col("file_id") == F.col("anchor_file_id"), 0).otherwise(1), "file", "start_line", "id")
    return shape(rows.withColumn("ord", F.row_number().over(order)), 2, "diagnostic.parser")


def outline(origins: DataFrame) -> DataFrame:
    """One text a request that lists its file's symbols by line."""
    label = F.when(F.col("start_line") == F.col("end_line"), F.concat(F.lit("line "), F.col("start_line").cast("string"))).otherwise(F.concat(F.lit("lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")))
    name = F.coalesce(F.nullif("qualified_name", F.lit("")), F.nullif("node_name", F.lit("")), F.lit("<unnamed>"))
    entry = F.concat(F.lit("- "), "node_kind", F.lit(" "), name, F.lit(": "), label)
    rows = origins.select("request_id", F.col("file_path").alias("file"), F.struct("start_line", "end_line", F.coalesce("node_name", F.lit("")).alias("n"), "ord", entry.alias("t")).alias("e"))
    held = rows.groupBy("request_id", "file").agg(F.array_sort(F.collect_list("e")).alias("es"))
    text = F.concat(F.lit("Symbols in "), "file", F.lit(":\n"), F.array_join(F.transform("es", lambda e: e["t"]), "\n"), F.lit("\n"))
    out = held.select("request_id", "file", text.alias("text"), F.size("es").alias("symbol_count"), F.lit(0.7).alias("confidence"), F.lit(1).alias("ord"))
    return shape(out.withColumn("token_estimate", tx.token_estimate(F.col("text"))), 0, "file.outline", True)


def file_symbols(g: Graph, requests: DataFrame) -> DataFrame:
    """Chunks of the file's callables, types and fields."""
    rows = chunk_rows(_with_nodes_of_chunks(around(g, requests))).where("node_kind IN ('callable', 'type', 'field')").join(requests.select("request_id", "file_id"), "file_id")
    rank = F.when(F.col("node_kind") == "callable", 0).when(F.col("node_kind") == "type", 1).otherwise(2)
    return shape(rows.withColumn("ord", F.row_number().over(Window.partitionBy("request_id").orderBy(rank, "start_line", "chunk_id"))), 1, "file.symbol")


def cap_symbols(candidates: DataFrame, limit: int = SYMBOL_LIMIT) -> DataFrame:
    """``capped`` true for file symbols beyond the limit, in their order."""
    w = Window.partitionBy("request_id", F.col("kind") == "file.symbol").orderBy("family", "ord")
    return candidates.withColumn("capped", (F.col("kind") == "file.symbol") & (F.row_number().over(w) > limit))


def fallback(g: Graph, requests: DataFrame) -> DataFrame:
    """For files without any other optional candidate: the first chunk that has no node, else the whole source."""
    g = around(g, requests)
    loose = g.chunk.where("node_id IS NULL").groupBy("file_id").agg(F.min_by(F.struct(F.col("id").alias("chunk_id"), "start_line", "end_line", "text", "token_estimate"), F.struct(F.when(F.col("kind") == "file", 0).otherwise(1), "start_line", "id")).alias("v"))
    r = requests.select("request_id", "file_id", F.col("file_path").alias("file"))
    by_chunk = r.join(loose, "file_id").select("request_id", "file_id", "file", "v.*", F.lit(0.7).alias("confidence"), F.lit(0).alias("choice"))
    whole = r.join(g.file.select(F.col("id").alias("file_id"), F.lit(1).cast("long").alias("start_line"), F.col("line_count").alias("end_line")), "file_id").withColumn("confidence", F.lit(0.5)).withColumn("choice", F.lit(1))
    return shape(first_per(by_chunk.unionByName(_snippets(whole, g), allowMissingColumns=True), ["request_id"], ["choice"]), 8, "file.fallback")


def dedupe(candidates: DataFrame) -> DataFrame:
    """The first of every identity: the chunk, else the edge, else file and lines, else kind and text."""
    identity = (
        F.when(F.col("chunk_id").isNotNull(), F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))).when(F.col("edge_id").isNotNull(), F.concat(F.lit("edge "), F.col("edge_id").cast("string")))
        .when(F.col("file").isNotNull() | F.col("start_line").isNotNull(), F.concat(F.lit("range "), F.coalesce("file", F.lit("")), F.lit(" "), F.coalesce(F.col("start_line").cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit(""))))
        .otherwise(F.concat(F.lit("text "), "kind", F.lit(" "), F.sha2("text", 256)))
    )
    w = Window.partitionBy("request_id", "identity").orderBy("family", "ord")
    return candidates.withColumn("identity", identity).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("identity", "__n")


def for_lines(g: Graph, anchors: DataFrame, goal: str) -> tuple[DataFrame, DataFrame]:
    """(required, optional) candidates of line anchors."""
    required = known(union([target(g, anchors), enclosing(g, anchors)]))
    held = [relationships(g, anchors), without_used(tests(g, anchors), required), without_used(siblings(g, anchors), required)]
    if goal == "call-neighborhood":
        held.insert(1, callers(g, anchors))
    # a sibling goes if another candidate has its chunk; a window says so without making the others twice
    sibling = F.col("kind") == "sibling.definition"
    used = F.bool_or(~sibling).over(Window.partitionBy("request_id", "chunk_id"))
    optional = [imports(g, anchors), union(held).withColumn("__used", used).where(~sibling | ~F.col("__used")).drop("__used")]
    if goal == "failure-modes":
        optional.insert(0, diagnostics(g, anchors))
    return required, union(optional)


def with_anchor(candidates: DataFrame, anchors: DataFrame, query: Column | None = None) -> DataFrame:
    """Candidates with the columns that scoring needs of their anchor; the query is the file's path unless given."""
    a = anchors.select("request_id", F.col("file_path").alias("anchor_file"), F.col("line").alias("anchor_line"), F.col("node_name").alias("anchor_name"), (F.col("file_path") if query is None else query).alias("query"))
    return candidates.join(a, "request_id")
