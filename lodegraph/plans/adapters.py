"""The driver's tables seen as a source graph, and the same views as DuckDB SQL.

documents are files and, line by line, chunks; regions and nations are namespaces, customers,
suppliers and parts types, orders callables; line items are references, type uses and calls, with
returned ones unresolved; events are occurrences and diagnostics. Ids are arithmetic on the keys, so no
view needs a global numbering; a line item's number within its order is the only window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions import text as tx
from lodegraph.plans.graph import Graph

#: First id of each kind of node.
BASE = {"region": 1_000_000_000_000, "nation": 2_000_000_000_000, "customer": 3_000_000_000_000, "orders": 4_000_000_000_000, "supplier": 5_000_000_000_000, "part": 6_000_000_000_000}
EDGE_BASE = {"nation": 10_000_000_000_000, "customer": 11_000_000_000_000, "supplier": 12_000_000_000_000, "orders": 13_000_000_000_000}
EXTENSIONS = (".java", ".cpp", ".py", ".m", ".go", ".rs", ".txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path():
    d = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (d % 7 + 1).cast("int"))
    return F.concat(
        F.when(d % 11 == 0, "third_party/").otherwise(""), F.lit("src/"), "source", F.lit("/"), "lang", F.when(d % 5 == 0, "/tests/").otherwise("/"), F.lit("doc_"), d.cast("string"), ext
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    path = F.col("path")
    return (
        table(spark, sf_dir, "documents")
        .withColumn("path", _path())
        .select(
            F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("snapshot_id"), "path", tx.language_of(path).alias("language"), F.sha2(t.cast("binary"), 256).alias("content_hash"),
            F.octet_length(t).cast("long").alias("size_bytes"), tx.line_count(t).alias("line_count"), tx.is_test(path).alias("is_test"), tx.is_generated(path).alias("is_generated"),
            tx.is_vendor(path).alias("is_vendor"),
        )
    )


def chunks(spark: SparkSession, sf_dir: str, n_docs: int, n_orders: int) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    order = F.col("doc_id") + F.lit(n_docs) * F.col("pos")
    return lines.select(
        (F.col("doc_id") * 100_000 + F.col("pos")).alias("id"), F.col("doc_id").alias("file_id"), F.when(order < n_orders, order + BASE["orders"]).alias("node_id"),
        F.when(order < n_orders, "definition").otherwise("source").alias("kind"), (F.col("pos") + 1).cast("long").alias("start_line"), (F.col("pos") + 1).cast("long").alias("end_line"),
        "text", tx.token_estimate(F.col("text")).alias("token_estimate"),
    )


def nodes(spark: SparkSession, sf_dir: str, n_docs: int) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    region = read("region").select(F.col("r_regionkey").cast("long").alias("rk"), "r_name")
    nation = read("nation").select(F.col("n_nationkey").cast("long").alias("nk"), "n_name", F.col("n_regionkey").cast("long").alias("rk"))
    customer = read("customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("nk"))
    supplier = read("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("nk"))
    named = nation.join(region, "rk").select("nk", "n_name", F.concat_ws(".", "r_name", "n_name").alias("nq"))
    owned = customer.join(named, "nk").select("c_custkey", "c_name", F.concat_ws(".", "nq", "c_name").alias("cq"))
    one = F.lit(1).cast("long")

    def shaped(df, kind, base, key, name, qname, start, end, confidence):
        return df.select(
            (F.lit(BASE[base]) + key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qname.alias("qualified_name"), F.pmod(key, F.lit(n_docs)).alias("file_id"),
            start.cast("long").alias("start_line"), end.cast("long").alias("end_line"), F.lit(confidence).alias("confidence"),
        )

    ck, sk, pk, ok = F.col("c_custkey"), F.col("s_suppkey"), F.col("p_partkey"), F.col("o_orderkey")
    order_name = F.concat(F.lit("Order#"), ok.cast("string"))
    line = F.floor(ok / n_docs) + 1
    parts = [
        shaped(region, "namespace", "region", F.col("rk"), F.col("r_name"), F.col("r_name"), one, F.lit(1000), 1.0),
        shaped(named, "namespace", "nation", F.col("nk"), F.col("n_name"), F.col("nq"), one, F.lit(500), 1.0),
        shaped(owned, "type", "customer", ck, F.col("c_name"), F.col("cq"), ck % 7 + 1, ck % 7 + 6 + ck % 11, 0.9),
        shaped(supplier.join(named, "nk"), "type", "supplier", sk, F.col("s_name"), F.concat_ws(".", "nq", "s_name"), sk % 5 + 1, sk % 5 + 9, 0.9),
        shaped(read("part"), "type", "part", pk, F.col("p_name"), F.concat_ws(".", "p_brand", "p_name"), pk % 9 + 1, pk % 9 + 1 + pk % 4, 0.8),
        shaped(read("orders").join(owned.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")), "callable", "orders", ok, order_name, F.concat_ws(".", "cq", order_name), line, line + ok % 3, 0.75),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    held = table(spark, sf_dir, "documents").withColumn("path", _path()).select(F.col("doc_id").alias("file_id"), "path", tx.language_of(F.col("path")).alias("language"))
    key = F.concat(F.coalesce("language", F.lit("text")), F.lit(":"), "path", F.lit("#"), "qualified_name")
    return out.join(held.hint("shuffle_hash"), "file_id", "left").select(
        "id", F.lit(1).cast("long").alias("snapshot_id"), "kind", "language", "name", "qualified_name", key.alias("symbol_key"), "file_id", "start_line", "end_line", "confidence", F.lit("adapter").alias("extractor"),
    )


def edges(spark: SparkSession, sf_dir: str, n_docs: int, n_orders: int) -> DataFrame:
    none, nostr = F.lit(None).cast("long"), F.lit(None).cast("string")

    def contains(df, base, key, parent, child_base, parent_base):
        return df.select(
            (F.lit(EDGE_BASE[base]) + key).alias("id"), F.lit("contains").alias("kind"), (F.lit(BASE[parent_base]) + parent).alias("src_node_id"), (F.lit(BASE[child_base]) + key).alias("dst_node_id"),
            nostr.alias("unresolved_dst"), F.pmod(key, F.lit(n_docs)).alias("file_id"), none.alias("start_line"), F.lit(1.0).alias("confidence"),
        )

    k = lambda c: F.col(c).cast("long")
    out = contains(table(spark, sf_dir, "nation"), "nation", k("n_nationkey"), k("n_regionkey"), "nation", "region")
    out = out.unionByName(contains(table(spark, sf_dir, "customer"), "customer", k("c_custkey"), k("c_nationkey"), "customer", "nation"))
    out = out.unionByName(contains(table(spark, sf_dir, "supplier"), "supplier", k("s_suppkey"), k("s_nationkey"), "supplier", "nation"))
    out = out.unionByName(contains(table(spark, sf_dir, "orders"), "orders", k("o_orderkey"), k("o_custkey"), "orders", "customer"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w))
    calls, lost = F.col("l_linenumber") % 3 == 0, F.col("l_returnflag") == "R"
    target = F.when(calls, BASE["orders"] + F.pmod("l_partkey", F.lit(n_orders))).otherwise(BASE["part"] + F.col("l_partkey"))
    two = F.array(
        F.struct(F.lit(0).alias("k"), F.when(calls, "calls").otherwise("references").alias("kind"), F.when(~lost, target).alias("dst"), F.when(lost, F.concat(F.lit("part#"), F.col("l_partkey").cast("string"))).alias("un")),
        F.struct(F.lit(1).alias("k"), F.lit("uses_type").alias("kind"), (BASE["supplier"] + F.col("l_suppkey")).alias("dst"), nostr.alias("un")),
    )
    made = items.select("*", F.explode(two).alias("e")).select(
        ((F.col("l_orderkey") * 1000 + F.col("n")) * 2 + F.col("e.k")).alias("id"), F.col("e.kind").alias("kind"), (BASE["orders"] + F.col("l_orderkey")).alias("src_node_id"), F.col("e.dst").alias("dst_node_id"),
        F.col("e.un").alias("unresolved_dst"), F.pmod("l_orderkey", F.lit(n_docs)).alias("file_id"), F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("long")).alias("start_line"),
        F.round(0.5 + F.col("l_discount") * 5, 4).alias("confidence"),
    )
    return out.unionByName(made).select(
        "id", F.lit(1).cast("long").alias("snapshot_id"), "kind", "src_node_id", "dst_node_id", nostr.alias("unresolved_src"), "unresolved_dst", "file_id", "start_line", F.col("start_line").alias("end_line"),
        "confidence", F.lit(1.0).alias("weight"), F.lit("adapter").alias("extractor"),
    )


ROLES = {"view": "definition", "click": "call", "signup": "type_reference", "purchase": "import", "error": "include"}


def occurrences(spark: SparkSession, sf_dir: str, n_docs: int) -> DataFrame:
    role = F.try_element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), "event_type")
    line = (F.col("event_id") % 40 + 1).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.pmod("user_id", F.lit(n_docs)).alias("file_id"), role.alias("role"), F.col("props").alias("text"), line.alias("start_line"), line.alias("end_line"), F.lit(0.8).alias("confidence"),
    )


def diagnostics(spark: SparkSession, sf_dir: str, n_docs: int) -> DataFrame:
    line = (F.col("event_id") % 30 + 1).cast("long")
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("id"), F.lit(1).cast("long").alias("snapshot_id"), F.when(F.col("event_id") % 13 != 0, F.pmod("user_id", F.lit(n_docs))).alias("file_id"), F.when(F.col("value") > 20, "error").otherwise("warning").alias("severity"),
        F.lit("parse_error").alias("code"), F.concat(F.lit("unexpected "), "props").alias("message"), line.alias("start_line"), (line + F.col("event_id") % 2).alias("end_line"),
    )


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    n_docs, n_orders = table(spark, sf_dir, "documents").count(), table(spark, sf_dir, "orders").count()
    return Graph(
        files(spark, sf_dir), nodes(spark, sf_dir, n_docs), edges(spark, sf_dir, n_docs, n_orders), chunks(spark, sf_dir, n_docs, n_orders), occurrences(spark, sf_dir, n_docs),
        diagnostics(spark, sf_dir, n_docs), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, file_id, line): one question a benchmark item."""
    n = table(spark, sf_dir, "documents").count()
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.pmod(F.col("item_id") * 31, F.lit(n)).alias("file_id"), (F.col("item_id") % 5 + 1).cast("long").alias("line"))
