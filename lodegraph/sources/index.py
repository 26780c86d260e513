"""Indexing a working tree into snapshot-partitioned Parquet tables, reusing cached facts of unchanged files."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import health, incremental, resolve
from lodegraph.plans.graph import SCHEMAS, Graph, struct_type
from lodegraph.sources import scan as sc
from lodegraph.sources.frontends import FRONTENDS, Facts, Frontend

CACHE_VERSION = "1"
_SPAN = "start_byte: bigint, end_byte: bigint, start_line: bigint, end_line: bigint"
_FACT = {
    "nodes": f"kind: string, language: string, name: string, qualified_name: string, symbol_key: string, confidence: double, extractor: string, metadata_json: string, {_SPAN}",
    "edges": f"kind: string, src_key: string, dst_key: string, unresolved_src: string, unresolved_dst: string, confidence: double, weight: double, extractor: string, metadata_json: string, {_SPAN}",
    "occurrences": f"role: string, text: string, node_key: string, resolved_key: string, confidence: double, extractor: string, metadata_json: string, {_SPAN}",
    "chunks": f"node_key: string, kind: string, text: string, token_estimate: bigint, metadata_json: string, {_SPAN}",
    "diagnostics": f"severity: string, code: string, message: string, extractor: string, metadata_json: string, {_SPAN}",
}
FACTS_TYPE = "struct<" + ", ".join(f"{k}: array<struct<{v}>>" for k, v in _FACT.items()) + ">"


@dataclass(frozen=True)
class IndexResult:
    snapshot_id: int
    mode: str
    files: int
    cache_hits: int
    cache_misses: int
    fingerprint: str


def facts_of(path: str, language: str, content: bytes, frontends: Mapping[str, Frontend]) -> str:
    """A file's facts as JSON; what is no source has its diagnostic only."""
    code, offset = sc.first_bad_byte([content])[0]
    if code is not None:
        f = Facts(language, path, content)
        f.extractor = "source-decoder"
        span = (offset, min(len(content), offset + 1))
        f.add("diagnostics", span, severity="error", code=code, message="binary content" if code == "binary_source" else "invalid UTF-8", meta={"byte_offset": offset})
        return f.to_json()
    return frontends[language](path, content).to_json()


def extract(files: DataFrame, frontends: Mapping[str, Frontend]) -> DataFrame:
    """``files`` (path, language, content) with ``facts_json``, in Python workers, a file at a time."""
    held = dict(frontends)

    def run(batches):
        for pdf in batches:
            rows = [facts_of(p, la, bytes(c), held) for p, la, c in zip(pdf["path"], pdf["language"], pdf["content"])]
            yield pd.DataFrame({"path": pdf["path"], "facts_json": rows})

    got = files.select("path", "language", "content").mapInPandas(run, "path string, facts_json string")
    return files.drop("facts_json", "content").join(got, "path")


class Store:
    """Tables below one folder: ``<table>/snapshot_id=<id>``. A snapshot exists once its manifest row does, written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(table))
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def wipe(self) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def read(self, table: str, snapshot_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path(table)}/snapshot_id={snapshot_id}")

    def write(self, df: DataFrame, table: str, snapshot_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path(table)}/snapshot_id={snapshot_id}")

    def snapshots(self) -> DataFrame:
        if not self.exists("snapshot"):
            return self.spark.createDataFrame([], "id long, root_path string, indexed_at double, fingerprint string, cache_version string, files long")
        return self.spark.read.parquet(self.path("snapshot"))

    def latest(self, root_path: str):
        return self.snapshots().where(F.col("root_path") == root_path).orderBy(F.desc("indexed_at"), F.desc("id")).first()

    def cache(self) -> DataFrame:
        if not self.exists("extraction_cache"):
            return self.spark.createDataFrame([], struct_type("extraction_cache"))
        versions = self.spark.read.parquet(self.path("extraction_cache"))
        return incremental.cache_upsert(versions.where("false").select(*_cache_columns()), versions.select(*_cache_columns()))

    def graph(self, snapshot_id: int) -> Graph:
        t = {name: self.read(name, snapshot_id) for name in ("file", "node", "edge", "chunk", "occurrence", "diagnostic", "source")}
        return Graph(**t)


def _cache_columns() -> list[str]:
    return [c.split()[0] for c in SCHEMAS["extraction_cache"].split(", ")]


def run_index(spark: SparkSession, repo: str, store_root: str, *, rebuild: bool = False, options: sc.ScanOptions = sc.ScanOptions(), frontends: Mapping[str, Frontend] = FRONTENDS) -> IndexResult:
    """Scan, extract what isn't cached, resolve, number, and publish a snapshot; an unchanged tree keeps its last one."""
    store = Store(spark, store_root)
    if rebuild:
        store.wipe()
    files = sc.scan(spark, repo, options).where(F.col("language").isin(*frontends)).persist()
    row = incremental.fingerprint(files).first()
    now, n_files = row.fingerprint if row else "", files.count()
    last = store.latest(repo)
    if last is not None and incremental.unchanged(last.fingerprint, last.cache_version, now, CACHE_VERSION):
        return IndexResult(last.id, "unchanged", n_files, n_files, 0, now)
    snapshot = 1 + (store.snapshots().agg(F.max("id")).first()[0] or 0)
    probe = incremental.cache_probe(files, store.cache(), CACHE_VERSION).persist()
    m = incremental.mode(probe).first()
    fresh = extract(probe.where("NOT hit"), frontends)
    known = probe.where("hit").drop("content").select(*fresh.columns).unionByName(fresh).persist()
    updated = known.where("NOT hit").select("path", "language", "content_hash", "cache_version", "facts_json", F.current_timestamp().alias("updated_at"))
    updated.write.mode("append").parquet(store.path("extraction_cache"))
    _persist(store, snapshot, files, known)
    stats = health.index_stats(store.graph(snapshot)).unionByName(spark.createDataFrame([("index.mode", m.mode), ("index.cache_hits", str(m.hits)), ("index.cache_misses", str(m.misses)), ("index.cache_version", CACHE_VERSION)], "key string, value string"))
    store.write(stats, "index_stat", snapshot)
    manifest = [(snapshot, repo, time.time(), now, CACHE_VERSION, n_files)]
    spark.createDataFrame(manifest, "id long, root_path string, indexed_at double, fingerprint string, cache_version string, files long").write.mode("append").parquet(store.path("snapshot"))
    for df in (files, probe, known):
        df.unpersist()
    return IndexResult(snapshot, m.mode, n_files, m.hits, m.misses, now)


def _persist(store: Store, snapshot: int, files: DataFrame, known: DataFrame) -> None:
    """Ids follow the scan's order and the order of facts in a file; keys of facts become ids."""
    file = resolve.number(files.withColumn("bucket", F.substring("scan_key", 1, 64)), "bucket", ["scan_key"]).drop("bucket")
    store.write(file.select("id", "path", "language", "content_hash", "size_bytes", "line_count", "is_test", "is_generated", "is_vendor", "scan_key"), "file", snapshot)
    store.write(file.select(F.col("id").alias("file_id"), F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text IS NOT NULL"), "source", snapshot)
    file = store.read("file", snapshot).select(F.col("id").alias("file_id"), "path")
    facts = known.select("path", F.from_json("facts_json", FACTS_TYPE).alias("f")).join(file, "path")

    def rows(kind: str) -> DataFrame:
        each = facts.select("file_id", F.posexplode(f"f.{kind}").alias("seq", "x")).select("file_id", "seq", "x.*")
        return resolve.number(each, "file_id", ["seq"]).drop("seq")

    nodes = rows("nodes")
    store.write(nodes, "node", snapshot)
    node = store.read("node", snapshot)
    types, keys = resolve.unique_types(node), resolve.last_wins(node)
    edges = resolve.attach(resolve.resolve_edges(rows("edges"), types), keys).drop("src_key", "dst_key")
    store.write(edges, "edge", snapshot)
    lang = store.read("file", snapshot).select(F.col("id").alias("file_id"), "language")
    occ = resolve.resolve_occurrences(rows("occurrences").join(lang, "file_id"), types).drop("language")
    for column, key in (("node_id", "node_key"), ("resolved_node_id", "resolved_key")):
        occ = occ.join(keys.select(F.col("symbol_key").alias(key), F.col("node_id").alias(column)), key, "left").drop(key)
    store.write(occ, "occurrence", snapshot)
    chunk = rows("chunks").join(keys.select(F.col("symbol_key").alias("node_key"), "node_id"), "node_key", "left").drop("node_key").withColumn("score_hint", F.lit(0.0))
    store.write(chunk, "chunk", snapshot)
    store.write(rows("diagnostics"), "diagnostic", snapshot)
