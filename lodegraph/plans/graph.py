"""The source graph as a set of DataFrames, and the stored shape of its tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SPAN = "start_byte long, end_byte long, start_line long, end_line long"
SCHEMAS: dict[str, str] = {
    "schema_version": "version int, applied_at timestamp",
    "repo": "id long, root_path string, created_at timestamp",
    "snapshot": "id long, repo_id long, indexed_at timestamp, schema_version int, content_fingerprint string",
    "file": "id long, snapshot_id long, path string, language string, content_hash string, size_bytes long, line_count long, is_test boolean, is_generated boolean, metadata_json string",
    "node": f"id long, snapshot_id long, kind string, language string, name string, qualified_name string, symbol_key string, file_id long, {_SPAN}, confidence double, extractor string, metadata_json string",
    "edge": f"id long, snapshot_id long, kind string, src_node_id long, dst_node_id long, unresolved_src string, unresolved_dst string, file_id long, {_SPAN}, confidence double, weight double, extractor string, metadata_json string",
    "occurrence": f"id long, file_id long, node_id long, role string, text string, {_SPAN}, resolved_node_id long, confidence double, extractor string, metadata_json string",
    "chunk": "id long, file_id long, node_id long, kind string, start_line long, end_line long, text string, token_estimate long, score_hint double, metadata_json string",
    "diagnostic": f"id long, snapshot_id long, file_id long, {_SPAN}, severity string, code string, message string, extractor string, metadata_json string",
    "index_stat": "snapshot_id long, key string, value string",
    "extraction_cache": "path string, language string, content_hash string, cache_version string, facts_json string, updated_at timestamp",
}

#: (table, column, parent): every reference between tables.
FOREIGN_KEYS = [
    ("snapshot", "repo_id", "repo"), ("file", "snapshot_id", "snapshot"), ("node", "snapshot_id", "snapshot"), ("node", "file_id", "file"), ("edge", "snapshot_id", "snapshot"),
    ("edge", "src_node_id", "node"), ("edge", "dst_node_id", "node"), ("edge", "file_id", "file"), ("occurrence", "file_id", "file"), ("occurrence", "node_id", "node"),
    ("occurrence", "resolved_node_id", "node"), ("chunk", "file_id", "file"), ("chunk", "node_id", "node"), ("diagnostic", "snapshot_id", "snapshot"), ("diagnostic", "file_id", "file"),
    ("index_stat", "snapshot_id", "snapshot"),
]


def struct_type(table: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], struct_type(table))


@dataclass
class Graph:
    """One snapshot's tables. ``source`` holds (file_id, text) of the files, from the working tree or a table."""

    file: DataFrame
    node: DataFrame
    edge: DataFrame
    chunk: DataFrame
    occurrence: DataFrame
    diagnostic: DataFrame
    source: DataFrame
