"""Joins at ingest: unique types across files, keys to ids, and what stays unresolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _spread(key: Column, rows: DataFrame) -> Column:
    """``key`` as a key to join by; none becomes a text that no key has, another one for each row: joined by null, all rows without a key would meet in one task."""
    return F.coalesce(F.concat(F.lit("="), key), F.concat(F.lit("?"), F.xxhash64(*rows.columns).cast("string")))


def _with(rows: DataFrame, key: Column, of: DataFrame, by: str) -> DataFrame:
    """``rows`` with the columns of ``of`` (but ``by``) where ``key`` is its ``by``, null elsewhere."""
    return rows.withColumn("__key", _spread(key, rows)).join(of.withColumn("__key", F.concat(F.lit("="), by)).drop(by), "__key", "left").drop("__key")


def unique_types(node: DataFrame) -> DataFrame:
    """(language, name, symbol_key) of every name that means one type only. A type goes by its name, its qualified name and
    the qualified name's last part, after dots and then after double colons."""
    last = F.element_at(F.split(F.element_at(F.split("qualified_name", r"\."), -1), "::"), -1)
    names = F.array_distinct(F.filter(F.array("name", "qualified_name", last), lambda n: n.isNotNull() & (n != "")))
    rows = node.where("kind = 'type' AND symbol_key IS NOT NULL AND language IS NOT NULL").select("language", "symbol_key", F.explode(names).alias("name"))
    return rows.groupBy("language", "name").agg(F.min("symbol_key").alias("symbol_key"), F.max("symbol_key").alias("other")).where("symbol_key = other").drop("other")


def _in_language(language: Column, name: Column) -> Column:
    return F.concat(F.length(language).cast("string"), F.lit(":"), language, F.lit(":"), name)


def _named(types: DataFrame) -> DataFrame:
    return types.select(_in_language(F.col("language"), F.col("name")).alias("__n"), F.col("symbol_key").alias("__k"))


def resolve_edges(facts: DataFrame, types: DataFrame) -> DataFrame:
    """``uses_type`` facts without a target (src_key, dst_key, unresolved_dst) get the unique type of that name in the source's language."""
    open_ = (F.col("kind") == "uses_type") & F.col("dst_key").isNull() & F.col("unresolved_dst").isNotNull()
    joined = _with(facts, F.when(open_, _in_language(F.substring_index("src_key", ":", 1), F.col("unresolved_dst"))), _named(types), "__n")
    hit = F.col("__k").isNotNull()
    return joined.withColumn("dst_key", F.coalesce("dst_key", "__k")).withColumn("unresolved_dst", F.when(~hit, F.col("unresolved_dst"))).drop("__k")


def resolve_occurrences(facts: DataFrame, types: DataFrame) -> DataFrame:
    """``type_reference`` facts (language, text, resolved_key) likewise."""
    open_ = (F.col("role") == "type_reference") & F.col("resolved_key").isNull()
    return _with(facts, F.when(open_, _in_language(F.col("language"), F.col("text"))), _named(types), "__n").withColumn("resolved_key", F.coalesce("resolved_key", "__k")).drop("__k")


def last_wins(node: DataFrame) -> DataFrame:
    """(symbol_key, node_id): of nodes under one key, the one inserted last."""
    return node.where("symbol_key IS NOT NULL").groupBy("symbol_key").agg(F.max("id").alias("node_id"))


def attach(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """Edge facts with node ids for their keys; a key without a node becomes unresolved text, unless there is some already."""
    out = facts
    for p in ("src", "dst"):
        out = _with(out, F.col(f"{p}_key"), keys.select("symbol_key", F.col("node_id").alias(f"{p}_node_id")), "symbol_key")
        out = out.withColumn(f"unresolved_{p}", F.coalesce(f"unresolved_{p}", F.when(F.col(f"{p}_node_id").isNull(), F.col(f"{p}_key"))))
    return out


def attach_files(facts: DataFrame, file: DataFrame, required: bool = True) -> DataFrame:
    """Facts with the id of their file by path. A path without a file is an error if required, else null."""
    joined = _with(facts, F.col("file_path"), file.select("path", F.col("id").alias("file_id")), "path")
    if not required:
        return joined
    missing = F.raise_error(F.concat(F.lit("unknown file path: "), "file_path"))
    return joined.withColumn("file_id", F.coalesce("file_id", F.when(F.col("file_path").isNotNull(), missing.cast("long"))))


def number(rows: DataFrame, bucket: str, order: list[str], out: str = "id", start: int = 0) -> DataFrame:
    """Ids in the order of (``bucket``, ``order``): numbered within each bucket, after the counts of the buckets before it.

    Only the counts, one row a bucket, meet in one place.
    """
    counts = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    base = counts.select(bucket, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__b"))
    within = Window.partitionBy(bucket).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(within)).join(base, bucket).withColumn(out, F.col("__r") + F.col("__b") + start).drop("__r", "__b")
