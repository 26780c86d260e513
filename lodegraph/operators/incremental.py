"""Incremental indexing: fingerprints, the extraction cache, and which snapshot is the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import scan_key

CACHE_KEY = ["path", "language", "content_hash", "cache_version"]


def fingerprint(file: DataFrame, by: list[str] | None = None) -> DataFrame:
    """SHA-256 over path and hash of every file in scan order, each ended by a zero byte; one row, or one a group of ``by``.

    A snapshot's own file list is what is sorted; groups are spread by their keys.
    """
    entry = F.struct(scan_key(F.col("path")).alias("k"), F.concat("path", F.lit("\0"), "content_hash", F.lit("\0")).alias("s"))
    held = file.groupBy(*(by or [])).agg(F.array_sort(F.collect_list(entry)).alias("es"))
    return held.select(*(by or []), F.sha2(F.array_join(F.transform("es", lambda e: e["s"]), "").cast("binary"), 256).alias("fingerprint"))


def cache_probe(file: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Every file with its cached facts, null on a miss; facts that aren't a JSON object are a miss too."""
    c = cache.select(*CACHE_KEY, "facts_json")
    rows = file.withColumn("cache_version", F.lit(version)).join(c, CACHE_KEY, "left")
    sound = F.try_parse_json("facts_json").isNotNull() & F.startswith(F.ltrim("facts_json"), F.lit("{"))
    return rows.withColumn("facts_json", F.when(sound, F.col("facts_json"))).withColumn("hit", F.col("facts_json").isNotNull())


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with newer entries in place of older ones of the same key; of equal times the larger facts."""
    rows = cache.select(*CACHE_KEY, "facts_json", "updated_at").unionByName(new.select(*CACHE_KEY, "facts_json", "updated_at"))
    best = F.max(F.struct("updated_at", "facts_json"))
    return rows.groupBy(*CACHE_KEY).agg(best.alias("b")).select(*CACHE_KEY, F.col("b.facts_json").alias("facts_json"), F.col("b.updated_at").alias("updated_at"))


def mode(probe: DataFrame) -> DataFrame:
    """(hits, misses, mode): full without a hit, incremental otherwise."""
    n = probe.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return n.withColumn("mode", F.when(F.col("hits") == 0, "full").otherwise("incremental"))


def unchanged(previous_fingerprint: str | None, previous_version: str | None, now: str, version: str) -> bool:
    return previous_fingerprint == now and previous_version == version


def latest_snapshot(snapshot: DataFrame, repo: DataFrame) -> DataFrame:
    """(root_path, snapshot_id): the snapshot indexed last of every root, the larger id of equal times."""
    rows = snapshot.join(repo.select(F.col("id").alias("repo_id"), "root_path"), "repo_id")
    return rows.groupBy("root_path").agg(F.max(F.struct("indexed_at", "id")).alias("m")).select("root_path", F.col("m.id").alias("snapshot_id"))
