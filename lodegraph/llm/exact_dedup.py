"""Exact deduplication through a minimal perfect hash over historical distinct digests.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. The SHA-256
digests of historical documents are split into shards of bounded size; each shard gets a minimal perfect
hash (levels of collision-free bits, ranked), whose slots hold the full digest, the locator of the row that
stays and the size of the group. A document finds its slot by the hash and is a member, a repeat of
history, only if all 32 bytes agree; nonmembers are grouped separately, by full digest.

Where no history is given, ``HISTORY`` of the documents, drawn by a hash of id and text, are it: their
digests are indexed, the others are looked up, repeats are taken into the slots they hit (one that
beats the slot's row becomes its locator), nonmembers are grouped, and the index of both together, which is
what the next documents would be looked up in, tells every row its group.

Rows: null text counts as empty; an empty table gives an empty result; other columns of the input
are ignored. Of equal texts the one with the most code points stays, then the smallest doc_id (a null
doc_id comes last). Of rows repeated under one doc_id, with equal texts, exactly one is ``kept``.

Scale: one pass over the texts, whose digests (about 50 bytes a row) are the only thing shuffled.
Equal digests are combined before the shuffle. A shard's rows meet its index in a sorted stream: the
index comes first, so memory is one shard of the index and one Arrow batch however hot a digest is;
shards with many rows are spread over salts, each of which gets its own copy of that shard's index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import brief, id_and_text, materialize, parallelism, text_mark

WHITE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
SHARD_KEYS = 1 << 15
SALT_ROWS = 1 << 16
#: One document in so many is historical where no history is given.
HISTORY = 2
_GAMMA = 2.0
_INDEX = "shard int, salt int, kind int, doc_id long, n_chars long, digest binary, bits binary, slots binary, keeps binary"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_chars, digest): code points of the text and SHA-256 of the text without white space."""

    def run(batches):
        for b in brief(batches):
            texts = [t or b"" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("mark"),
                    pa.array([len(t.translate(None, _CONTINUATION)) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.translate(None, WHITE)).digest() for t in texts], pa.binary()),
                ],
                ["doc_id", "mark", "n_chars", "digest"],
            )

    return id_and_text(docs).withColumn("mark", text_mark()).mapInArrow(run, "doc_id long, mark long, n_chars long, digest binary")


def _best(n_chars="n_chars", doc_id="doc_id"):
    """Of equal texts the row that stays: most code points, then the smallest id, none last."""
    return F.min(F.struct((-F.col(n_chars)).alias("less"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id")))


def _winner(best: DataFrame) -> DataFrame:
    return best.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), "group_size")


def winners(hashed: DataFrame) -> DataFrame:
    """One row per digest: keep_id, keep_chars, group_size. Combined map-side, so a hot digest is one row a task."""
    return _winner(hashed.groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size")))


def taken_in(history: DataFrame, repeats: DataFrame) -> DataFrame:
    """``winners`` of history with the repeats found in its slots (looked-up rows) taken in."""
    new = winners(repeats)
    return _winner(history.unionByName(new).groupBy("digest").agg(_best("keep_chars", "keep_id").alias("best"), F.sum("group_size").alias("group_size")))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (_mix(keys[:, 0] ^ _mix(keys[:, 1] + seed)) % np.uint64(size)).astype(np.int64)


def mph_build(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of bits over distinct keys (n x 4 unsigned 64-bit words). A key owns the first level where it hit a bit alone."""
    levels, rest = [], keys
    while len(rest):
        size = max(64, int(_GAMMA * len(rest)))
        at = _position(rest, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rest = rest[~alone[at]]
        if len(levels) > 200:
            raise ValueError("keys of a minimal perfect hash must be distinct")
    return levels


def mph_slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of every key; -1 where no level has it. Keys that were never added may get any slot: compare the bytes."""
    slot, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        if not len(open_):
            break
        at = _position(keys[open_], level, len(bits))
        hit = bits[at]
        slot[open_[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        open_ = open_[~hit]
        base += int(bits.sum())
    return slot


def _words(digests_: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests_), "<u8").reshape(-1, 4)


def _pack_levels(levels: list[np.ndarray]) -> bytes:
    head = np.array([len(levels), *map(len, levels)], "<i8").tobytes()
    return head + b"".join(np.packbits(x).tobytes() for x in levels)


def _unpack_levels(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(blob, "<i8", n, 8), 8 * (n + 1), []
    for size in map(int, sizes):
        take = (size + 7) // 8
        out.append(np.unpackbits(np.frombuffer(blob, np.uint8, take, at), count=size).astype(bool))
        at += take
    return out


_KEEP = np.dtype([("keep_id", "<i8"), ("none", "<i8"), ("size", "<i8"), ("chars", "<i8")])


def build_index(best: DataFrame, n_shards: int) -> DataFrame:
    """The sharded index over ``winners`` rows: one row a shard with the hash, the digests and the locators by slot."""

    def run(key, table):
        rows = table.to_pydict()
        keys = _words(rows["digest"])
        levels = mph_build(keys)
        order = np.argsort(mph_slots(levels, keys), kind="stable")
        keep = np.zeros(len(keys), _KEEP)
        keep["keep_id"] = [x or 0 for x in rows["keep_id"]]
        keep["none"] = [x is None for x in rows["keep_id"]]
        keep["size"], keep["chars"] = rows["group_size"], rows["keep_chars"]
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()], pa.int32()),
                "n_rows": pa.array([int(keep["size"].sum())], pa.int64()),
                "bits": pa.array([_pack_levels(levels)], pa.binary()),
                "slots": pa.array([keys[order].tobytes()], pa.binary()),
                "keeps": pa.array([keep[order].tobytes()], pa.binary()),
            }
        )

    sharded = best.withColumn("shard", _shard(n_shards))
    return sharded.groupBy("shard").applyInArrow(run, "shard int, n_rows long, bits binary, slots binary, keeps binary")


def _shard(n_shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int")


def lookup(hashed: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """Every row of ``hashed`` with keep_id, group_size and keep_chars of its slot; ``member`` false where the bytes differ or no slot is."""
    spark = hashed.sparkSession
    salts = index.select("shard", F.ceil(F.col("n_rows") / SALT_ROWS).cast("int").alias("n_salts"))
    hot = salts.where("n_salts > 1")
    rows = (
        hashed.withColumn("shard", _shard(n_shards))
        .join(hot, "shard", "left")
        .select(
            "shard", F.pmod(F.xxhash64("doc_id", "mark"), F.coalesce("n_salts", F.lit(1))).cast("int").alias("salt"), F.lit(1).alias("kind"),
            "doc_id", "mark", "n_chars", "digest", *(F.lit(None).cast("binary").alias(c) for c in ("bits", "slots", "keeps")),
        )
    )
    none = F.lit(None)
    tables = index.join(salts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_salts"), F.lit(1)) - 1)).alias("salt"), F.lit(0).alias("kind"),
        none.cast("long").alias("doc_id"), none.cast("long").alias("mark"), none.cast("long").alias("n_chars"), none.cast("binary").alias("digest"), "bits", "slots", "keeps",
    )

    def run(batches):
        at, levels, slots, keeps = None, [], None, None
        for b in batches:
            kinds = b.column("kind").to_numpy(zero_copy_only=False)
            shards = b.column("shard").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(kinds)]
            for lo, hi in zip(edges, edges[1:]):
                if kinds[lo] == 0:  # the same index may come more than once, for several salts in one partition
                    at = int(shards[lo])
                    one = b.slice(lo, 1).to_pydict()
                    levels = _unpack_levels(one["bits"][0])
                    slots = np.frombuffer(one["slots"][0], "<u8").reshape(-1, 4)
                    keeps = np.frombuffer(one["keeps"][0], _KEEP)
                    continue
                part = b.slice(lo, hi - lo)
                keys = _words(part.column("digest").to_pylist())
                n = len(keys)
                found, slot = np.zeros(n, bool), np.zeros(n, np.int64)
                if at == int(shards[lo]):
                    slot = mph_slots(levels, keys)
                    found = slot >= 0
                    found[found] = (slots[slot[found]] == keys[found]).all(axis=1)
                    slot[~found] = 0
                    got = keeps[slot]
                else:
                    got = np.zeros(n, _KEEP)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("mark"), part.column("n_chars"), part.column("digest"), pa.array(found),
                        pa.array(got["keep_id"], mask=~found | (got["none"] != 0)), pa.array(got["size"], mask=~found), pa.array(got["chars"], mask=~found),
                    ],
                    ["doc_id", "mark", "n_chars", "digest", "member", "keep_id", "group_size", "keep_chars"],
                )

    streamed = rows.unionByName(tables).repartition(parallelism(spark), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return streamed.mapInArrow(run, "doc_id long, mark long, n_chars long, digest binary, member boolean, keep_id long, group_size long, keep_chars long")


def n_shards_for(n_keys: int) -> int:
    return max(1, -(-n_keys // SHARD_KEYS))


def exact_dedup(docs: DataFrame, history: tuple[DataFrame, int] | None = None) -> DataFrame:
    """doc_id, mark, n_chars, digest, keep_id, group_size, kept for every row of ``docs``.

    ``history`` is an index and its number of shards, as ``build_index`` gave them for earlier
    documents: their members are repeats of an earlier winner and never kept; the others are grouped
    among themselves. Without it, a part of ``docs`` is the history (see the module's head).
    """
    hashed = materialize(digests(docs), "digests")
    if history is not None:
        found = materialize(lookup(hashed, *history), "looked-up")
        repeats = found.where("member").select("doc_id", "mark", "n_chars", "digest", "keep_id", "group_size", F.lit(False).alias("kept"))
        return repeats.unionByName(exact_dedup_digests(found.where("NOT member").select("doc_id", "mark", "n_chars", "digest")))
    old = F.pmod(F.xxhash64(F.lit("history"), "doc_id", "mark"), F.lit(HISTORY)) == 0
    known = materialize(winners(hashed.where(old)), "winners")
    found = materialize(lookup(hashed.where(~old), *_indexed(known)).select("doc_id", "n_chars", "digest", "member"), "looked-up")
    updated = taken_in(known, found.where("member")).unionByName(winners(found.where("NOT member")))
    found = lookup(hashed, *_indexed(materialize(updated, "updated")))
    mine = (F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("n_chars") == F.col("keep_chars"))
    return _one_kept(found.select("doc_id", "mark", "n_chars", "digest", "keep_id", "group_size", mine.alias("kept")))


def _indexed(best: DataFrame) -> tuple[DataFrame, int]:
    n = n_shards_for(best.count())
    return materialize(build_index(best, n), "mph"), n


def exact_dedup_digests(hashed: DataFrame) -> DataFrame:
    """Nonmembers of a historical index, grouped among themselves by full digest."""
    best = winners(hashed)
    mine = (F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("n_chars") == F.col("keep_chars"))
    return _one_kept(hashed.join(best, "digest").select("doc_id", "mark", "n_chars", "digest", "keep_id", "group_size", mine.alias("kept")))


def _one_kept(rows: DataFrame) -> DataFrame:
    """Of candidate winners repeated under one doc_id, the first only. The window is over winners, of which a digest has few."""
    w = Window.partitionBy("kept", "digest", F.when(~F.col("kept"), F.xxhash64("doc_id", "mark"))).orderBy("n_chars")
    return rows.withColumn("kept", F.col("kept") & (F.row_number().over(w) == 1))


def decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, kept) for ``keep_decided``."""
    return exact_dedup(docs).select("doc_id", "mark", "kept")
