import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodegraph.llm import exact_dedup, simhash
from lodegraph.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, digest string, kept string"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "clash", None) for i, t in zip(ids, texts)], DOCS)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_mph_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 77, 5000):
        keys = rng.integers(0, 2**63, (n, 4), dtype=np.uint64)
        levels = exact_dedup.mph_build(keys)
        assert sorted(exact_dedup.mph_slots(levels, keys).tolist()) == list(range(n))
        back = exact_dedup._unpack_levels(exact_dedup._pack_levels(levels))
        assert [x.tolist() for x in back] == [x.tolist() for x in levels]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        best = min(groups[normal(t)])
        out.append((i, best[3], len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 3)
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 2)
    texts = [None, "", " \n", "a b", "ab", "a\tb ", "é x", "x" * 200_000, "éx", "ab\xa0", *["hot copy"] * 9]
    rows = list(enumerate(texts)) + [(3, "a b"), (None, "hot copy "), (None, "alone")]
    got = exact_dedup.exact_dedup(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got], key=repr) == brute(rows)
    kept = [r.digest for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.digest for r in got})
    assert exact_dedup.exact_dedup(table(spark, [])).collect() == []
    monkeypatch.setattr(exact_dedup, "HISTORY", 1)  # all is history, then nearly nothing
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in exact_dedup.exact_dedup(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()], key=repr) == brute(rows)
    monkeypatch.setattr(exact_dedup, "HISTORY", 1000)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in exact_dedup.exact_dedup(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()], key=repr) == brute(rows)


def test_lookup_tells_members_by_all_bytes(spark):
    hashed = exact_dedup.digests(table(spark, [f"text {i % 70}" for i in range(100)]))
    known, n = exact_dedup._indexed(exact_dedup.winners(hashed.where("doc_id < 50")))
    found = exact_dedup.lookup(hashed.where("doc_id >= 50"), known, n).collect()
    assert {r.doc_id for r in found if r.member} == set(range(70, 100)) and all(r.keep_id == r.doc_id - 70 for r in found if r.member)
    assert all(r.keep_id is None for r in found if not r.member)


def test_history_members_go_and_the_rest_is_grouped(spark):
    old = exact_dedup.winners(exact_dedup.digests(table(spark, ["one", "two", "three"])))
    index = (exact_dedup.build_index(old, 2), 2)
    rows = exact_dedup.exact_dedup(table(spark, ["o ne", "four", "fo ur", "five", None], range(10, 15)), index).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows} == {(10, 0, False), (11, 12, False), (12, 12, True), (13, 13, True), (14, 14, True)}


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprint_equals_plain_form_and_sparks_hash(spark, small):
    texts = [None, "", " ", "One", "one two", "One TWO three", "É a b c d É", "a b a b a b a b", "w " * 70_000]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_fingerprint(t) for t in texts]
    assert spark.sql("SELECT xxhash64('a b c') AS h").first().h % 2**64 == xxhash.xxh64_intdigest("a b c", seed=42)


def some_fingerprints():
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [rng.choice(fps) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)]
    fps += [0xFFFF | rng.getrandbits(6) << 40 for _ in range(80)] + [0, 1, 3, 7, 2**63, 2**64 - 1]
    return sorted(set(fps))


def test_links_close_like_all_pairs(spark, monkeypatch):
    fps = some_fingerprints()
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    at = {f: i for i, f in enumerate(fps)}
    for full, levels in ((4096, {0}), (3, {0, 1, 2})):
        monkeypatch.setattr(simhash, "FULL", full)
        assert {r.level for r in simhash.celled(df).select("level").distinct().collect()} == levels
        edges = [(at[r.fa % 2**64], at[r.fb % 2**64]) for r in simhash.links(df).collect()]
        members = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert [members.get(i, i) for i in range(len(fps))] == closure(fps)


def test_tiles_are_compared_whole_and_skipped_by_population_count(monkeypatch):
    rng = np.random.default_rng(4)
    fp = np.unique(np.concatenate([rng.integers(0, 2**64, 900, dtype=np.uint64), rng.integers(0, 2**10, 300, dtype=np.uint64)]))
    cell = rng.integers(0, 3, len(fp))
    order = np.lexsort((fp, np.bitwise_count(fp), cell))
    cell, fp = cell[order], fp[order]
    pop = np.bitwise_count(fp)
    want = {(int(x), int(y)) for x, y in zip(*np.nonzero(np.triu((np.bitwise_count(fp[:, None] ^ fp[None]) <= 3) & (cell[:, None] == cell[None]), 1)))}
    for tile in (1, 8, 64, 5000):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "_forest", lambda x, y: (x, y))
        found, compared, skipped = simhash.tile_links(cell, pop, fp)
        assert {(int(x), int(y)) for xs, ys in found for x, y in zip(xs, ys)} == want
        assert tile > 64 or skipped > 0  # pairs beyond the radius aren't compared
        if tile == 1:
            assert compared == sum(abs(int(pop[i]) - int(pop[j])) <= 3 and cell[i] == cell[j] for i in range(len(fp)) for j in range(i, len(fp)))
            assert compared + skipped == sum(n * (n + 1) // 2 for n in np.bincount(cell).tolist())


def test_forest_of_a_tile_pair_loses_no_connection():
    x, y = np.nonzero(np.ones((30, 40)))
    a, b = simhash._forest(x, y + 30)
    assert len(a) == 69 and len({*a.tolist(), *b.tolist()}) == 70


def test_rows_without_an_id_link_and_one_of_a_component_stays(spark):
    near = ["w " * 40 + x for x in ("a", "b", "c")]
    rows = [(None, near[0]), (7, near[1]), (None, near[2]), (None, "alone and without an id"), (None, "w " * 40 + "a"), (8, "quite another text, unlike them all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 7), (-1, 7), (-1, 7), (7, 7), (8, 8)]
    assert sorted((r.doc_id or -1) for r in simhash.decisions(df).where("kept").collect()) == [-1, 7, 8]
    none = spark.createDataFrame([(None, t) for t in near], "doc_id long, text string")
    assert simhash.decisions(none).where("kept").count() == 1


def test_near_duplicates_on_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = table(spark, [None, "", " "], [9001, 9000, 9002]).select("doc_id", "text")
    rows = docs.select("doc_id", "text").unionByName(extra).collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs.select("doc_id", "text").unionByName(extra).withColumn("fp", F.lit("x"))).collect()}
    rows.sort(key=lambda r: r.doc_id)
    fps = [plain_fingerprint(r.text) for r in rows]
    assert [got[r.doc_id] for r in rows] == [(f"{f:016x}", rows[c].doc_id) for f, c in zip(fps, closure(fps))]
    assert simhash.near_duplicates(table(spark, [])).collect() == []


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(8, 60)] + [(5, 5), (None, 3), (3, None), (160, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 1 for i in [*range(100, 161), 1]} | {j: 7 for j in range(7, 60)}
    assert got == want
