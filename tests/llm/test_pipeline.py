import re
from collections import Counter

import pytest

import corpus_pipeline
from lodegraph.llm import mixing
from lodegraph.llm.common import materialize

from .test_dedup_simhash import closure, normal, plain_fingerprint
from .test_lengths_packing import check_packing


@pytest.fixture(scope="module")
def docs(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    junk = spark.createDataFrame([(50_001, None), (50_002, "123 456"), (50_003, "Ψ" * 500)], "doc_id long, text string")
    twice = table.orderBy("doc_id").limit(2)
    return materialize(table.unionByName(junk, allowMissingColumns=True).unionByName(twice), "fixture")


def test_stages_one_by_one(spark, docs, small):
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = materialize(stage(spark, now, small), "out")
        after = now.collect()
        if name != "best_fit_packing":
            assert now.columns == columns
            assert not Counter(map(tuple, after)) - Counter(map(tuple, before))
        if name == "language_id":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert {50_001, 50_002, 50_003} <= gone and len(gone) < 8
        elif name == "exact_dedup":
            best = {}
            for r in before:
                key = (-len(r.text), r.doc_id)
                best[normal(r.text)] = min(best.get(normal(r.text), key), key)
            assert sorted(r.doc_id for r in after) == sorted(k[1] for k in best.values())
        elif name == "simhash_near_dedup":
            before.sort(key=lambda r: r.doc_id)
            roots = closure([plain_fingerprint(r.text) for r in before])
            assert sorted(r.doc_id for r in after) == [before[i].doc_id for i in sorted(set(roots))]
        elif name == "mix_to_targets":
            p = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(before, docs.schema)).collect()}
            assert sorted(r.doc_id for r in after) == sorted(i for i, r in p.items() if r.mix_kept) and after
        else:
            texts = {r.doc_id: r.text for r in before}
            assert {r.doc_id for r in after} == set(texts)
            ids = {d: i for i, d in enumerate(texts)}
            rows = [type("R", (), r.asDict() | {"doc_id": ids[r.doc_id]}) for r in after]
            check_packing(rows, list(texts.values()), 2048)


def test_empty_table_and_guard(spark, docs, small):
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, small)
        assert out.collect() == []
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"except\s+ImportError", source)



def test_run_is_the_stages_in_turn(spark, small):
    got = corpus_pipeline.run(spark, small)
    now = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, small), "again")
    assert sorted(map(tuple, got.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, now.select("doc_id", "piece", "length", "ids_crc32").collect()))
