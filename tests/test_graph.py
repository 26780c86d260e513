import json
import math
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodegraph import cli
from lodegraph.api import Engine, NotIndexed
from lodegraph.functions import render
from lodegraph.functions import text as tx
from lodegraph.operators import ranking, selection
from lodegraph.sources import ignore
from lodegraph.sources.scan import ScanOptions, first_bad_byte

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark".split()
TWINS = "symbol_search_substr neighborhood_both_d2_limit anchor_smallest_node edges_resolved integrity_spans fingerprint cand_enclosing score_file_dependencies compact_enclosing".split()


def plain(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


@pytest.mark.parametrize("name", TWINS)
def test_sql_twins(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, small)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    files = {
        "app/service.py": "from app.store import Store\n\nclass Service:\n    limit = 3\n    def charge(self, amount):\n        self.check(amount)\n        return Store().save(amount)\n    def check(self, amount):\n        raise_invalid(amount)\n",
        "app/store.py": "class Store:\n    def save(self, row):\n        return row\n",
        "app/tests/test_service.py": "def test_charge():\n    charge_ok()\n",
        "lib/Util.java": "package lib;\nclass Util { int twice(int x) { return twice(x); } }\n",
        "build/gen.py": "x = 1\n", "skip/a.py": "def a(): pass\n", "skip/keep.py": "def keep(): pass\n", ".gitignore": "skip/*\n!keep.py\n", "bad.py": "def broken(:\n", "bin.py": "a\0b", "notes.txt": "no\n", "empty.go": "",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def indexed(spark, tree, tmp_path_factory):
    engine = Engine(spark, "file://" + str(tmp_path_factory.mktemp("store")))
    with pytest.raises(NotIndexed):
        engine.health(tree)
    return engine, engine.index(tree)


def test_index_and_health(indexed, tree):
    engine, result = indexed
    g = engine.graph(tree)
    assert [r.path for r in g.file.orderBy("id").collect()] == ["bad.py", "bin.py", "empty.go", "app/service.py", "app/store.py", "app/tests/test_service.py", "lib/Util.java", "skip/keep.py"]
    assert (result.mode, result.files, result.cache_hits) == ("full", 8, 0)
    h = engine.health(tree, include_integrity=True)
    assert h["files"] == "8" and h["diagnostics"] == "2" and h["language.python"] == "6"
    assert {v for k, v in h.items() if k.startswith("integrity.")} == {"ok"}
    used = g.edge.where("kind = 'uses_type'").collect()
    stores = {r.id for r in g.node.where("name = 'Store'").collect()}
    assert all(r.dst_node_id not in stores or r.unresolved_dst is None for r in used)


def test_search_and_neighborhood(indexed, tree):
    engine, _ = indexed
    top = engine.symbols(tree, "Service").collect()
    assert [(r.name, r.score) for r in top][:1] == [("Service", 100)] and len(top) >= 3
    assert engine.symbols(tree, "  ").collect() == []
    symbols, chunks = engine.search(tree, "charge")
    assert symbols.first().score == 120 and chunks.count() >= 2
    nodes, edges = engine.neighborhood(tree, "Service.charge")
    assert {r.name for r in nodes.collect()} == {"charge", "check"} and edges.count() == 2
    with pytest.raises(LookupError):
        engine.neighborhood(tree, "nothing at all")
    with pytest.raises(ValueError):
        engine.neighborhood(tree, "Service", depth=-1)
    assert engine.resolve_anchor(tree, "app/service.py", 6).first().node_name == "charge"


def test_context_bundles(indexed, tree, tmp_path):
    engine, _ = indexed
    bundle = json.loads(engine.context(tree, file="app/service.py", line=6, budget=500, output_format="json"))
    assert [i["kind"] for i in bundle["items"]][:2] == ["target.definition", "enclosing.type"] and bundle["anchor"]["node_name"] == "charge"
    assert "unresolved calls: Store().save" in bundle["uncertainty_notes"]
    whole = json.loads(engine.context(tree, file=os.path.join(tree, "app/service.py"), goal="failure-modes", output_format="json", output=str(tmp_path / "b.json")))
    assert whole["items"][0]["kind"] == "file.outline" and (tmp_path / "b.json").exists()
    assert "## Items" in engine.context(tree, symbol="Service.check", goal="call-neighborhood")
    with pytest.raises(ValueError, match="budget"):
        engine.context(tree, symbol="x", budget=0)


def test_command_line(indexed, tree, spark):
    engine, _ = indexed
    ask = lambda *argv: cli.run(["--store", engine.store.root, "--repo", tree, *argv], spark)
    assert ask("symbols", "Service")[1].split("\n")[0].split("\t")[1:4] == ["100", "type", "Service"]
    assert "files: 8" in ask("health")[1] and ask("inspect-node", "999")[0] == 1
    assert ask("context", "--symbol", "x", "--file", "y") == (1, "error: give a symbol or a file, not both")
    assert ask("neighborhood", "nothing here")[0] == 1


def test_incremental(indexed, tree):
    engine, first = indexed
    again = engine.index(tree)
    assert (again.mode, again.snapshot_id, again.cache_hits) == ("unchanged", first.snapshot_id, 8)
    with open(os.path.join(tree, "app/store.py"), "a") as f:
        f.write("\n\ndef extra():\n    pass\n")
    third = engine.index(tree)
    assert (third.mode, third.cache_hits, third.cache_misses) == ("incremental", 7, 1) and third.snapshot_id > first.snapshot_id
    assert engine.symbols(tree, "extra").first().score == 100


def test_ignore_patterns(spark):
    cases = [
        (["*.py"], ["a.py", "d/a.py"], ["a.pyc"]), (["/a.py"], ["a.py"], ["d/a.py"]), (["d/"], ["d/x", "e/d/x"], ["d"]), (["a/b"], ["a/b", "a/b/c"], ["x/a/b"]), (["**/b"], ["b", "a/b", "a/c/b/x"], ["bc"]),
        (["a/**"], ["a/x", "a/b/c"], ["a"]), (["a/**/z"], ["a/z", "a/b/c/z"], ["az"]), (["x?.[ch]"], ["x1.c", "xx.h"], ["x.c", "x1.d"]), (["*", "!*.md"], ["a"], ["b.md"]), (["# c", "", r"\#x"], ["#x"], ["c"]), (["[!a]b"], ["cb"], ["ab"]),
    ]
    for lines, hit, miss in cases:
        df = spark.createDataFrame([(p,) for p in hit + miss], "path string").select("path", ignore.matches(F.col("path"), ignore.compile_lines(lines)).alias("m"))
        assert {r.path: r.m for r in df.collect()} == dict.fromkeys(hit, True) | dict.fromkeys(miss, False), lines
    assert ScanOptions().use_ignore_files


def test_text_expressions(spark):
    texts = ["", "a", "a\n", "\n\n", "a\nb", "é" * 5]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.line_count(F.col("t")).alias("n"), tx.token_estimate(F.col("t")).alias("k"), tx.snippet(F.col("t"), F.lit(1), F.lit(1)).alias("s")).orderBy("i").collect()
    assert [(r.n, r.k, r.s) for r in rows] == [(0, 0, None), (1, 1, "a"), (1, 1, "a\n"), (2, 1, "\n"), (2, 1, "a\n"), (1, 2, "é" * 5)]
    paths = ["tests/x.cpp", "a/tests/x.cpp", "test_a.py", "a/FooTest.java", "a/b.H++", ".java", "x/Gen/a.go", "vendor/a.rs", "a.generated.java"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(tx.is_test(F.col("p")), tx.language_of(F.col("p")), tx.is_generated(F.col("p")), tx.is_vendor(F.col("p"))).collect()
    assert [r[0] for r in got] == [False, True, True, True, False, False, False, False, False]
    assert [r[1] for r in got] == ["cpp", "cpp", "python", "java", "cpp", None, "go", "rust", "java"]
    assert [(r[2], r[3]) for r in got][-3:] == [(True, False), (False, True), (True, False)]
    assert first_bad_byte([b"ok\t\n", b"a\x01b", b"a\xffb", None]) == [(None, None), ("binary_source", 1), ("invalid_utf8", 1), (None, None)]


def test_selection_rules(spark):
    cols = "request_id long, family int, ord int, kind string, file string, start_line long, end_line long, text string, token_estimate long, confidence double, score double, node_kind string, is_vendor boolean, edge_id long, edge_kind string"
    row = lambda o, kind, file, s, e, tok, score, vendor=False: (1, 5, o, kind, file, s, e, "", tok, 1.0, score, None, vendor, None, None)
    required = spark.createDataFrame([(1, 0, 1, "target.definition", "a", 5, 9, "", 10, 1.0, 9.0, None, False, None, None)], cols)
    optional = spark.createDataFrame([row(1, "x", "a", 1, 20, 5, 5.0), row(2, "x", "a", 9, 12, 5, 4.0), row(3, "x", "b", 1, 2, 30, 6.0), row(4, "x", "b", 3, 4, 50, 2.0), row(5, "diagnostic.parser", "vendor/z", 1, 1, 1, 0.01, True), row(6, "x", None, None, None, 2, 0.1)], cols)
    verdicts = lambda goal, **k: {r.ord: r.verdict for r in selection.select(required, optional, 50, goal, **k).where("place > 0").collect()}
    assert verdicts("explain") == {1: "overlap", 2: "overlap", 3: "selected", 4: "budget", 6: "selected", 5: "budget"}
    assert verdicts("dependencies") == {1: "overlap", 2: "selected", 3: "selected", 4: "budget", 6: "selected", 5: "budget"}
    assert set(verdicts("explain", max_items=1).values()) == {"max-items"}
    assert [r.rank for r in selection.ranks(selection.select(required, optional, 50, "explain")).orderBy("rank").collect()] == [1, 2, 3]
    assert ranking.policy("unknown goal") == ranking.policy("explain")


def test_rendering():
    assert render.fence("a ```` b") == "`````" and render.confidence_label(0.59) == "weak heuristic"


def test_works_without_the_training_data_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(repo):
        if name not in (".git", "corpus_pipeline.py", "lodegraph", "tests"):
            os.symlink(os.path.join(repo, name), tmp_path / name)
    subprocess.run(["cp", "-r", os.path.join(repo, "lodegraph"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lodegraph/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fingerprint' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_request_rules_come_in_order(tmp_path):
    from lodegraph.operators.anchors import request_problem

    asked = {"goal": "no", "output_format": "no", "budget": 0, "max_items": 0, "symbol": None, "file": None, "line": None, "output": f"{tmp_path}/none/x"}
    said = []
    for fix in ({"goal": "explain"}, {"output_format": "text"}, {"budget": 1}, {"max_items": 1}, {"symbol": "s", "file": "f", "line": 0}, {"file": None}, {"symbol": None, "file": "f"}, {"line": 1}, {"output": f"{tmp_path}/x"}):
        said.append(request_problem(**asked))
        asked |= fix
    assert request_problem(**asked) is None
    starts = ("unsupported goal", "unsupported format", "budget", "max items", "give a symbol or a file", "give a symbol or a file, not both", "a line goes", "line must", "no such folder")
    assert len(said) == len(starts) and all(x.startswith(s) for x, s in zip(said, starts))


def test_fold_is_a_stream_over_sorted_candidates(spark):
    """A request's candidates, of which vendored diagnostics give very many, were one array, and every step copied all verdicts before it."""
    cols = "request_id long, family int, ord int, kind string, file string, start_line long, end_line long, token_estimate long, score double, node_kind string, is_vendor boolean"
    required = spark.createDataFrame([(1, 0, 1, "target.definition", "a", 5, 9, 10, 9.0, None, False)], cols)
    many = [(r, 2, o, "diagnostic.parser", f"vendor/{o}", 1, 1, 1 + o % 3, 1.0, None, True) for r in (1, 2) for o in range(1, 3001)] + [(1, 7, 1, "sibling.definition", "a", 5, 9, 1, 99.0, None, False), (2, 7, 1, "x", "a", 5, 9, 0, 0.0, None, False)]
    said = selection.verdicts(required, spark.createDataFrame(many, cols), 50, "failure-modes")
    assert "collect_list" not in said._jdf.queryExecution().toString()
    rows = said.collect()
    by = {(r.request_id, r.family, r.ord): (r.place, r.verdict) for r in rows}
    assert len(rows) == len(many) and sorted(r.place for r in rows if r.request_id == 2) == list(range(1, 3002))
    assert by[1, 7, 1] == (1, "overlap") and by[2, 7, 1][1] == "selected"
    taken = lambda r: sum(1 + o % 3 for (q, f, o), (_, v) in by.items() if (q, f, v) == (r, 2, "selected"))
    assert (taken(1), taken(2)) == (40, 50)


def test_names_and_diagnostics_go_by_keys(spark, small):
    """No pattern or OR is joined pair by pair, and only the files asked for are read into candidates."""
    from lodegraph.operators import candidates as ca
    from lodegraph.plans import adapters, registry
    from lodegraph.plans.graph import Graph

    g = adapters.graph(spark, small)
    anchors = registry.lines(spark, small, g)
    for df in (ca.tests(g, anchors), ca.diagnostics(g, anchors)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, plan
    names = ["FooBarBaz", "a_name_of", "X", "fo\\obar", "100%sure", "été_là"]
    one = lambda rows, cols: spark.createDataFrame(rows, cols)
    node = one([(k, n, f"q.{n}", 0, "type", "s", 1.0) for k, n in enumerate(names)], "id long, name string, qualified_name string, file_id long, kind string, symbol_key string, confidence double")
    file = one([(0, "src/tests/foobarbaz.py", True), (1, "src/main.py", False)], "id long, path string, is_test boolean")
    chunk = one([(k, k, "definition", 0, 1, 1, "t", 1) for k in range(len(names))] + [(9, 0, "definition", 1, 1, 1, "t", 1)], "id long, node_id long, kind string, file_id long, start_line long, end_line long, text string, token_estimate long")
    asked = ["foobarbaz", "name_of", "a%f", "x", "fo\\obar", "0%s", "T__l", "", "nothing"]
    hits = ca._named_like(Graph(file, node, None, chunk, None, None, None), one([(a,) for a in asked], "needle string")).select("needle", "chunk_id").collect()
    import re as rx

    like = lambda p, t: rx.search("".join({"%": ".*", "_": "."}.get(c, rx.escape(c)) for c in p), t) is not None
    want = sorted((a, k) for a in asked for k, n in enumerate(names) if like(a, "src/tests/foobarbaz.py") or like(a, n.lower()) or like(a, f"q.{n.lower()}"))
    assert sorted((r.needle, r.chunk_id) for r in hits) == want


def test_rows_without_a_key_are_spread(spark):
    """Joined by null, they met in one task: half of the facts of dangling_to_unresolved."""
    from lodegraph.operators import resolve

    facts = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, "a").alias("src_key"), F.when(F.col("id") % 4 == 1, "b").when(F.col("id") == 3, "?").alias("dst_key"), F.lit(None).cast("string").alias("unresolved_src"), F.lit(None).cast("string").alias("unresolved_dst"))
    keys = spark.createDataFrame([("a", 1), ("b", 2)], "symbol_key string, node_id long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = resolve.attach(facts, keys)
        held = [r["count"] for r in out.where("dst_key IS NULL").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(held) > 1 and max(held) < 0.6 * sum(held), held
    rows = {r.id: (r.src_node_id, r.dst_node_id, r.unresolved_src, r.unresolved_dst) for r in out.collect()}
    assert len(rows) == 2000 and rows[0] == (1, None, None, None) and rows[1] == (None, 2, None, None) and rows[3] == (None, None, None, "?")


def test_spans_and_terms_are_not_sorted(spark, small):
    from lodegraph.operators import health, search
    from lodegraph.plans import adapters

    plan = health.span_problems(adapters.graph(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in next(x for x in plan.split("\n") if "Join" in x), plan[:2000]
    docs = ["a a a b", "É a, b-A b", "", None, "b a", "aa b a\nb x"]
    table = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    found = search.bm25(table, "a_b e")
    assert not any(x in found._jdf.queryExecution().toString() for x in ("collect_list", "posexplode"))
    assert [r.id for r in found.collect()] == [1]
    counted = {r.id: r.bm25 for r in search.bm25(table, "a_a").collect()}
    n, avg, f, length = 6, (4 + 5 + 0 + 2 + 5) / 5, 2, 4
    assert list(counted) == [0] and abs(counted[0] + math.log((n - 1 + 0.5) / 1.5) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avg))) < 1e-9
