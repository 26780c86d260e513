import hashlib
import random
import re

import duckdb
import xxhash
from pyspark.sql import functions as F

from lodegraph.llm import url_filter, winnowing

PAGES = "page_id long, url string, html string, host string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", None) for i, (u, h) in enumerate(rows)], PAGES)


def judged(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_hosts_paths_and_longest_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.example.com/en/q", "http://www.example.com/EN/", "x://badexample.com/en/1",
        "http://net/es/", "http://a.net/fr/1/2", "http://a.net/fr", "http://É.net/es/ü", "http://example.com", "http://example.com?/en/", "a://b://c/d", "http://u@h.com:80/p",
    ]
    got = judged(url_filter.judge(pages(spark, [(u, None) for u in urls])))
    want = [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("example.com", "/en/", "example.com/en/", "block"), ("a.example.com", "/en/q", "example.com/en/", "block"), ("www.example.com", "/EN/", "com/", "allow"), ("badexample.com", "/en/1", "com/", "allow"),
        ("net", "/es/", "net/es/", "block"), ("a.net", "/fr/1/2", "net/fr/", "block"), ("a.net", "/fr", None, "allow"), ("É.net", "/es/ü", "net/es/", "block"), ("example.com", "", None, "allow"),
        ("example.com", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("u@h.com:80", "/p", None, "allow"),
    ]
    assert [got[i] for i in range(len(urls))] == want
    assert url_filter.judge(pages(spark, [])).collect() == []
    assert judged(url_filter.judge(pages(spark, [("http://a.com/", None)]), rules=[])) == {0: ("a.com", "/", None, "allow")}


def test_decisions_spread_over_aliases(spark):
    canonical = '<head><LINK href="{}" rel=canonical></head>'
    rows = [
        ("http://a.org/1", canonical.format("http://x.net/es/1")), ("http://b.org/2#f", canonical.format("//a.org/1")), ("http://c.org/3", None), ("http://d.org/4", canonical.format("/5")),
        ("http://d.org/5", None), ("http://e.org/6", canonical.format("http://y.net/fr/")), ("http://f.com/7", canonical.format("http://e.org/6")), ("http://x.net/es/1", None), ("https://a.org/1", None),
        ("http://g.org/8", '<meta http-equiv="Refresh" content="0; URL=http://a.org/1">'), (None, canonical.format("http://x.net/es/1")), ("http://h.org/9", canonical.format("http://h.org/9")),
    ]
    redirects = spark.createDataFrame([("http://c.org/3", "http://b.org/2"), (None, "http://x.net/es/1"), ("http://d.org/5", None)], "source string, target string")
    got = {i: v[3] for i, v in judged(url_filter.judge(pages(spark, rows), redirects=redirects)).items()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "block", 10: "allow", 11: "allow"}


def test_links_are_read_like_a_browser_does(spark):
    rows = [
        ("http://a.org/x/y?q=1", "<!-- <link rel=canonical href=http://no.net/es/1> --><script>'<link rel=canonical href=http://no.net/es/2>'</script><title><link rel=canonical href=/no></title>"),
        ("http://b.org/x/y?q=1", "<link rel='nofollow CANONICAL' href='http://x.net/es/?a=1&amp;b=2'><link href=\"../p\" rel=canonical><link rel=canonical href='./q/./r/..'>"),
        ("http://c.org/x/y?q=1", "<link rel=canonical href='?z=&#x20ac;&#38;'><link rel=stylesheet href=/no><link rel=canonicalised href=/no><link data-rel=canonical href=/no>"),
        ("http://d.org", "<link rel=canonical href=s><link rel=canonical href='//e.org/../../t/'><link rel=canonical href='mailto:x'><link rel=canonical href='#top'><link rel=canonical>"),
        ("HTTP://F.org/a/b", "<META content='5; URL=\"/m/../n\"' http-equiv='Refresh'><meta http-equiv=refresh content=5><link rel=canonical href='/&#99999999;&#xd800;&bogus;'>"),
        ("http://g.org/" + "x" * 100_000, "<link " + "a=b " * 50_000 + "rel=canonical href=/deep>" + "<!--" * 20_000), (None, "<link rel=canonical href=/no>"), ("nothing", "<link rel=canonical href=/no>"), ("http://h.org/", None),
    ]
    got = sorted((r.source.split("/")[2].lower(), r.target) for r in url_filter.page_links(pages(spark, rows)).where("target IS NOT NULL").collect())
    assert got == sorted([
        ("b.org", "http://x.net/es/?a=1&b=2"), ("b.org", "http://b.org/p"), ("b.org", "http://b.org/x/q/"), ("c.org", "http://c.org/x/y?z=€&"), ("d.org", "http://d.org/s"), ("d.org", "http://e.org/../../t/"),
        ("f.org", "HTTP://f.org/n"), ("f.org", "HTTP://f.org/&"), ("g.org", "http://g.org/deep"),
    ])


def test_aliases_against_plain_form_and_sql(spark):
    rng = random.Random(6)
    urls = [f"http://{h}/{p}{i}" for i, (h, p) in enumerate((h, p) for h in ("a.org", "b.net", "c.com", "d.example.com") for p in ("", "es/", "fr/", "en/", "x?y="))] * 2
    rows = []
    for u in urls:
        to = [rng.choice(urls) for _ in range(rng.choice((0, 0, 0, 1)))]
        rows.append((u, "<body>" + "".join(f"<link rel=canonical href='{t.replace('&', '&amp;')}'>" for t in to) + "<!-- <link rel=canonical href=http://b.net/es/6> -->"))
    rows += [("http://a.org/alone", "<link rel=canonical href='http://z.net/fr/9'>"), ("http://z.net/fr/9", None), ("http://q.org/2", "<link rel=canonical href='http://a.org/alone'>")]
    urls += [u for u, _ in rows[-3:]]
    df = pages(spark, rows)
    edges = [(u, t) for u, h in rows for t in re.findall("href='([^']*)'", h or "")]
    group = {u: {u} for u in urls}
    for u, t in edges:
        both = group[u] | group[t]
        for x in both:
            group[x] = both
    own = {u: v for (u, _), v in zip(rows, [r.verdict if r.rule else None for r in url_filter.judge(df.withColumn("html", F.lit(None).cast("string"))).orderBy("page_id").collect()])}
    want = []
    for i, (u, _) in enumerate(rows):
        said = {own[x] for x in group[u]}
        want.append((i, own[u] or ("block" if "block" in said and "allow" not in said else "allow")))
    got = url_filter.judge(df)
    assert sorted((r.page_id, r.verdict) for r in got.collect()) == want and any(own[u] is None and v == "block" for (i, v), (u, _) in zip(want, rows))
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert sorted(con.sql(url_filter.oracle_sql()).fetchall()) == sorted(tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect())


def test_many_rules_are_joined(spark, monkeypatch):
    rng = random.Random(7)
    rules = [(h, "/" + "ab"[: rng.randint(0, 2)] * rng.randint(0, 2), rng.choice(("allow", "block"))) for h in ("com", "x.com", "y.x.com", "z.org", "org") for _ in range(4)]
    rows = [(f"http://{h}/{''.join(rng.choice('abc') for _ in range(4))}", None) for h in ("com", "w.com", "x.com", "q.y.x.com", "ax.com", "z.org", "") for _ in range(6)] + [(None, None)]
    inline = sorted(map(str, url_filter.judge(pages(spark, rows), rules).collect()))
    monkeypatch.setattr(url_filter, "INLINE_RULES", 0)
    columns = ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, url_filter.judge(pages(spark, rows), rules).select(columns).collect())) == inline


def test_url_sql_twin(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{small}/pages.parquet')")
    want = sorted(con.sql(url_filter.oracle_sql()).fetchall())
    df = url_filter.judge(spark.read.parquet(f"{small}/pages.parquet"))
    assert sorted(tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()) == want
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def runs_of(text):
    """Hash of every run of characters, by the definition: each run from its characters."""
    text = "\x02" * (winnowing.CHARS - 1) + text
    of = {c: xxhash.xxh64_intdigest(c, 42) for c in set(text)}
    out = []
    for i in range(len(text) - winnowing.CHARS + 1):
        h = 0
        for j, c in enumerate(text[i : i + winnowing.CHARS]):
            h ^= of[c] << winnowing.SHIFT * (winnowing.CHARS - 1 - j) & (1 << 64) - 1
        out.append(h - (h >> 63 << 64) >> 31)  # signed, the upper 33 bits
    return out


def plain(text):
    """(hash, position) that any window chose, rightmost of equal ones."""
    runs, out = runs_of(text), []
    for i in range(max(1, len(runs) - winnowing.WINDOW + 1) if runs else 0):
        window = range(i, min(i + winnowing.WINDOW, len(runs)))
        best = max(window, key=lambda j: (-runs[j], j))
        if not out or best != out[-1]:
            out.append(best)
    return [(runs[i] & (1 << 33) - 1, i) for i in out]


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return round(2 * len(a & b) / (len(a) + len(b)), 6) if a or b else 1.0


def test_winnowing_against_plain_form(spark):
    texts = ["", " \n", "a", "abc", "abcdefg", "abcdefgh", "x" * 50, "le  la\tun " * 9, "\U0001f600é中" * 9, "これは空白のない文章です。" * 3, "\x02tail of it \x0b", "ab" * 3000]
    df = winnowing.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", "fp")
    for r in df.select("doc_id", winnowing.render(F.col("fp")).alias("f"), winnowing.positions(F.col("fp")).alias("p")).collect():
        want = plain(texts[r.doc_id])
        assert (r.f, r.p) == ("".join(f"{h:09x}" for h, _ in want), [i for _, i in want]), texts[r.doc_id]


def test_shared_runs_share_a_hash_at_known_positions():
    shared = "0123456789a"  # CHARS + WINDOW - 1
    for k in range(40):
        a, b = "".join(chr(65 + (k * 7 + i * i) % 26) for i in range(k)) + shared + "zz" * k, "q" * (k % 5) + shared + str(k) * 9
        first, second = dict(plain(a)), dict(plain(b))
        at = [(first[h] - a.index(shared), second[h] - b.index(shared)) for h in first.keys() & second.keys()]
        assert any(p == q for p, q in at), (a, b)


def edit(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def chained(rows):
    """Documents in order: descending id, null last, then a hash of the text."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1] or "", 42)), r[1] or ""))


def signed(x):
    return x - (x >> 63 << 64)


def test_edited_neighbours_against_plain_form(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 3)
    texts = {9: "a b c d e f g h", 7: None, 5: "", 3: "é" * 7, 2: "one two three four five six seven", 1: "x", 40: "one two three four five six seven", -4: "last of all these words are", 11: "k l m n o p q", 12: "z" * 100_000, 13: "ab", 14: "abcde"}
    hot = [(77, f"text {i} of a repeated id {i * i}") for i in range(20)] + [(None, f"no id {i}") for i in range(20)] + [(8, "alike")] * 9
    rows = [*texts.items(), *hot]
    got = winnowing.compare_edited(spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id long, text string, n_chars long, h string")).collect()
    chain = chained(rows)
    want = []
    for k, (i, t) in enumerate(chain):
        t, following = t or "", chain[(k + 1) % len(chain)][1] or ""
        e = edit(t, following)
        f, g = plain(t), plain(e)
        text = lambda x: "".join(f"{h:09x}" for h, _ in x)
        want.append((i or -1, len(t), hashlib.sha256(e.encode()).hexdigest(), text(f), text(g), alike(f, g), alike(f, plain(following)), [p for _, p in f]))
    assert sorted((r[0] or -1, *r[1:]) for r in got) == sorted(want)
    one = winnowing.compare_edited(spark.createDataFrame([(1, "just one here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(edit("just one here", "just one here").encode()).hexdigest()
    assert winnowing.compare_edited(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_edited_texts_stay_near(spark, small):
    df = winnowing.compare_edited(spark.read.parquet(f"{small}/documents.parquet"))
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
    rows = df.collect()
    long = [r for r in rows if r.n_chars > 1500]
    assert sum(r.near_edited for r in long) / len(long) > 0.35 > 5 * sum(r.near_next for r in long) / len(long)
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    chain, by = chained([tuple(r) for r in table]), {r.doc_id: r for r in rows}
    for (i, t), (_, following) in zip(chain, chain[1:] + chain[:1]):
        t, e = t or "", edit(t or "", following or "")
        assert (by[i].n_chars, by[i].edited_sha256, by[i].near_edited, by[i].near_next) == (
            len(t), hashlib.sha256(e.encode()).hexdigest(), alike(plain(t), plain(e)), alike(plain(t), plain(following or ""))
        )


def test_short_and_unsegmented_texts_stay_near(spark):
    words = "amber basket copper dolphin engine feather garden hollow island jacket kettle ladder marble needle orchard pepper quarry ribbon saddle timber".split()
    short = [" ".join(words[(i * 7 + j * 3) % 20] for j in range(5 + i % 7)) for i in range(20)]
    dense = ["".join(chr(0x4E00 + (i * 911 + j * 37) % 9000) for j in range(40 + i)) for i in range(20)]
    for texts in (short, dense):
        rows = winnowing.compare_edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert len(rows) == 20 and min(r.near_edited for r in rows) > 0.1, sorted(r.near_edited for r in rows)  # 0 for nearly all by words


def test_texts_around_stretches_against_plain_form(spark):
    whole = "".join(chr(97 + (i * i * 7 + i // 5) % 26) for i in range(400))
    near = [n + by for n in (winnowing.STRETCH, 2 * winnowing.STRETCH, 3 * winnowing.STRETCH) for by in range(-5, 9)]
    texts = [whole[-n:] if n else "" for n in [*range(14), *near]] + ["y" * 300, "\U0001f600é" * 97]
    chain = chained(list(enumerate(texts)))
    docs = spark.createDataFrame(chain, "doc_id long, text string")
    got = {r.doc_id: r for r in winnowing.compare_edited(docs).collect()}
    one = {r.doc_id: (r.f, r.p) for r in winnowing.with_fingerprint(docs, "text", "fp").select("doc_id", winnowing.render(F.col("fp")).alias("f"), winnowing.positions(F.col("fp")).alias("p")).collect()}
    for (i, t), (_, following) in zip(chain, chain[1:] + chain[:1]):
        own, edited = plain(t), plain(edit(t, following))
        want = "".join(f"{h:09x}" for h, _ in own), "".join(f"{h:09x}" for h, _ in edited), [p for _, p in own]
        assert (got[i].fingerprint, got[i].edited_fingerprint, got[i].positions) == want and one[i] == (want[0], want[2]), (i, len(t))
        assert (got[i].near_edited, got[i].near_next) == (alike(own, edited), alike(own, plain(following)))


def test_characters_are_read_in_compiled_code(spark):
    """No lambda over characters or runs; cutting is fused (a text isn't copied to every stretch), layers aren't (one method of them is too large)."""
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = winnowing.compare_edited(docs)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert not any("zip_with" in x or "xxhash64(lambda" in x for x in plan)
    cuts, layers = [x for x in plan if "slice(chars" in x or "explode(sequence" in x], [x for x in plan if "shiftleft(h0" in x or "xxhash64(piece" in x]
    assert len(cuts) == 2 and all(re.search(r"\*\(\d+\) (Project|Generate)", x) for x in cuts), cuts
    assert len(layers) == 4 and not any(re.search(r"\*\(\d+\) Project", x) for x in layers), layers
    assert any("SortAggregate" in x and "collect_list" in x for x in plan) and not any("ObjectHashAggregate" in x and "collect_list" in x for x in plan)


def test_a_task_holds_few_ranges_whatever_the_partitions(spark, monkeypatch):
    """Too much in one task is spilled; up to 32 ranges, about 16,000 documents, were one task's where a session has few partitions."""
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 5)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1000)], "doc_id long, text string")
    tasks = winnowing._with_next(docs).rdd.getNumPartitions()
    assert tasks >= 1000 // 5 // 4, tasks
