import math
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lodegraph.llm import html_extract, langid, mixing

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept &amp; go on.</div><article><h1>A &amp; B</h1><p>First&nbsp; para<br>graph <b>bold.<p>Second <a href=x>link</a> here.<!-- <p>hidden --> <script>"</p>"</script>
<div class="ad">Buy it now.</div><table><tr><td>1</td><td>2</td></tr></table><pre>x
y</pre></article><aside>More</aside><form><label>Name</label><select><option>One</select></form><section id="comments"><article>I liked it.</article></section><footer>&copy; me</footer>"""


def test_article_alone_comes_out():
    assert html_extract.extract(PAGE) == "A & B\nFirst para graph bold.\nSecond link here.\n1 2\nx y"
    plain = '<div id=menu><a>x</a> <a>y</a></div><div><p>' + "A sentence that says something, as sentences do. " * 4 + "</p><p>And then more of the same, for good measure.</p></div><div class='footer'>Imprint.</div>"
    assert html_extract.extract(plain).count("\n") == 1 and "Imprint" not in html_extract.extract(plain)


def test_broken_and_empty_pages(spark):
    for source in (None, "", "   ", "<", "<p", "<a href='", "<!--", "&#x110000; &bogus; &#0;", "<p>" * 3000, "</div>" * 50, "<script>never closed", "<article>" + "x" * 300_000, "<head><title>t", "text only"):
        html_extract.extract(source)
    rows = [(1, "u", None, "x"), (1, "u", "<article><p>Twice.</article>", "x"), (1, "u", "<article><p>Twice.</article>", "x"), (None, None, "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_extract.main_text(df).collect()) == [("", 0), ("", 0), ("Twice.", 6), ("Twice.", 6)]
    assert html_extract.main_text(df.limit(0)).collect() == []


PROSE = "A sentence that says something, as sentences do, and goes on for a while before it ends. "


FITTED = np.array([-1.13, -4.16, 0.31, -0.45, 2.32, 4.28, -0.66, 0.23, 2.73])  # from pages of sf0.1


def test_text_and_neighbours_outweigh_the_markup():
    body = "".join(f"<p>{PROSE * 3}{i}.</p>" for i in range(5))
    for words in ("post category-legal tag-search", "category-social", "comments-open", "has-sidebar", "social", "single-post related"):
        assert html_extract.extract(f"<article class='{words}'>{body}</article>").count(PROSE) == 15, words
        assert html_extract.extract(f"<div class='{words}'>{body}</div>", FITTED).count(PROSE) == 15, words  # by its text alone
    menu = "<nav>" + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(6)) + "</nav>"
    assert html_extract.extract(f"<article>{menu}{body}</article>").count("Item") == 0
    assert "Item" not in html_extract.extract(f"{menu}<article class='category-menu'>{body}</article>")
    # a weak block between prose follows its neighbours, though its own looks and the markup say otherwise
    page = f"<div><p>{PROSE * 3}</p><p class=share>{PROSE * 2}</p><p>{PROSE * 3}</p></div>"
    gain = html_extract.gains(html_extract.read_blocks(page), html_extract.START)
    assert html_extract.marked(html_extract.read_blocks(page)[1]) == -1 and gain[1] < 0
    assert html_extract.label_blocks(html_extract.read_blocks(page), html_extract.START) == [True] * 3 and html_extract.turned(page, html_extract.START)[2] == 1
    assert html_extract.extract(f"<article><p hidden>{PROSE * 5}</p>{body}</article>").count(PROSE) == 15


def test_min_cut_is_least():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 9)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0.1, 2)) for i in range(n) for j in range(i) if rng.random() < 0.4]
        cost = lambda y: sum(abs(g) for g, v in zip(gain, y) if (g > 0) != v) + sum(w for i, j, w in edges if y[i] != y[j])  # noqa: B023, E731
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(2**n))
        assert abs(cost(html_extract.min_cut(gain, edges)) - best) < 1e-6


def test_labels_of_whole_pages_are_the_least_costly_ones():
    rng = random.Random(5)
    kinds = ["<p>{}</p>", "<nav><p>{}</p></nav>", "<div class=ad>{}</div>", "<ul><li><a href=x>{}</a></ul>", "<article><p>{}</p></article>", "<h2>{}</h2>", "<div><div><p>{}</p></div></div>", "<p class=share>{}</p>"]
    against = 0
    for _ in range(120):
        page = "".join(rng.choice(kinds).format(PROSE[: rng.randint(3, 88)] * rng.randint(1, 2)) for _ in range(rng.randint(1, 9)))
        blocks = html_extract.read_blocks(page)
        gain, edges = html_extract.gains(blocks, html_extract.START), html_extract._edges(blocks)
        cost = lambda y: sum(abs(g) for g, v in zip(gain, y) if (g > 0) != v) + sum(w for i, j, w in edges if y[i] != y[j])  # noqa: B023, E731
        best = min((cost(y), y) for y in ([bool(m >> k & 1) for k in range(len(blocks))] for m in range(2 ** len(blocks))))
        label = html_extract.label_blocks(blocks, html_extract.START)
        assert abs(cost(label) - best[0]) < 1e-6 and html_extract.extract(page) == "\n".join(b.text for b, keep in zip(blocks, label) if keep)
        against += html_extract.turned(page, html_extract.START)[2]
    assert against > 20  # blocks that the cut labels against their own costs


def test_broken_and_deep_pages_take_linear_time():
    began = time.time()
    pages = ["<a " * 350_000, "<a \"" * 250_000, "<a '\"" * 250_000, "<div>" * 20_000 + "x", "<div>x" * 20_000, "<div>" * 20_000 + "</b></p></li>" * 20_000, "<head>" * 100_000, "<!" * 300_000, "<" * 500_000, "<script>" * 100_000]
    for source in pages:
        html_extract.extract(source)
    assert time.time() - began < 60  # some seconds in all; hours if the square of the length counted


def test_classifier_moves_from_its_prior():
    x = np.array([[1, 0.9, -1, 0, 0, 0, 1, 1, -1]] * 40 + [[1, 0, 2, 1, 0, 1, 0, 0, 1]] * 40, float)
    w = html_extract.cotrain(x, np.array([0] * 40 + [1] * 40, float), np.zeros(80, bool))
    assert x[0] @ w < x[0] @ html_extract.START and x[-1] @ w > x[-1] @ html_extract.START
    assert (html_extract.fit(np.zeros((0, 9)), np.zeros(0), html_extract.START) == html_extract.START).all()


DOCS = "doc_id long, text string, lang string, source string, n_chars long, mix_p string"


def test_raking_meets_the_margins(spark):
    rng = random.Random(4)
    cells = [(s, la, t, rng.randint(50, 900)) for s in "abc" for la in ("en", "de", None) for t in ("prose", "table")]
    df = spark.createDataFrame(cells, "mix_source string, mix_lang string, mix_topic string, mix_tokens long")
    targets = {"mix_source": {"a": 0.6, "b": 0.3, "c": 0.1}, "mix_lang": 0.5, "mix_topic": {"prose": 0.5, "table": 0.5}}
    got = mixing.rake(df, targets, rounds=25).collect()
    total = sum(r.weight for r in got)
    for k, share in targets["mix_source"].items():
        assert math.isclose(sum(r.weight for r in got if r.mix_source == k) / total, share, abs_tol=1e-6)
    held = Counter()
    for r in got:
        held[r.mix_lang] += r.mix_tokens
    roots = {k: math.sqrt(v) for k, v in held.items()}
    for k in roots:
        assert math.isclose(sum(r.weight for r in got if r.mix_lang == k) / total, roots[k] / sum(roots.values()), abs_tol=1e-5)


def test_mix_edge_cases_and_columns(spark):
    rows = [(i, "word " * (i % 50), "en" if i % 3 else None, f"s{i % 2}" if i % 7 else None, 0, "clash") for i in range(400)]
    rows += [(None, None, None, None, None, None), (5, "word " * 5, "xx", "lonely", 0, None), (5, "word " * 5, "xx", "lonely", 0, None), (6, "", "yy", "empty", 0, None)]
    df = spark.createDataFrame(rows, DOCS)
    kept = mixing.sample(df)
    assert kept.columns == df.columns and 0 < kept.count() < len(rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.mix_p <= 1 for r in got)
    assert [r.mix_p for r in got if r.mix_source == "empty"] == [1.0]
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.sample(df.limit(0)).collect() == []


def test_mix_sql_twin(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    got = mixing.mix(spark.read.parquet(f"{small}/documents.parquet"))
    want = con.sql(mixing.oracle_sql()).df()
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(map(tuple, want.itertuples(index=False)))


def test_scarce_cells_dont_shrink_the_sample(spark):
    cells = [("a", "en", "prose", 50_000), ("a", "de", "prose", 20_000), ("b", "fr", "prose", 18_000), ("b", "en", "table", 3_000), ("b", "es", "prose", 60), ("new", "en", "prose", 5), ("b", None, "brief", 0)]
    df = spark.createDataFrame(cells, "mix_source string, mix_lang string, mix_topic string, mix_tokens long")
    p = {tuple(r)[:3]: r.mix_p for r in mixing.probabilities(df, mixing.TARGETS).collect()}
    assert len(p) == len(cells) and all(0 < x <= 1 for x in p.values())
    assert p["b", "es", "prose"] == p["new", "en", "prose"] == p["b", None, "brief"] == 1.0
    held = {c[:3]: p[c[:3]] * c[3] for c in cells}
    assert math.isclose(sum(held.values()), mixing.BUDGET * sum(c[3] for c in cells), rel_tol=1e-6)  # 0.5 % of the tokens before
    by = lambda k: sum(v for c, v in held.items() if c[1] == k)
    rest = sum(mixing.LANG_SHARES[k] for k in ("en", "de", "fr"))
    assert all(abs(by(k) / sum(held.values()) - mixing.LANG_SHARES[k] / rest) < 0.06 for k in ("en", "de", "fr"))
    all_of_it = mixing.probabilities(df, mixing.TARGETS, budget=1.0).collect()
    assert all(r.mix_p > 0.999999 for r in all_of_it)


def slow_probability(counts, context, c, base):
    """Interpolated Kneser-Ney by its definition; counts: order -> {gram tuple: count}."""
    p = 1.0 / base
    for order in range(1, langid.ORDER + 1):
        ctx, table = context[len(context) - order + 1 :] if order > 1 else (), counts[order]
        ones, twos = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        same = {g: v for g, v in table.items() if g[:-1] == tuple(ctx)}
        total = sum(same.values())
        if total:
            p = max(same.get((*ctx, c), 0) - d, 0) / total + d * len(same) / total * p
    return p


def test_kneser_ney_against_its_definition():
    alphabet = sorted(map(ord, "abcdei"))
    lut = langid.numbering(alphabet)
    base = len(alphabet) + 2
    texts = {"x": ["abba cab", "a bad cab, a dab", "Ace aid"], "y": ["iiii i", "dice idea"]}
    tops, slow = {}, {}
    for lang, ts in texts.items():
        ids, n = langid.encode(ts, lut)
        grams, at = [], 0
        for k in n:
            row = ids[at : at + langid._GAP + k].tolist()
            grams += [tuple(row[i : i + langid.ORDER]) for i in range(k)]
            at += langid._GAP + k
        counts = {langid.ORDER: Counter(grams)}
        for order in range(langid.ORDER - 1, 0, -1):
            counts[order] = Counter(g[1:] for g in counts[order + 1])
        slow[lang] = counts
        code = np.array([sum(c * base ** (langid.ORDER - 1 - i) for i, c in enumerate(g)) for g in grams])
        tops[lang] = np.unique(code, return_counts=True)
    model = langid.Model(alphabet, ["x", "y"], tops)
    ask = ["bad ice", "aaa", "zebra Abe", "", "12 !?", "i"]
    h, n = model.entropies(ask, lut)
    ids, sizes = langid.encode(ask, lut)
    at = 0
    for j, k in enumerate(sizes):
        row = ids[at : at + langid._GAP + k].tolist()
        at += langid._GAP + k
        assert n[j] == k
        for m, lang in enumerate(("x", "y")):
            want = -sum(math.log(slow_probability(slow[lang], row[i : i + 3], row[i + 3], base)) for i in range(k)) / max(k, 1)
            assert math.isclose(h[j, m], want, rel_tol=1e-4, abs_tol=1e-6)
    total = sum(math.exp(model.log_probs(np.array([((2 * base + 3) * base + 4) * base + c]))[0, 0]) for c in range(base))
    assert math.isclose(total, 1.0, rel_tol=1e-3)


def test_neighbours_in_a_batch_dont_matter(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(30).collect()] + ["", None, "ab"]
    lut = langid.numbering(sorted(map(ord, "abcdefghijklmnopqrstuvwxyz")))
    model = langid.Model(sorted(map(ord, "abcdefghijklmnopqrstuvwxyz")), ["q"], {"q": np.unique(langid.codes(langid.encode(texts[:20], lut)[0], 28), return_counts=True)})
    together = model.entropies(texts, lut)[0]
    alone = np.concatenate([model.entropies([t], lut)[0] for t in texts])
    assert np.allclose(together, alone)


def test_language_of_held_out_documents(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(2_000_001, None), (2_000_002, ""), (2_000_003, "12 34 !?"), (2_000_003, "12 34 !?"), (2_000_004, "Ψ" * 400)], "doc_id long, text string")
    both = docs.unionByName(extra, allowMissingColumns=True).withColumn("rejected", F.lit("clash"))
    got = langid.identify(both).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(truth) + 5 and sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in got if r.doc_id not in truth}
    assert [odd[i].lang_pred for i in (2_000_001, 2_000_002, 2_000_003)] == ["und"] * 3 and odd[2_000_004].rejected
    assert sum(r.rejected for r in got if r.doc_id in truth) / len(truth) < 0.01
    kept = langid.confident(both)
    assert kept.columns == both.columns and kept.where("doc_id > 2000000").count() == 0
    assert langid.identify(docs.limit(0)).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(unlabelled).collect()] == [("und", 0.0)]


def test_many_letters_and_rare_scripts(spark):
    rng = random.Random(9)
    han, scripts = [chr(0x4E00 + i) for i in range(3000)], {"ka": range(0x10D0, 0x10F1), "hy": range(0x561, 0x587), "th": range(0xE01, 0xE2F)}
    words = {lang: ["".join(rng.choice(han[at : at + 2000]) for _ in range(2)) for _ in range(1500)] for lang, at in (("zh", 0), ("ja", 1000))}
    words |= {lang: ["".join(chr(rng.choice(cps)) for _ in range(4)) for _ in range(60)] for lang, cps in scripts.items()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(120)), lang) for i, lang in enumerate(list(words) * 40)]
    rows += [(None, f"{rows[k][1]} {k}", rows[k][2]) for k in range(40)]  # one id, many texts
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: x for i, _, x in rows}
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and all(r.lang_pred == lang[r.doc_id] for r in held)


def test_junk_is_rejected(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1500)) for _ in range(20)] + ["όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια " * 9] * 5
    mixed = docs.unionByName(spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in langid.confident(mixed).select("doc_id").collect()}
    assert sum(i >= 10**6 for i in kept) <= 2 and len(kept) >= 0.99 * docs.where("text IS NOT NULL").count()
