import random
import zlib

import numpy as np
from helpers import ODD, documents

from routelake.llm import html_text as H
from routelake.llm import language as L
from routelake.llm.boosting import BoostedTrees

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in L.identify_documents(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert set(rows) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_families_are_learned(spark):
    model = L.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(map(sorted, model.families)) == [["de", "en"], ["es", "fr"]]
    assert set(model.pairs) == {("de", "en"), ("es", "fr")}


def test_language_of_odd_rows(spark):
    docs = documents(spark, ODD, langs=["en"] * 5 + ["de"] * 4 + [None] * (len(ODD) - 9))
    got = {r.doc_id: r for r in L.identify_documents(docs).collect()}
    for i in (0, 1, 2, 3, 11, 12):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert all(got[i].lang_pred in ("en", "de") for i in (4, 6, 10, 13, 15))
    assert got[13][1:] != () and got[13].lang_pred == got[14].lang_pred
    assert L.identify_documents(documents(spark, [])).collect() == []
    assert {r.lang_pred for r in L.identify_documents(documents(spark, ODD)).collect()} == {"und"}
    one = documents(spark, ["abc def"] * 9, langs=["en"] * 9)
    assert {r.lang_pred for r in L.identify_documents(one).collect()} == {"en"}


def test_stage_keeps_rows_as_they_are(spark):
    docs = documents(spark, ["hello there you", "was ist das", "123", None] * 6, langs=["en", "de", "en", None] * 6)
    kept = L.keep_identified(docs, least=0.0)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(24) if i % 4 < 2]


def test_unlearned_languages_go_and_short_texts_stay(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()
    rng = random.Random(4)
    gone = ["这是一个关于城市历史的长篇文章 我们今天讨论 数据处理 的方法 和结果", "это длинный текст на русском языке который рассказывает о погоде и городах",
            "tämä on pitkä suomenkielinen teksti joka kertoo säästä ja kaupungista jossa olemme asuneet monta vuotta",
            " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60))]
    short = [" ".join(r.text.split()[:n]) for r in rows for n in (1, 3, 8)]
    short = [t for t in short if sum(c.isalpha() for c in t) > len(t) / 2]
    assert len(short) > 2000
    learned = [r.text for r in rows]
    for languages in (("en", "de", "fr", "es"), ("en", "de", "fr"), ("en",)):
        langs = [r.lang if r.lang in languages else None for r in rows]
        texts = learned + short + gone
        kept = {r.doc_id for r in L.keep_identified(documents(spark, texts, langs=langs + [None] * (len(texts) - len(langs)))).collect()}
        stay = [i for i, v in enumerate(langs) if v]
        go = [i for i, v in enumerate(langs) if not v]
        assert sum(i in kept for i in stay) >= 0.995 * len(stay)
        assert sum(i in kept for i in go) <= 0.05 * len(go)
        assert not kept & set(range(len(learned) + len(short), len(texts)))
        if len(languages) == 4:
            assert sum(len(learned) <= i for i in kept) >= 0.99 * len(short)


def test_three_languages_vote():
    rng = np.random.RandomState(0)
    x = np.abs(rng.randn(90, L.BUCKETS)).astype(np.float32) * 0.01
    label = ["a", "b", "c"] * 30
    for i, v in enumerate(label):
        x[i, "abc".index(v)] += 1
    model = L.Hierarchy(x, label)
    assert sorted(v for f in model.families for v in f) == ["a", "b", "c"]
    assert model.predict(x)[0] == label


def test_boosted_trees_learn_an_interaction():
    rng = np.random.RandomState(0)
    x = rng.rand(2000, 5)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    p = BoostedTrees(x[:1500], y[:1500], trees=40).probability(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.93


def test_decoder_matches_brute_force():
    import itertools
    rng = random.Random(1)
    for _ in range(40):
        page = H.Page()
        for _ in range(rng.randint(0, 5)):
            page.add("div", rng.randrange(len(page.tag)))
        n = len(page.tag)
        p = np.array([rng.uniform(0.05, 0.95) for _ in range(n)])

        def value(choice):       # 0 drop, 1 keep, 2 split; below a whole subtree nothing is chosen
            total, state = 0.0, [None] * n
            for i in range(n):
                above = state[page.parent[i]] if i else 2
                state[i] = choice[i] if above == 2 else above
                yes, no = np.log(p[i]), np.log(1 - p[i])
                total += max(yes, no) - H.SPLIT_COST if state[i] == 2 else yes if state[i] else no
            return total, [s == 1 or s == 2 and p[i] > 0.5 for i, s in enumerate(state)]
        best = max((value(c) for c in itertools.product((0, 1, 2), repeat=n)), key=lambda v: v[0])
        kept = H.decode(page, p)
        assert kept == best[1] or abs(value([1 if k else 0 for k in kept])[0] - best[0]) < 1e-9


def model():
    import pyarrow.parquet as pq
    return H.learn(pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist()[:60])


def test_pages_give_their_article(spark):
    import html
    import re
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in H.extract_pages(pages, H.train(pages)).collect()}
    right = 0
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
        want = " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)
        right += got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert right >= 0.98 * len(got)


def test_other_templates():
    """Parts that the training variants know only by their kind."""
    body = " ".join(f"<p>{s}</p>" for s in ["A long first paragraph, with commas, and more words than others have.", "A second &amp; last <b>one</b>, that ends the story here, too."] * 3)
    page = f"""<html><body><header><h1>Site</h1><nav><a href=1>Home</a> <a href=2>News</a></nav></header>
      <div class="cookie-consent">We use cookies. <button>Accept</button></div>
      <div class="article-body"><h1>Title here</h1>{body}</div>
      <aside class="sidebar"><h3>Related</h3><ul><li><a href=3>Other story</a></li><li><a href=4>More</a></li></ul></aside>
      <form action="/s"><input><button>Search</button></form>
      <section id="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this at all, sir.</p></div></section>
      <footer>Copyright 2020</footer></body></html>"""
    text = H.extract(page, model())
    assert text.startswith("Title here A long first paragraph") and text.endswith("that ends the story here, too.")
    for gone in ("Home", "cookies", "Related", "agree", "Copyright", "Search"):
        assert gone not in text


def test_rare_marked_pages_are_found(spark):
    rows = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").limit(40).collect()]
    plain = [f"<html><body><div>menu {i}</div><p>words {i}</p><!-- <article> --></body></html>" for i in range(3000)]
    copies = ["<article><p>the same words, again.</p></article>"] * 1500
    table = [(i, h) for i, h in enumerate(plain + copies + rows)]
    pages = spark.createDataFrame(table, "page_id long, html string").repartition(3)
    seen, learn = [], H.learn
    H.learn = lambda sources: seen.extend(sources)
    try:
        H.train(pages)
        H.train(pages, 20)
    finally:
        H.learn = learn
    assert sorted(seen[:-20]) == sorted({*copies, *rows})
    assert len(set(seen[-20:])) == 20 and set(seen[-20:]) <= {*copies, *rows}
    assert H.train(spark.createDataFrame(table[:3000], "page_id long, html string")) is None


def test_text_rules():
    page = H.parse("<p>a<b>b</b> c&nbsp;&lt;d<br>e<p>f\n  g<script>x</script><!-- y --><ul><li>h<li>i</ul>j &notit; <style>z")
    assert H.gather(page, None) == "ab c <d e f g h i j ¬it;"
    assert H.gather(H.parse("<a href='x>y'>t</a><div"), None) == "t<div"


def test_embedded_elements_are_read():
    for name in ("svg", "math", "object", "canvas", "audio", "video", "template", "noscript"):
        assert H.gather(H.parse(f"<p>a</p><{name} id=x><p>b</p></{name}><p>c"), None) == "a b c"
        assert H.gather(H.parse(f"<article><p>a</p><{name}><p>b</p></article><p>c"), None) == "a b c"
        assert H.gather(H.parse(f"<p>a</p><{name}/><p>b"), None) == "a b"
    assert H.gather(H.parse("<p>so <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn></math> holds"), None) == "so x=1 holds"
    assert len(H.parse("<svg><path d='M0'/><circle r='1'/></svg><p>a").tag) == 3
    for name in ("textarea", "title", "iframe", "noembed", "noframes"):
        assert H.gather(H.parse(f"<p>a</p><{name}>b</{name}><p>c</p><{name}><p>d"), None) == "a c d"
    body = "".join(f"<p>Sentence {i}, with <math><mi>x</mi><mo>=</mo><mn>{i}</mn></math> and more words, ends here.</p>" for i in range(6))
    for name in ("canvas", "object", "video", "svg"):
        page = f"<html><body><nav><a href=1>Home</a> <a href=2>News</a></nav><article><h1>Title here</h1><{name} class=x>{body}</article><footer>Copyright 2020</footer></body></html>"
        text = H.extract(page, model())
        assert all(f"Sentence {i}, with x={i} and more" in text for i in range(6)) and "Home" not in text


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<p>" * 3000 + "deep"), (None, "u", "no markup"), (5, "u", "<article><p>" + "x, y. " * 200_000), (5, "u", "</p></div>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = H.extract_pages(pages, H.train(pages)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(r.text == "" for r in got if r.page_id in (1, 2))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract_pages(empty, H.train(empty)).collect() == []
    assert H.train(empty) is None
