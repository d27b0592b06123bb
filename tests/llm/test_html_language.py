import random
import re

import pytest

from tracegrain.llm import html_extract, language_id

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{margin:0}</style></head><body>
<header class="top"><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="cookie-banner"><p>We use cookies to make this site work better for all of you.</p></div>
<article class="post comment-open"><header><h1>A title &amp; more</h1></header>
<p>First&nbsp;paragraph with <b>bold <i>and</i> a <a href="x>y">link</a>.<p>Second   one
goes on<br>here<script>var t="</p><p>bad</p>";</script>.</p><div class="ad">Buy now!</div><p>Ok</p>
<form><label>Mail</label><input><button>Go</button></form><div class="reader-comments"><p>I disagree with all of it, really.</p></div></article>
<aside>Sidebar with a long text that says nothing of use to anybody at all.</aside><footer>&copy; 2024</footer></body></html>"""


def test_article_only():
    assert html_extract.main_text(PAGE) == "A title & more\n\nFirst paragraph with bold and a link.\n\nSecond one goes on here.\n\nOk"


def test_the_tree_learns_its_table():
    x, y = html_extract.labelled_table()
    tree = html_extract.grow(x, y)
    assert [html_extract.decide(tree, r) for r in x] == y.tolist() and 0.3 < y.mean() < 0.7


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<article><p>one <b>two<p>three", "one two\n\nthree"), ("<article><p>x < y &lt; z &#233;&#x41;</p>", "x < y < z éA"),
        ("<article><p>cut off</p><p>in a tag <a hr", "cut off\n\nin a tag"), ("<article><!-- <p>no</p> --><p>a<!-- b -->c</p><script>never ends <p>no", "ac"),
        ("<article><p title='a>b'>q</p><p>r\"s</p></article><nav>menu</nav>", "q\n\nr\"s"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
    ],
)
def test_broken_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>T</title><meta charset=x><body><article><p>one</p></article>", "one"), ("<head><title>T</title><article><p>one</p></article>", "one"),
        ("<article><p>one <svg width='1'/>two <canvas/>three</p><p>four</p></article>", "one two three\n\nfour"),
        ("<article><div><p>one</p><button>Go</div><p>two <svg><g><path/></g></svg>three</p></article>", "one\n\ntwo three"),
        ("<article><p>one <svg><path d='1'><p>two</p><p>a <span><math></span>b</p><p>c <video><p>no</p></video>d</p></article>", "one\n\ntwo\n\na b\n\nc d"),
    ],
)
def test_dropped_elements_left_open_end_with_their_parent(page, text):
    assert html_extract.main_text(page) == text


def test_very_long_page_is_read_whole():
    body = "".join(f"<p>word{i} is here</p>" for i in range(20_000))
    assert html_extract.main_text(f"<nav>m</nav><article>{body}</article>").count("\n\n") == 19_999


def test_tables(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "3 AS `x.y`")
    got = html_extract.extract_main_text(df)
    assert got.columns == ["page_id", "url", "x.y", "text"] and sorted(len(r.text) for r in got.collect()) == [0] + [len(html_extract.main_text(PAGE))] * 2
    assert html_extract.extract_main_text(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="text"):
        html_extract.extract_main_text(df.withColumnRenamed("url", "text"))


WORDS = {"en": "the house and garden were with their own water ", "de": "das haus und der garten waren mit ihrem wasser ", "fr": "la maison et le jardin avec leur eau était "}


def docs(spark):
    return spark.createDataFrame([(i, WORDS[lang] * (1 + i % 4), lang) for i, lang in enumerate(list(WORDS) * 10)], "doc_id long, text string, lang string")


def page(text, lang=""):
    return f"<html{f' lang={lang}' if lang else ''}><body><article><p>{text}</p></article></body></html>"


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in language_id.identify(df, language_id.train(docs(spark))).collect()}


def test_evidence_is_fused(spark):
    rows = [(i, f"https://a.shop.de/{i}", page(WORDS["de"] * 3, "de")) for i in range(20)]
    rows += [(100 + i, f"http://b.site.fr/{i}", page(WORDS["fr"] * 3, "fr")) for i in range(20)]
    rows += [
        (200, "https://a.shop.de/x", page("")),  # no text: host and suffix decide
        (201, "https://other.shop.de/x", page("")),  # unknown host: its domain decides
        (202, "https://b.site.fr/y", page(WORDS["de"] * 9, "fr")),  # a clear text outweighs the rest
        (203, None, None),
        (204, "https://new.example/", page("", "fr")),  # the declaration alone
    ]
    got = run(spark, rows)
    assert all(got[i].lang == "de" and got[100 + i].lang == "fr" for i in range(20))
    assert [got[i].lang for i in (200, 201, 202, 204)] == ["de", "de", "de", "fr"]
    assert got[200].text_lang is None and got[203].host == "" and got[203].lang in WORDS and 0 < got[203].confidence <= 1


def test_text_model_on_held_out_words(spark):
    model = language_id.train(docs(spark))
    assert model.languages == ["de", "en", "fr"]
    assert model.languages[int(model.log_likelihood("the water and their house").argmax())] == "en"


def test_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert language_id.identify(empty, language_id.train(docs(spark))).count() == 0
    none = language_id.train(docs(spark).limit(0))
    one = spark.createDataFrame([(1, "http://x.y/", "<p>a")], "page_id long, url string, html string").selectExpr("*", "1 AS lang", "2 AS host")
    assert language_id.identify(one, none).first().lang is None
    both = language_id.identify(one.union(one), language_id.train(docs(spark))).collect()
    assert len(both) == 2 and both[0] == both[1]


def test_a_declaration_far_into_the_page(spark):
    late = "<!--" + "licence <html lang=de> " * 400 + "-->" + page("", "fr")
    wide = page("").replace("<html>", f"<html data-x='{'y' * 9000}' lang = \" fr\">")
    rows = [(i, f"http://{i}.example/", h) for i, h in enumerate((late, wide, page("", "fr"), None))]
    got = run(spark, rows)
    assert [got[i].declared for i in range(4)] == ["fr", "fr", "fr", ""]
    assert [language_id.declared_language(h) for h in ("<html " * 20_000, "<html lang=" + " " * 20_000, "<!--" * 20_000)] == [""] * 3


def test_a_rare_declaration_keeps_its_own_likelihood(spark):
    """More than 500 codes: the rarest is French, the other rare ones German."""
    codes = [a + b for a in "abcdefghijklmnopqrstuvwxy" for b in "abcdefghijklmnopqrstuvwxyz"][:550]
    made = [(c, "de" if i % 2 or i >= 490 else "fr", 2 if i >= 490 else 3) for i, c in enumerate(codes)] + [("zz", "fr", 1)]
    made = [(c, lang) for c, lang, k in made for _ in range(k)]
    rows = [(i, f"http://h{i}.x{i}/", page(WORDS[lang] * 3, c)) for i, (c, lang) in enumerate(made)]
    assert run(spark, rows + [(-1, None, page("", "zz"))])[-1].lang == "fr"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><div class='form-of-life'><p>One text about a form of life.</p></div></article>", "One text about a form of life."),
        ("<article><div class='research search-results'><p>We searched and found it all.</p></div></article>", "We searched and found it all."),
        ("<article><p>It is here.</p></article><div id=comments><article class=comment-body><p>I disagree.</p></article></div>", "It is here."),
        ("<article class='commentary'><p>It is here.</p></article><article class='comment'><p>I disagree.</p></article>", "It is here."),
        ("<main><p>It is here and goes on.</p></main><aside><article><h3>Read more</h3><p>A teaser.</p></article></aside>", "It is here and goes on."),
        ("<div>Home</div><div>" + "word " * 40 + "</div><div>" + "more " * 40 + "</div><div>© 2024 Site</div>", ("word " * 40).strip() + "\n\n" + ("more " * 40).strip()),
        ("<div>Home</div><h1>A title of it</h1><p>" + "word " * 40 + "</p><p>Short one.</p><p>" + "more " * 40 + "</p><div>Copyright 2024</div>",
         "A title of it\n\n" + ("word " * 40).strip() + "\n\nShort one.\n\n" + ("more " * 40).strip()),
    ],
)
def test_names_are_one_kind_of_evidence(page, text):
    assert html_extract.main_text(page) == text


def test_the_tree_looks_at_names_and_neighbours():
    used, todo = set(), [html_extract.trained_tree()]
    while todo:
        node = todo.pop()
        if "feature" in node:
            used.add(html_extract.FEATURES[node["feature"]])
            todo += [node["low"], node["high"]]
    assert used >= {"words", "words_after", "link_density", "clear_name"}


def posterior(rows, model, strength=4.0):
    """The fused posterior of each page, computed plainly."""
    import numpy as np

    def soft(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    n, read = len(model.languages), []
    for i, url, h in rows:
        m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", url or "")
        host = m[1].lower() if m else ""
        loglik = model.log_likelihood(html_extract.main_text(h))
        read.append((i, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], language_id.declared_language(h), loglik, soft(loglik)))
    counts = [dict() for _ in range(4)]
    for r in read:
        for table, key in zip(counts, r[1:5]):
            table[key] = table.get(key, np.zeros(n)) + r[6]
    hosts, domains, suffixes, declared = counts
    total = sum(r[6] for r in read)
    base = (total + 1) / (total.sum() + n)
    smooth = lambda c, parent: (np.maximum(c, 0) + strength * parent) / (max(c.sum(), 0) + strength)
    said = lambda table, key: np.log((table[key] + 1) / (total + sum(k != "" for k in table) + 1)) if key else np.zeros(n)
    out = {}
    for i, host, domain, suffix, code, loglik, p in read:
        prior = smooth(hosts[host] - p, smooth(domains[domain], smooth(suffixes[suffix], base)))
        post = soft(loglik + np.log(prior) + said(declared, code) + said(suffixes, suffix))
        out[i] = (host, suffix, code, model.languages[int(post.argmax())], float(post.max()))
    return out


def test_posterior_equals_a_plain_computation(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        lang = rng.choice(list(WORDS))
        words = " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.choice([0, 1, 3, 40, 9000 if i == 7 else 5])))
        url = rng.choice([None, "", "not a url", f"https://{rng.choice('ab')}.{rng.choice(['shop', 'site'])}.{rng.choice(['de', 'fr', 'com'])}/p{i}", f"HTTP://user@Host{i % 3}.ORG:80/?x"])
        rows.append((i, url, rng.choice([None, page(words, rng.choice(["", lang, "xx"])), page(words, lang)])))
    model = language_id.train(docs(spark))
    got = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    want = posterior(rows, model)
    assert len(got) == 60
    for r in got:
        assert (r.host, r.suffix, r.declared, r.lang) == want[r.page_id][:4] and abs(r.confidence - want[r.page_id][4]) < 1e-9


def test_too_many_languages_are_an_error(spark):
    with pytest.raises(ValueError, match="most_languages"):
        language_id.train(docs(spark), most_languages=2)
