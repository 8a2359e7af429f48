from __future__ import annotations

import html
import itertools
import random
import re

from conftest import DATA

from tallyframe.llm.extract import best_run, extract, learn_weights, main_text


def test_best_run_against_all_runs():
    rng = random.Random(0)
    for _ in range(300):
        scores = [rng.uniform(-2, 2) for _ in range(rng.randrange(0, 12))]
        begin, end = best_run(scores)
        best = max((sum(scores[a:b]) for a, b in itertools.combinations(range(len(scores) + 1), 2)), default=0)
        assert abs(sum(scores[begin:end]) - max(best, 0)) < 1e-9


WEIGHTS = {"word": 1.0, "p": -0.05, "/p": -0.05, "b": -0.05, "/b": -0.05, "h1": -0.05, "/h1": -0.05, "article": -30, "/article": -30, "li": -5, "/li": -5}


def test_what_is_left_out():
    page = (
        "<!DOCTYPE html><html><head><title>Title words</title><style>p{a:b}</style><script>if (a<b) x('</p>');</script></head><body>"
        "<header>Site head</header><nav><ul><li><a href='x>y'>Menu</a></li></ul></nav><div class='ad top'>Buy this now</div><article>"
        "<h1>A &amp; B</h1><p><b>First</b>\n  block&nbsp;here &lt;x&gt; with some words<br>more<p>Second block follows the first one"
        "<aside>Side words that do not belong here</aside><div id=newsletter><form><input>Your mail</form></div><!-- hidden --><p>Third block of the text</p>"
        "<div class='comments'><p>A reader says something</p></div></article><footer>&copy; foot</footer></body>"
    )
    assert main_text(page, WEIGHTS) == "A & B\n\nFirst block here <x> with some words more\n\nSecond block follows the first one\n\nThird block of the text"
    assert [main_text(p, WEIGHTS) for p in (None, "", "<p></p>", "<nav>a b</nav>", "<", "<p")] == ["", "", "", "", "<", ""]
    assert main_text("plain words &am", WEIGHTS) == "plain words &am"


def test_given_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    assert learn_weights(pages)["/article"] < -1
    got, out = extract(pages.selectExpr("*", "1 as text"))
    for r in got.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r[out] == "\n\n".join(b for b in blocks if b)


def test_articles_with_links_lists_and_classes(spark):
    """Weights of pages whose articles have no such elements, on an article that has them."""
    weights = learn_weights(spark.read.parquet(f"{DATA}/pages.parquet"))
    assert all(w >= -2 for k, w in weights.items() if "article" not in k)
    text = "Ten words stand in each of the blocks of text"
    page = (
        "<html class='has-sidebar'><body class='has-sidebar menu'><nav><ul><li><a href=x>Menu</a></li></ul></nav>"
        "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul>"
        "<form id=search><div class='content no-comments'><div class='related'><article class='post no-comments header'>"
        f"<p>{text} <a href=x>with a link</a> in it.</p><ul><li>{text}</li><li><a href=y>{text}</a></li></ul>"
        f"<figure><img><figcaption>{text}</figcaption></figure><p class='ad-hoc'>{text} <math><mi>x</mi></math></p><object><p>{text}</p></object>"
        "<div class='box comments'><p>A reader says something</p></div></article></div></div></form>"
        "<div class=related><article><p>Another page</p></article></div><footer>foot</footer></body></html>"
    )
    assert main_text(page, weights) == "\n\n".join([f"{text} with a link in it.", text, text, text, f"{text} x", text])


def test_awkward_tables(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, None, "<p>" + "word " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got, out = extract(pages)
    assert sorted(len(r[out]) for r in got.collect()) == [0, 0, 0, 999_999]
    assert extract(pages.limit(0))[0].count() == 0
