"""Pages whose content, markup or wrapper is unusual; odd hosts; vectors of doubles."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shiftlab.llm import ann, html_text, url_filter

PAGE = "page_id long, url string, html string"


def text(page):
    return html_text.page_text(page, None)


def test_the_content_is_not_the_first_article_at_any_price():
    assert text("<main><h1>T</h1><p>x</p></main><article>card</article>") == "T\nx"
    story = "<div><h1>Story</h1>" + "".join(f"<p>paragraph {k} of the story</p>" for k in range(20)) + "</div>"
    got = text(f"<body>{story}<article>teaser</article></body>")
    assert got.startswith("Story\nparagraph 0") and "paragraph 19 of the story" in got
    assert text(f"<main><p>intro</p><article>{story}</article></main>").startswith("Story\n")
    assert text(f"<main>{story}<article>teaser</article></main>").startswith("Story\n")
    assert text("<main> </main><article>one</article><article>two</article>") == "one\ntwo"


def test_weak_marks_do_not_empty_the_content():
    assert text('<article><h1>T</h1><div class="widget-text">the whole article stands here</div></article>') \
        == "T\nthe whole article stands here"
    assert text('<article><p>long enough a text</p><div class="widget-text">more</div></article>') == "long enough a text"
    assert text('<article><p id="social-history">x</p><h2 id="share-prices">y</h2><p>z</p></article>') == "x\ny\nz"
    assert text('<body><div class="sidebar-left">only this</div></body>') == "only this"


@pytest.mark.parametrize("page, want", [
    ("<p title='it's'>Body</p>", "Body"),
    ('<p title="a > b">Body</p><p>two</p>', "Body\ntwo"),
    ("<p title=it's>Body</p>", "Body"),
    ('<p title="open>Body</p><p>two</p>', "Body\ntwo"),
    ("<p a='1' b = \"2\" c=3 d>Body</p>", "Body"),
    ("1 < 2 <b>and</b> 3 > 2", "1 < 2 and 3 > 2"),
])
def test_quotes_in_tags(page, want):
    assert text(page) == want


def test_tags_are_read_in_linear_time():
    for page in ("<p " + "a='" * 30_000, "<p " + 'x="y" ' * 30_000, "<p " + "=" * 60_000, "<p a=" + '"' * 60_001 + ">x"):
        start = time.time()
        text(page)
        assert time.time() - start < 2


def test_hidden_elements_go():
    for mark in ('aria-hidden="true"', 'style="color:red; display: none"', "style='visibility:hidden'", "hidden"):
        assert text(f"<body><div {mark}>cookie notice</div><p>kept</p></body>") == "kept"
    for mark in ('aria-hidden="false"', 'style="display:block"'):
        assert text(f"<body><div {mark}>shown</div></body>") == "shown"


def test_a_header_goes_also_in_an_article():
    assert text("<article><header><h1>H</h1></header><p>body text</p></article>") == "body text"


def host_pages(n, make):
    return [(k, f"http://h.example/{k}", make(k)) for k in range(n)]


def test_headings_that_all_articles_share_stay(spark):
    pages = host_pages(12, lambda k: f"<body><article><h1>Title {k}</h1><h2>Background</h2><p>{'word ' * 30}{k}</p></article></body>")
    for r in html_text.main_text(spark.createDataFrame(pages, PAGE)).collect():
        assert r.text.split("\n")[:2] == [f"Title {r.page_id}", "Background"]


def test_template_texts_are_counted_over_all_pages_of_a_host(spark):
    """Eight sampled pages may agree by chance: half of the host's pages lack the second text."""
    def make(k):
        second = "Read more here" if k < 20 else f"Own line {k}"
        return f"<body><div>All the news</div><p>{second}</p><p>{'word ' * 30}{k}</p></body>"
    pages = host_pages(40, make)
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, PAGE)).collect()}
    assert all("All the news" not in t for t in got.values())
    assert all(t.startswith("Read more here" if k < 20 else f"Own line {k}") for k, t in got.items())
    few = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages[:3], PAGE)).collect()}
    assert all(t.startswith("All the news") for t in few.values())


def test_the_wrapper_finds_the_content_of_pages_that_name_it_otherwise(spark):
    """On a host whose pages have their text in ``article``, a page whose article is too short for the
    element rules is still read from that place of the wrapper."""
    def make(k):
        story = "tiny" if k == 7 else f"story {k} " + "word " * 60
        return f"<body><div><b>teasers {k} of today, of the week and of the year</b></div><article><p>{story}</p></article></body>"
    pages = host_pages(30, make)
    assert text(make(7)).startswith("teasers")
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, PAGE)).collect()}
    assert got[7] == "tiny" and all(t.startswith(f"story {k} word") for k, t in got.items() if k != 7)


def test_wrappers_are_aligned_with_all_pages_of_a_host(spark):
    """Every page brings an element that no other has, and some are longer than 200,000 characters."""
    def make(k):
        body = "".join(f"<{t}>own {k}</{t}>" for i, t in enumerate(("h2", "h3", "h4", "ul", "ol", "dl")) if k >> i & 1)
        return f"<body><div>All the news</div>{body}<p>{'word ' * (50_000 if k % 9 == 8 else 30)}{k}</p></body>"
    pages = [(k, h, m, f"k{k}", 1) for k, h, m in host_pages(64, lambda k: html_text._encoded(html_text._simple(html_text.tokens(make(k)))))]
    shapes = spark.createDataFrame(pages, "page_id long, host string, shape string, key string, n long").withColumn("host", F.lit("h"))
    wrappers = html_text.learn_wrappers(shapes)
    matched = shapes.join(wrappers, "host").select("key", "host", "shape", "wrapper").mapInArrow(
        html_text._matched, "key string, host string, number int, places array<int>, once array<boolean>").collect()
    assert {r.key for r in matched} == {f"k{k}" for k in range(64)} and {r.number for r in matched} == {0}
    assert len({r.places[0] for r in matched}) == 1 and all(r.once[0] for r in matched)
    got = html_text.main_text(spark.createDataFrame(host_pages(64, make), PAGE)).collect()
    assert len(got) == 64 and not any("All the news" in r.text for r in got)
    assert all(r.text.count(f"own {r.page_id}") == bin(r.page_id).count("1") and r.text.endswith(f"word {r.page_id}") for r in got)


def test_a_page_that_does_not_match_ends_soon():
    """Wrappers of mixed blocks have many optional groups side by side."""
    r = random.Random(4)

    def page(n, odd=False):
        kinds = ["<div>{}</div>", "<p>{}</p>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<table><tr><td>{}</td></tr></table>"]
        body = [r.choice(kinds).format(f"t{r.randint(0, 9)}") for _ in range(n)]
        if odd:
            body[n // 2] = "<video><b>odd</b></video>"
        return html_text._simple(html_text.tokens(f"<body>{''.join(body)}</body>"))

    nodes = html_text.infer([page(60) for _ in range(8)])
    code, _ = html_text._program(nodes, fixed=True)
    for odd in (False, True):
        one = page(60, odd)
        start = time.time()
        html_text._run(code, one)
        assert time.time() - start < 0.1


def groups(depth):
    leaf = st.sampled_from([("<", "p"), (">", "p"), ("<", "b"), ("t", None)])
    if not depth:
        return st.lists(leaf, max_size=3)
    node = st.one_of(leaf, st.tuples(st.sampled_from("?+"), groups(depth - 1)))
    return st.lists(node, max_size=4)


@given(groups(2), st.lists(st.sampled_from([("<", "p"), (">", "p"), ("<", "b"), ("t", "x")]), max_size=6))
@settings(max_examples=300, deadline=None)
def test_matching_equals_the_regular_expression(nodes, page):
    found = html_text._run(html_text._program(nodes)[0], page)
    assert (found is not None) == bool(re.fullmatch(html_text._expression(nodes), html_text._encoded(page)))


def test_hosts_with_blanks(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "*.shop/a*z")]
    urls = ["http://exa mple.net/x", "http://a .example.net/en/1", "http://net /x", "http:// net/x", "http://x.net",
            "http://my own.shop/a-z", "http://a b/c net/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.host, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).orderBy("page_id").collect()]
    assert got == [("exa mple.net", "net/", "block"), ("a .example.net", "example.net/en/", "allow"), ("net ", None, "allow"),
                   (" net", None, "allow"), ("x.net", None, "allow"), ("my own.shop", "*.shop/a*z", "block"), ("a b", None, "allow")]


def test_vectors_of_doubles_keep_their_precision(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 12)) / 3
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(200)], "vec_id long, embedding array<double>")
    for row in ann.nearest(df, k=5).collect():
        assert row.score == pytest.approx(float(x[row.query_id] @ x[row.vec_id]), rel=1e-14)


def test_lengths_are_searched_apart(spark):
    r = np.random.default_rng(3)
    vectors = [(i, [float(v) for v in r.normal(size=4 if i < 60 else 7)]) for i in range(140)]
    got = ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), k=3).collect()
    assert {q.query_id for q in got} == {0, 20, 40, 60, 80, 100, 120}
    assert all((q.query_id < 60) == (q.vec_id < 60) for q in got) and len(got) == 21
