"""The operators on pages and embeddings: against brute force on whole small tables, and their edge cases."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_MID, SF_SMALL
from shiftlab.llm import ann, html_text, url_filter
from shiftlab.llm.common import table
from shiftlab.llm.queries import URL_RULES


# --- 4: HTML ---------------------------------------------------------------------

def article(page):
    """The article of the test pages, found by plain string operations."""
    import html
    body = page[page.index("<article>") + 9:page.index("</article>")]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", p))).strip()
             for p in re.split(r"</?(?:p|h1)>|<br>", body)]
    return "\n".join(p for p in parts if p)


def test_main_text_of_all_pages(spark):
    pages = table(spark, SF_MID, "pages")
    got = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == article(r["html"]) and got[r["page_id"]]["url"] == r["url"]
        assert got[r["page_id"]]["n_chars"] == len(article(r["html"]))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>
<header><a href="/">Home</a></header><nav><ul>{menu}</ul></nav><div class="cookie-notice">We use cookies</div>
<div class=content><h1>{title}</h1>{paragraphs}<div class="share-buttons">Share this</div></div>
<aside>Popular</aside><section id="comments"><p>first!</p></section><form>Name</form>
<script>if (a<b) {{ "</p>" }}</script><footer>&copy; site</footer></body></html>"""


def page(k, n):
    return PAGE.format(menu="".join(f"<li>m{i}</li>" for i in range(k + 1)), title=f"Title &amp; {k}",
                       paragraphs="".join(f"<p>para {k}  {i} <b>bold</b>{'&nbsp;&lt;x&gt;' if i % 2 else ''}</p>" for i in range(n)))


def expected(k, n):
    return "\n".join([f"Title & {k}", *(f"para {k} {i} bold{' <x>' if i % 2 else ''}" for i in range(n))])


def test_pages_of_another_template_and_edge_cases(spark):
    rows = [(k, f"https://Other.example/{k}", page(k, 1 + k % 4)) for k in range(12)]
    odd = [(20, None, None), (21, "", ""), (22, "x://h/a", "just text &amp; more"), (23, "x://h/b", "<p>open <p>two</p></div></p>"),
           (24, "x://h/c", "<div>" * 3000 + "deep" + "</div>" * 3000), (None, "x://h/d", "<article><p>a</p></article>"),
           (None, "x://h/d", "<article><p>a</p></article>"), (25, "x://long/e", "<main>" + "<p>word word</p>" * 30_000 + "</main>")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows + odd],
                                 "page_id long, url string, html string, host int, wrapper string")
    out = html_text.main_text(docs).collect()
    got = {r["page_id"]: r["text"] for r in out}
    for k in range(12):
        assert got[k] == expected(k, 1 + k % 4)
    assert (got[20], got[21], got[22], got[23], got[24], got[None]) == ("", "", "just text & more", "open\ntwo", "deep", "a")
    assert got[25].count("\n") == 29_999 and len(out) == len(rows) + len(odd)
    assert html_text.main_text(docs.limit(0)).count() == 0


def test_content_elements_within_boilerplate_do_not_end_the_content():
    teaser, comment = "<article><p>teaser</p></article>", '<article class="comment"><p>first!</p></article>'
    for before in (f"<aside>{teaser}</aside>", f"<nav>{teaser}{teaser}</nav>", f"<header>{teaser}</header>"):
        assert html_text.page_text(f"<body>{before}<p>site</p><article><p>real</p></article><p>end</p></body>", None) == "real"
    inside = f"<body><article><p>one</p>{comment}{comment}<p>two</p></article><p>end</p></body>"
    after = f"<body><article><p>one</p></article>{comment}{comment}<p>end</p></body>"
    assert html_text.page_text(inside, None) == "one\ntwo" and html_text.page_text(after, None) == "one"


def test_only_whole_names_mark_boilerplate():
    real = ['<div style="overflow:hidden">{}</div>', '<div aria-hidden="false">{}</div>', '<p><a href="/hidden-valley">{}</a></p>',
            '<p data-id="menu" title="class=menu">{}</p>', '<div class="no-sidebar comments-open">{}</div>',
            '<main class="no-sidebar">{}</main>', '<article class="post comments-open comment-12">{}</article>',
            '<main id="menu">{}</main>', '<div class="load-more related_left">{}</div>']
    for p in real:
        assert html_text.page_text(f'<html class="modal"><body class="has-sidebar">{p.format("text")}</body></html>', None) == "text"
    gone = ["<div hidden>{}</div>", "<div class='x hidden' hidden=''>{}</div>", "<div class='a Sidebar'>{}</div>", "<div id=comment-12>{}</div>",
            "<ul role=navigation>{}</ul>", '<div class="cookie_bar">{}</div>', '<article class="comment">{}</article>']
    for p in gone:
        assert html_text.page_text(f"<body><p>kept</p>{p.format('text')}</body>", None) == "kept"


def test_hosts_without_article_or_main_keep_all_their_text(spark):
    made = [f"<body><div><h1>Title {k}</h1><p>{'long text ' * 40}{k}</p></div></body>" for k in range(9)]
    made += [f"<body><div><h1>Title 9</h1><p>{'long text ' * 40}9</p></div><div><h2>More</h2></div></body>"]
    docs = spark.createDataFrame([(k, f"http://h/{k}", p) for k, p in enumerate(made)], "page_id long, url string, html string")
    for r in html_text.main_text(docs).collect():
        k = r["page_id"]
        assert r["text"] == f"Title {k}\n{'long text ' * 40}{k}" + "\nMore" * (k == 9)


def wrapper_of(pages):
    return html_text.wrapper_expression([html_text._simple(html_text.tokens(p)) for p in pages])


def test_texts_that_all_pages_of_a_host_have_are_template():
    for tag in ("div", "article"):
        made = [(f"<body><div class=top>All <b>news</b> of the day</div><{tag}><p class=x>Read this first</p><h1>Title {k}</h1>"
                 + f"<p>long text {k} {'word ' * 20}</p>" * (k + 1) + ("<ul><li>extra</li></ul>" if k % 2 else "")
                 + f"</{tag}><p>All rights kept</p></body>") for k in range(6)]
        w = wrapper_of(made)
        for k, p in enumerate(made):
            want = [f"Title {k}", *[f"long text {k} {'word ' * 20}".strip()] * (k + 1), *["extra"] * (k % 2)]
            assert html_text.page_text(p, w) == "\n".join(want)
        other = made[0].replace("Read this first", "Read that first")
        assert html_text.page_text(other, w).startswith("Read that first\nTitle 0\n")
    few, copies = made[:3], [made[0].replace("</article>", f"</article><i>{k}</i>") for k in range(6)]
    assert all("Read this first" in html_text.page_text(p, wrapper_of(few)) for p in few)
    assert all(html_text.page_text(p, wrapper_of(copies)) == html_text.page_text(p, None) for p in copies)


def test_wrapper_has_slots_repeats_and_options():
    pages = [html_text._simple(html_text.tokens(f"<html><body><h1>{t}</h1>{b}<ul>{'<li>x</li>' * n}</ul><p>end</p></body></html>"))
             for t, b, n in (("a", "", 2), ("b", "<div>extra</div>", 4), ("c", "", 1))]
    w = html_text.infer(pages)
    assert ("t", "end") in w and ("t", None) in w
    assert any(n[0] == "+" and n[1][0] == ("<", "li") for n in w) and any(n[0] == "?" for n in w)
    for p in pages:
        assert re.fullmatch(html_text._expression(w), html_text._encoded(p))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/!-pdivbrscrt a=\"'&;x\n", max_size=80))
def test_any_markup_is_read(text):
    toks = html_text.tokens(text)
    assert sum(k == "<" for k, _, _ in toks) == sum(k == ">" for k, _, _ in toks)
    html_text.blocks(toks)
    html_text.wrapper_expression([html_text._simple(toks)] * 2)


# --- 5: URLs -----------------------------------------------------------------------

def brute_url(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = []
    for verdict, pattern in rules:
        h, s, p = pattern.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p):
            fit.append((-len(pattern), verdict != "block", pattern, verdict))
    best = min(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [None, "", "nothing", "http://EXAMPLE.net/en/x?y=/de/", "http://a.example.net/EN/", "http://example.com/de/1#x",
        "http://xexample.com/de/", "ftp://b.example.com/de", "http://site.org/fr/", "http://org/fr/", "://net/", "http://net",
        "http://net/", "http://a.net?x", "http://É.net/", "http://user@a.net:80/x", "a://b://c.net/", "http://x.net/a b"]


def test_urls_match_brute_force(spark):
    docs = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[3], "h", 1)],
                                 "page_id long, url string, host string, token int")
    got = url_filter.judge_urls(docs, URL_RULES)
    key = lambda r: str(r)
    want = [(r["page_id"], *brute_url(r["url"], URL_RULES)) for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert url_filter.judge_urls(docs.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(docs, [], default="block").collect()} == {"block"}


def test_rules_are_filed_under_their_rarest_token():
    rules = [("block", "example.net/en/"), ("allow", "net/e"), ("block", "*/x*y/"), ("allow", "*.shop/")]
    by_token, always = url_filter._index(rules, {"example": 9, "net": 20, "en": 3})
    assert {t: [r[0] for r in v] for t, v in by_token.items()} == {"en": ["example.net/en/"], "net": ["net/e"], "shop": ["*.shop/"]}
    assert [r[0] for r in always] == ["*/x*y/"]
    assert url_filter.literal_tokens("net/en") == {"net"}
    assert re.match(url_filter.expression("*.shop/a*z"), "my.shop /abcz9") and not re.match(url_filter.expression("net/"), "xnet /")


# --- 10: nearest neighbours ------------------------------------------------------------

def brute_nearest(rows, k=20, every=20):
    out = {}
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        o = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in o]
    return out


def recall(got, want):
    return sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_the_embeddings(spark):
    v = table(spark, SF_SMALL, "embeddings")
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in v.collect()])
    got = found(ann.nearest(v))
    assert recall(got, want) >= 0.9 and all(len(g) == 20 for g in got.values()) and got.keys() == want.keys()


def test_recall_on_clusters_of_different_lengths_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    r = np.random.default_rng(4)
    centres = r.normal(size=(25, 16))
    x = (centres[r.integers(0, 25, 2500)] + 0.2 * r.normal(size=(2500, 16))) * r.uniform(0.5, 2, (2500, 1))
    x[500:1300] = x[500]                                       # one very common vector
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    want = brute_nearest(rows)
    by_score = lambda q: sorted((s for _, s in q), reverse=True)
    hits = sum(np.sum(np.array(by_score(got[q])) >= w[-1][1] - 1e-9) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = dict(rows)
    assert all(s == pytest.approx(float(np.dot(exact[q], exact[v])), abs=1e-9) for q, g in got.items() for v, s in g[:3])


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [0.5, 0.5]), (4, [0.5, 0.5]), (4, [0.5, 0.5]), (5, None), (6, [0.0, 0.0]),
            (40, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0]), (None, [1.0, 1.0]), (11, [-1.0, 0.0])]
    v = spark.createDataFrame([(*r, 1, "b") for r in rows], "vec_id long, embedding array<float>, bucket int, v string")
    got = found(ann.nearest(v))
    assert got == {0: [(3, 0.5), (4, 0.5), (20, 0.0), (11, -1.0)], 20: [(3, 0.5), (4, 0.5), (0, 0.0), (11, 0.0)]}
    assert ann.nearest(v.limit(0)).count() == 0 and ann.nearest(v.where("vec_id = 11")).count() == 0
