import re
import time
from html import unescape

from _brute import clashing

from spanlake.llm import html_text

SF = "/root/testdata/sf0.01"


def _article(html):
    body = re.search(r"<article>(.*)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h\d|ul|li|div|blockquote)\b[^>]*>", body)
    parts = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|i|a)\b[^>]*>", "", x))).split()) for x in parts]
    return "\n\n".join(x for x in parts if x)


def test_pages_give_their_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = html_text.op5_host_paths(spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == _article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def _page(body):
    return f"<html><head><title>T</title><script>var a = '</p><div>no';</script></head><body>{body}</body></html>"


def test_consensus_and_noise(spark):
    story = lambda k: "<p>" + f"Sentence {k} of the story goes on and on. " * 6 + "</p>"
    layout = '<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="post-{0} entry">{1}<form>Sign up</form></div><div id="comments"><p>{2}</p></div><aside>Side</aside><div class="cookie notice">We use cookies</div><footer>F</footer>'
    pages = [(i, "http://A.example.org/x", _page(layout.format(i, story(i), "I say. " * 4))) for i in range(8)]
    pages.append((50, "http://a.example.org/y", _page(layout.format(9, "<p>Short &amp; sweet.<p>Two", "I disagree at length. " * 60))))
    pages += [(60, None, None), (61, "nonsense", ""), (62, None, "plain text only"), (63, "http://b.org/", "<div><p>Unclosed <b>bold &lt;x&gt;<p>next"), (63, "http://b.org/", "<div><p>Unclosed <b>bold &lt;x&gt;<p>next")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as host")
    out = html_text.extract(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(pages)
    assert all(got[i] == (f"Sentence {i} of the story goes on and on. " * 6).strip() for i in range(8))
    assert got[50] == "Short & sweet.\n\nTwo"
    assert got[60] == got[61] == "" and got[63] == "Unclosed bold <x>\n\nnext"
    assert html_text.extract(df.limit(0)).count() == 0


def test_whole_articles(spark):
    run = lambda name, n: f"{name} says a lot. " * (n // 20)
    sections = lambda k: f"<article><h1>Title {k}</h1><p>{run('lead', 300)}</p>" + "".join(f"<section><p>{run(f'part{j}', 700)}</p></section>" for j in range(3)) + "</article>"
    halves = lambda k: f"<h1>Title {k}</h1><div class=intro><p>{run('intro', 900)}</p></div><div class=rest><p>{run('rest', 700)}</p></div>"
    many = lambda k: f"<div class=post><p>{run('lead', 300)}</p>" + "".join(f"<div class=part><p>{run(f'part{j}', 700)}</p></div>" for j in range(9)) + "</div>"
    bare = lambda k: f"<h1>Title {k}</h1><p>{run('first', 300)}</p><div><p>{run('boxed', 200)}</p></div><p>{run('last', 400)}</p>"
    layouts = [(sections, "sections"), (lambda k: f"<article>{halves(k)}</article>", "article"), (lambda k: f"<div class=page>{halves(k)}</div>", "divs"), (many, "many")]
    pages, want = [], {}
    for n, (layout, name) in enumerate([*layouts, (bare, "bare")]):
        for k in range(4):
            html = layout(k)
            want[100 * n + k] = "\n\n".join(x for x in (" ".join(x.split()) for x in re.split("<[^>]*>", html)) if x)
            pages.append((100 * n + k, f"http://{name}.org/{k}", html if name == "bare" else _page(f"<nav><a href=/>Home</a></nav>{html}<footer>F</footer>")))
    out = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == want


def _text(html):
    return html_text.Page(html).text([])


def test_broken_markup_leaves_no_markup():
    assert _text('<p title="x>Hello</p>') == "Hello"
    assert _text("<p title='x>Hello</p><p class=a\"b id=>two") == "Hello\n\ntwo"
    assert _text('<p title="a > b" data-x=\'<i>\'>three</p>') == "three"
    assert _text('<i "<b \'><p>four') == "four" and _text("five <") == "five <" and _text("1 < 2 &lt; 3") == "1 < 2 < 3"
    assert _text("<p title='a hidden b'>six</p><p hidden>seven</p>") == "six"
    assert _text("<td>a<td>b<table><tr><td>c<p>d<tr><td>e</table>f") == "a\n\nb\n\nc\n\nd\n\ne\n\nf"
    assert _text("<ul><li>a<li>b<ul><li>c</ul>d</ul></i>e") == "a\n\nb\n\nc\n\nd\n\ne"


def test_time_follows_the_length():
    for html in ("<div>x" * 20_000, "<b>" * 20_000 + "x</i>" * 20_000, '<a "' * 20_000, '<a x="' * 8_001, "<div class=c><p>y</b>" * 10_000, "<li>x" * 20_000, "<!--" * 20_000, "<script>" * 20_000, "<div><b>x</p></em>" * 8_000):
        began = time.process_time()
        page = html_text.Page(html)
        page.text([])
        assert time.process_time() - began < 4, html[:20]


def test_doubtful_classes_inside_articles():
    prose = "The social history of the town goes on for long. " * 8
    inner = f'<article><div class="entry-header"><h1>Title</h1></div><p>{prose}</p><section class="social history"><p>{prose}</p></section><div class="social">Share this</div><div class="related"><a href=/1>{prose}</a></div><div class="ad">Buy</div><section class="comments"><p>{prose}</p></section><form>Send</form></article>'
    assert _text(_page(f'<div class="notice">We have moved.</div>{inner}<div id="side">Left</div>')) == f"Title\n\n{prose.strip()}\n\n{prose.strip()}"


def test_winners_are_few_and_clashing_columns(spark):
    cast = [("a", k, 2) for k in range(500)] + [("b", 1, 50), ("b", 2, 30), ("b", 3, 1), ("c", 7, 1), ("c", 8, 1), (None, 5, 4)]
    said = [("b", 20, k, 1) for k in range(5)] + [("b", 21, 1, 9), ("b", 22, 1, 1), ("b", 22, 2, 1), (None, 23, 1, 1), (None, 23, 2, 1)]
    voted = spark.createDataFrame([(h, p, None, n) for h, p, n in cast] + said, "host string, path long, said long, n long")
    won = {r.host: (r.paths, r.varied) for r in html_text.winners(voted).collect()}
    assert won == {"a": ([499], None), "b": ([1, 2], [20, 22]), "c": ([8], None), None: ([5], [23])}
    rows = [(1, "http://a.org", _page("<p>Some text</p>")), (1, "http://a.org", None), (None, None, "")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), ["key", "host", "paths", "of", "text", "doc", "n_chars"])
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(df).collect()) == [("1", "", 0), ("1", "Some text", 9), ("None", "", 0)]


PROSE = "The history of the town goes on for long, and nobody knows its end. " * 15


def _words(pattern):
    """A class word for each of a pattern's alternatives."""
    return [w.replace("\\w*", "x").replace("s?", "s") for w in pattern.pattern.split("(?:")[2].split(")")[0].split("|")]


def test_wrappers_keep_the_article():
    words = [w for pattern in (html_text.REMARKS, html_text.ADVERTS, html_text.DOUBTFUL, html_text.SOFT) for w in _words(pattern)]
    assert len(words) > 30 and "sidebar" in words and "comments" in words
    story, rest = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>", '<nav><a href="/">Home</a></nav>{}<footer>Imprint</footer>'
    want = f"Title\n\n{PROSE.strip()}\n\n{PROSE.strip()}"
    for word in words:
        for name in (word, f"content-{word}-wrap", f"layout with-{word}", f"page no-{word}"):
            assert _text(_page(rest.format(f'<div class="{name}">{story}</div>'))) == want, name
            assert _text(_page(rest.format(f'<div id="{name}"><article>{story}</article></div>'))) == want, name
    assert _text(_page(f'<form id="aspnet">{story}</form>')) == want
    assert _text(_page(f'<div class="main-sidebar"><p>{PROSE}</p></div>')) == PROSE.strip()  # no heading anywhere


def test_long_noise_is_no_main_text_for_want_of_another():
    short = "<p>Short and sweet.</p>"
    for noise in (f"<footer><p>{PROSE}</p></footer>", f'<div class="cookie notice"><p>{PROSE}</p></div>', f'<div id="comments"><p>{PROSE}</p></div>', f'<aside><p>{PROSE}</p></aside>', f'<div class="ad"><p>{PROSE}</p></div>'):
        assert _text(_page(f"<div>{short}</div>{noise}")) == "Short and sweet.", noise[:30]
    assert _text(_page(f'<form id="aspnet">{short}</form>')) == "Short and sweet."


def test_parts_of_articles_are_weighed():
    part = lambda attrs: f"<article><h1>T</h1><p>{PROSE}</p><section {attrs}><p>{PROSE}</p></section></article>"
    both, one = f"T\n\n{PROSE.strip()}\n\n{PROSE.strip()}", f"T\n\n{PROSE.strip()}"
    for attrs in ('id="discussion"', 'class="wp-widget text"', 'class="nav-history"'):
        assert _text(_page(part(attrs))) == both, attrs
    for attrs in ('class="comments"', 'id="respond"', 'class="ad"', 'class="cookie-consent"', "hidden"):
        assert _text(_page(part(attrs))) == one, attrs
    remarks = f'<section id="comments">{f"<article><p>{PROSE}</p></article>" * 9}</section>'
    assert _text(_page(f"<article><h1>T</h1><p>{PROSE}</p></article>{remarks}")) == one
    assert _text(_page(f"<div><h1>T</h1><p>{PROSE}</p></div>{remarks}")) == one


def test_hosts_decide_on_parts_outside_articles(spark):
    body = lambda own, side: _page(f'<div class="post"><h1>T</h1><p>{own}</p><div class="widget"><p>{side}</p></div></div>')
    pages = [(k, "http://same.org/", body(f"{k} {PROSE}", PROSE)) for k in range(6)] + [(10 + k, "http://own.org/", body(f"{k} {PROSE}", f"{k} {PROSE}")) for k in range(6)] + [(20, "http://one.org/", body(PROSE, PROSE))]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[k] == f"T\n\n{k} {PROSE.strip()}" for k in range(6))
    assert all(out[10 + k] == f"T\n\n{k} {PROSE.strip()}\n\n{k} {PROSE.strip()}" for k in range(6))
    assert out[20] == f"T\n\n{PROSE.strip()}"
