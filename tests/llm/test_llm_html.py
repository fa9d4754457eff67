import re
from html import unescape

from tablekit.llm.html import extract, main_text, smoothed, threshold
from tablekit.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a>News</a></ul></nav><!-- note -->
<div class="cookie-notice">We use cookies on this site, a long text about cookies and privacy for everyone</div>
<div id=content><h1>Title &amp; more</h1><p>Short.</p><p>A long paragraph of   text with <a href=x>a link</a> in
 it and so on &copy; and on.<br>Next</p><div class="ad">Buy this now, it is a really good product at a price</div>
<ul><li>one item</li><li>two</li></ul><div class="comments"><p>Nice article, I liked it so very much</p></div>
<form>Subscribe <input></form></div><div class=sidebar>things to read that are long enough to count as text</div><footer>foot</footer>"""


def test_article_only():
    assert main_text(PAGE) == "Title & more\nShort.\nA long paragraph of text with a link in it and so on © and on. Next\none item\ntwo"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<nav>menu</nav>") == ""
    assert main_text("plain &lt;text&gt;") == "plain <text>"
    assert main_text("<p>a<p>b<b>c</b>d") == "a\nbcd"
    assert main_text("<article><p>cut off <b>here") == "cut off here"
    assert len(main_text("<p>" + "word " * 200_000 + "</p>")) == 5 * 200_000 - 1


LONG = "A long paragraph of plain words that goes on and on about one thing. " * 20


def test_the_whole_article_stays():
    long, links = LONG.strip(), "".join(f"<li><a href=x>Source {i}</a>" for i in range(4))
    sources = "\nSource 0\nSource 1\nSource 2\nSource 3"
    nav = "<nav><a>Home</a></nav><div><a>One</a></div><div><a>Two</a></div><div><a>Three</a></div>"
    page = lambda body: main_text(f"<html><head><title>t</title></head><body>{nav}{body}<footer>foot</footer>")
    assert page(f"<article><h1>Title</h1><section><p>{LONG}</section><section><p>short end</section></article>") == f"Title\n{long}\nshort end"
    assert page(f"<article><h1>Title</h1><p>{LONG}<ul>{links}</ul></article>") == f"Title\n{long}{sources}"
    assert page(f"<div><article><p>{LONG}{LONG}</article></div><h2>Between</h2><div><article><p>{LONG}</article></div>") == f"{long} {long}\nBetween\n{long}"
    assert page(f"<main><h1>Title</h1><article><p>{LONG}</article><p>End.</main>") == f"Title\n{long}\nEnd."
    for tag in ("div", "blockquote", "table><tr><td"):
        assert page(f"<div><h1>Title</h1><p>A lead.</p><{tag}>{LONG}<p>{LONG}</{tag.split('>')[0]}><p>The end.</div>") == f"Title\nA lead.\n{long}\n{long}\nThe end."
    assert page(f"<div><p>{LONG}<ul>{links}</ul><p>{LONG}</div>") == f"{long}{sources}\n{long}"


def test_head_without_its_end_tag():
    for body in ("<body><p>", "<p>", "<article><p>", ""):
        assert main_text(f"<html><head><meta charset=x><title>t</title><style>p{{}}</style>{body}Some text of the page") == "Some text of the page"


def test_names_of_the_frame_do_not_lose_the_article():
    long, nav = LONG.strip(), "<nav><a>Home</a></nav><div class=sidebar>Things to read, long enough to count</div>"
    page = lambda body: main_text(f"<html><body>{nav}{body}<footer>foot</footer>")
    for name in ("post no-sidebar", "site has-related alert-free", "widget", "page-with-sidebar"):
        assert page(f'<div class="{name}"><h1>Title</h1><p>{LONG}<p>End.</div>') == f"Title\n{long}\nEnd.", name
    assert page(f"<div class=sidebar-right><article><p>Short.</article><div class=ad>{LONG}</div></div>") == "Short."
    assert page(f"<div class=widget><p>{LONG}<div class=comments><p>{LONG}{LONG}{LONG}</div></div>") == long


def test_implied_end_tags():
    long = LONG.strip()
    assert main_text(f"<body><p class=notice>We use cookies<div><p>{LONG}</div>") == long
    assert main_text(f"<table><tr><td class=sidebar>menu<td><article>{LONG}</article><tr><td class=ad>buy</table>") == long
    assert main_text(f"<table><tr><td class=sidebar>menu<td><p>{LONG}</table>") == long
    assert main_text(f"<dl><dt class=ad>buy<dd><p>{LONG}<dt>Term<dd>Meaning</dl>") == f"{long}\nTerm\nMeaning"
    assert main_text(f"<ul><li class=ad>buy<li><p>{LONG}<ul><li>in</ul></ul>") == f"{long}\nin"


def test_clusters():
    assert threshold([0, 0, 1, 10, 11]) > 1 and threshold([3, 3]) == 3
    assert max(smoothed([0, 0, 9, 0, 0])) < 9


def test_query_against_article_elements(spark, sf_small):
    got = {r.page_id: r for r in QUERIES["op8_html"](spark, sf_small).collect()}
    rows = spark.read.parquet(f"{sf_small}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x.replace("<b>", ""))).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
        want = "\n".join(x for x in blocks if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>a</p>", None)], "page_id int, html string, text string")
    assert [tuple(r) for r in extract(df, out="text").orderBy("text").collect()] == [(1, ""), (1, "a")]
    assert extract(df.limit(0)).count() == 0
