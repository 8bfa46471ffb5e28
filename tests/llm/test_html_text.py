import html
import math
import re

import pytest

from bazarlens.llm.html_text import extract_main_text, main_text, parse, prune, weigh
from tests.llm.support import clashing

PAGE = """<html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body class="nav-open">
<div id="cookie-banner">We use cookies, accept all of them please, thank you very much indeed.</div>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="page with-sidebar"><div class="post"><h2>Title &amp; more</h2><div class="text">
<p>First   long&nbsp;paragraph with a <a href=x>link</a> and text that goes on for long enough.</p>
<p>Second paragraph &lt;also&gt; with text<br>that goes on for a while.</p><ul><li>point one of the text</li><li>point two</li></ul></div></div>
<div class="sidebar"><a>one</a><a>two</a></div><div class="ad">Buy now</div></div>
<section id="comments"><article class="comment"><p>Reader says something that is very long, longer than all else on this page, and more and more.</p></article></section>
<form><p>Subscribe</p><input></form><footer>&copy; x</footer></body></html>"""


def test_article_without_furniture():
    assert main_text(PAGE).split("\n") == [
        "Title & more",
        "First long paragraph with a link and text that goes on for long enough.",
        "Second paragraph <also> with text that goes on for a while.",
        "point one of the text",
        "point two",
    ]


def test_density_decides_where_names_do_not():
    menu = "".join(f"<div><a href=/{i}>Entry {i}</a></div>" for i in range(30))
    text = "".join(f"<div>Sentence {i} of a text that is long enough to be read as text, with a few commas, and so on.</div>" for i in range(8))
    got = main_text(f"<body><div>{menu}</div><div><div>{text}</div></div><div><a href=/x>Imprint</a></div></body>")
    assert got.split("\n") == re.findall(r"<div>(Sentence.*?)</div>", text)


LONG = "Sentence of a paragraph that is long enough to count as text, and goes on for a while. " * 3


def paragraphs(n, first=0):
    return "".join(f"<p>{LONG}{i}</p>" for i in range(first, first + n))


def texts(n, first=0):
    return [f"{LONG}{i}" for i in range(first, first + n)]


def test_names_lower_the_weight_and_do_not_decide():
    """A page that stands in elements of such names, or in a form, keeps its text; small parts of such names go."""
    menu = "<nav><a href=/>Home</a></nav>"
    widgets = "".join(f'<div class="elementor-widget"><p>{t}</p></div>' for t in texts(5))
    assert main_text(f"<body>{menu}{widgets}<footer>f</footer></body>").split("\n") == texts(5)
    assert main_text(f'<body>{menu}<div class="social-post">{paragraphs(6)}</div></body>').split("\n") == texts(6)
    assert main_text(f"<body><form action=/>{menu}{paragraphs(6)}<input><button>Send</button></form></body>").split("\n") == texts(6)
    beside = '<div class="widget"><p>Related things to read, more of them, and still more of them.</p></div><form><p>Subscribe to our letter now.</p><input></form>'
    assert main_text(f"<body>{menu}<div>{paragraphs(6)}{beside}</div>{beside}</body>").split("\n") == texts(6)


def test_sibling_articles():
    """Articles of comparable size are all main text; small ones beside a large one are not."""
    both = f"<body><div class=sidebar><p>{LONG}</p></div><article>{paragraphs(10)}</article><article>{paragraphs(8, 10)}</article></body>"
    assert main_text(both).split("\n") == texts(18)
    cards = "".join(f"<article><a href=/{i}>Read {i}</a><p>A summary of it.</p></article>" for i in range(6))
    assert main_text(f"<body><article>{paragraphs(10)}</article>{cards}</body>").split("\n") == texts(10)


def test_density_formula_against_a_plain_computation():
    """Counted from the page's text by hand: characters, tags, link characters, link tags."""
    page = '<body><div><p>abcdefghij<b>klm</b></p><a href=x>link<i>s</i></a></div><ul><li><a href=y>yy</a></li></ul><p class="widget">wwww</p></body>'
    root = parse(page)
    prune(root)
    weigh(root)
    numbers = {"#root": (24, 10, 7, 2), "body": (24, 9, 7, 2), "div": (18, 4, 5, 1), "b": (3, 0, 0, 0), "ul": (2, 2, 2, 1), "li": (2, 1, 2, 1)}
    for x in root.elements():
        if x.tag not in numbers:
            continue
        c, t, lc, lt = numbers[x.tag]
        assert (x.chars, x.tags, x.link_chars, x.link_tags) == (c, t, lc, lt)
        base = math.log(c / max(c - lc, 1) * lc + 7 / 24 * c + math.e)
        assert x.density == pytest.approx(c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / base)
        assert x.total == pytest.approx(sum(y.density for y in x.children if not isinstance(y, str)) or x.density)
    named = next(x for x in root.elements() if x.attrs.get("class") == "widget")
    # Four characters, no tag, no link: 4 / 1 * log(4) / log(7 / 24 * 4 + e), by the weight of a name.
    assert named.density == pytest.approx(0.1 * 4 * math.log(4) / math.log(7 / 24 * 4 + math.e))


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text(" \n") == main_text("<nav>a</nav>") == main_text("<p> </p>") == ""
    assert main_text("plain text &amp; more") == "plain text & more"
    assert main_text("<p>a<p>b") == "a\nb"
    assert main_text("<article><header><h1>T</h1></header><p>x  y</p></article><div>menu</div>") == "T\nx y"
    assert main_text("<div>" * 5000 + "deep text") == "deep text"
    assert main_text("1 < 2 and <b>3</b>") == "1 < 2 and 3"
    assert len(main_text("<article><p>" + "word " * 100_000 + "</p></article>")) == 499_999


def test_test_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert found[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"]) and found[r["page_id"]]["url"] == r["url"]


def test_null_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "<p>x</p>")], "page_id long, url string, html string")
    rows = extract_main_text(clashing(frame)).collect()
    assert sorted((r["text"], r["n_chars"]) for r in rows) == [("", 0), ("", 0), ("x", 1)]
    assert extract_main_text(frame.limit(0)).count() == 0
