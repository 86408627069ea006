import html
import itertools
import re
import time

import pytest

from tessella.llm import extract
from tessella.session import table

SF = "/root/testdata/sf0.01"


def plain(page):
    """The marked article of the generated pages, by another road."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"</?(?:p|h1|br)>", " ", body)
    return " ".join(html.unescape(re.sub(r"</?b>", "", body)).split())


@pytest.fixture(scope="module")
def weights(spark):
    return extract.fit(table(spark, SF, "pages"))


def test_best_region_is_that_of_brute_force():
    for scores in itertools.product((-2, -0.5, 1), repeat=6):
        sums = {(a, b): sum(scores[a:b]) for a in range(6) for b in range(a + 1, 7)}
        a, b = extract.best_region(list(scores))
        assert sum(scores[a:b]) == max(0, *sums.values())
    assert extract.best_region([]) == (0, 0)


def test_every_generated_page(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    for r in extract.extracted(table(spark, SF, "pages")).collect():
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


def test_what_labelled_pages_do_not_show(weights):
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1><p>Slogan of the site here</p></header>
    <div class="cookie-notice">We use cookies, do you agree to all of them?</div>
    <div class="content"><article class="post"><header><h1>A&nbsp;title</h1></header><p>First <i>para</i>graph &amp; more&#33; x<sup>2</sup></p>
    <aside>Not this at all</aside><ul><li>one</li><li>two</li></ul><script>var x = "<p>no</p>";</script>
    <form><input> Send it</form><table><tr><td>a</td><td>b</td></tr></table><!-- <p>hidden</p> --><p>Last one.</p></article></div>
    <section id="comments"><h2>Comments</h2><p>I read this and I liked it very much, thanks to all of you.</p><p>Me too, many words more here</p></section>
    <div class="sidebar"><p>Other things to read today and tomorrow</p></div><footer>Foot of the page</footer></body></html>"""
    assert extract.main_text(page, weights) == "A title First paragraph & more! x2 one two a b Last one."


@pytest.mark.parametrize("page", [None, "", "   ", "<p>", "</p></b>", "<!-- open", "<script>x", "<a href='x", "<" * 5000, "<div>" * 20_000, "<a b='" * 3000, "&", "<nav>only menu</nav><footer>foot</footer>"])
def test_odd_pages_do_not_crash(weights, page):
    assert isinstance(extract.main_text(page, weights), str)


def test_names_never_cut_blocks_of_marked_content(weights):
    page = '<body><div class="ad">Buy this now</div><article><p class="notice-board">One two three.</p><p id="social">Four five six.</p><div class="search-tips"><p>Seven eight.</p></div></article></body>'
    assert extract.main_text(page, weights) == "One two three. Four five six. Seven eight."


def test_pages_that_mark_no_content(spark, weights):
    """The weights decide: the generated pages with their article elements renamed."""
    pages = [r.html for r in table(spark, SF, "pages").collect()]
    bare = {name: sum(extract.main_text(h.replace("<article>", f"<div class='{name}'>").replace("</article>", "</div>"), weights) == plain(h) for h in pages) for name in ("navigator-story", "search-results-story", "x1")}
    assert min(bare.values()) >= 0.9 * len(pages), bare
    doubted = pages[0].replace("<article>", "<div class='notice'>").replace("</article>", "</div>")
    assert len(extract.main_text(doubted, weights)) > 0


def test_names_are_learned_from_labelled_pages(spark):
    page = lambda i: f'<body><div class="zork">boiler {i} plate words</div><article><div class="popup gloss">inner text {i} of it</div><p>Some words here {i}.</p></article></body>'
    df = spark.createDataFrame([(i, "u", page(i)) for i in range(30)], "page_id long, url string, html string")
    w = extract.fit(df)
    assert w.names == {"zork": False, "popup": True, "gloss": True}
    assert extract.main_text('<div class="zork">No no no</div><div class="popup">Yes yes yes</div><p>And more of it</p>', w) == "Yes yes yes And more of it"


@pytest.mark.parametrize("piece", ['<a href="', "<a href='x\">", "<button>", "<svg>", "<!", "<!--", "<", "</", "<a b='", '<a b="\'>', "<?", "<div>", "</p>", '<p class="', "<script>", "<b"])
@pytest.mark.parametrize("end", ["", ">", '">'])
def test_odd_markup_takes_linear_time(weights, piece, end):
    began = time.process_time()
    extract.main_text(piece * 200_000 + end, weights)
    assert time.process_time() - began < 20


WORDS = " ".join(f"word{i} of the text" for i in range(15))


@pytest.mark.parametrize("attributes", ['style="overflow: hidden"', 'style="overflow:hidden"', 'data-hidden="false"', 'title="the hidden room"', 'data-role="search"', "data-x='id=menu'", 'title="a class=ad b"', 'x="1"y="hidden"', "hidden-by=script", 'data-class="sidebar" aria-hidden="false"', "class = 'a' class='menu'"])
def test_attributes_are_read_one_by_one(weights, attributes):
    for page in (f"<div {attributes}><h2>A heading</h2><p>{WORDS}</p></div>", f"<article><p>First.</p><div {attributes}><h2>A heading</h2><p>{WORDS}</p></div></article>"):
        assert extract.main_text(page, weights).endswith(f"A heading {WORDS}")


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN", 'a="b"hidden', "aria-hidden=true", "role='search'", 'ROLE = "navigation"', 'data-x="' + "y" * 5000 + '" class="sidebar menu"', "x=1 / id=menu"])
def test_attributes_that_hide(weights, attributes):
    page = f"<body><div {attributes}><p>Not this at all, it is no text</p></div><article><p>{WORDS}</p></article></body>"
    bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
    assert extract.main_text(page, weights) == extract.main_text(bare, weights) == WORDS


def test_attribute_reader():
    read = extract._read_attributes
    assert read("div", """ id=A class="b  c" data-class=x ID=z""") == (False, ["b", "c", "a"])
    assert read("div", """ class='q&amp;a' /id=x/hidden""") == (False, ["q&a", "x/hidden"])
    assert read("div", " =x hidden") == (True, [])
    assert read("article", " hidden role=search class=x") == (False, ["x"])


def test_text_of_inline_objects_in_an_article_stays(weights):
    page = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds. Press <button>Go now</button> here. <object>No picture</object> <select><option>one</option><option>two</option></select></p></article>"
    assert extract.main_text(page, weights) == "So x=1 holds. Press Go now here. No picture one two"


def test_names_count_all_words_below_them(spark):
    inner = "<div>" * 30
    page = lambda i: f'<body><div class="zork">{inner}boiler {i} plate words{"</div>" * 31}<article><div class="glos">{inner}<p>inner text {i} of it</p>{"</div>" * 31}</article></body>'
    df = spark.createDataFrame([(i, "u", page(i).replace("<div>", '<div class="a b c">')) for i in range(30)] + [(99, "u", page(1))] * 2, "page_id long, url string, html string")
    w = extract.fit(df)
    assert w.names["zork"] is False and w.names["glos"] is True


def test_repeated_rows_stay(spark, weights):
    df = spark.createDataFrame([(1, "u", "<article><p>Hi there you</p></article>")] * 3, "page_id long, url string, html string")
    assert [r.text for r in extract.extracted(df).collect()] == ["Hi there you"] * 3


def test_nothing_but_boilerplate_gives_nothing(weights):
    assert extract.main_text("<nav><a>Home</a></nav><article></article><footer>All rights reserved by us</footer>", weights) == ""


def test_very_long_and_plain(weights):
    assert extract.main_text("word " * 100_000, weights) == " ".join(["word"] * 100_000)
    long = "<article>" + "<p>some words here</p>" * 20_000 + "</article>"
    assert len(extract.main_text(long, weights).split()) == 60_000


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Hi there you</p></article>", "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in extract.extracted(df).collect()} == {1: ("u", "Hi there you", 12), 2: (None, "", 0)}
    assert extract.extracted(df.where("page_id > 5")).count() == 0
