"""Pages whose optional or missing end tags must not cost the article."""

from __future__ import annotations

import html
import re
import time

import pytest

from riffle.llm import html_tree


def _text(page):
    return " ".join("".join(x[1] if x else " " for x in html_tree.Dom(page).events).split())


@pytest.mark.parametrize("body", ["<p>one two", "<div><p>one two</p></div>", "one two", "<!-- c --><body><p>one two", "</head><p>one two"])
def test_a_head_ends_where_the_body_begins(body):
    assert _text(f"<html><head><meta charset=x><title>no <p> no</title><script>a('<p>no')</script><style>p {{}}</style>\n{body}") == "one two"


@pytest.mark.parametrize("tag", ["svg", "object", "canvas", "audio", "video", "math"])
def test_an_unclosed_element_keeps_the_rest(tag):
    assert _text(f"<p>one</p><{tag} width=1><p>two</p>") == "one two"
    assert _text(f"<p>one</p><{tag} width=1><p>no</p></{tag}><p>two</p>") == "one two"


@pytest.mark.parametrize("between", ["<!-->", "<!--->", "<!-- x --!>", "<!---->", "<!-- a -- b > c -->", "<?x y>", "</ x>", "</>", "<script>no</script x>", "<script>no</script/>", "<script>no</SCRIPT\n>",
    "<script src='a'/>no</script>", "<script src=/a/>no</script>", "<script/>no</script>", "<style/>no</style>", "<style>no</style a='>'>", "<svg width=1 />", "<math/>", "<svg width=1/>no</svg>", "<svg><svg/>no</svg>", "<canvas/>no</canvas>"])
def test_what_stands_between_costs_no_paragraph(between):
    """Ends as browsers see them: the second paragraph stays and no script is printed."""
    p = html_tree.train(html_tree.labelled_pages())
    first, second = "the first paragraph of the article, long enough", "and the second one, which must not be lost"
    page = f"<body><nav><a href=/>home</a></nav><article><p>{first}</p>{between}<p>{second}</p></article></body>"
    assert html_tree.main_text(page, p) == f"{first}\n{second}"


@pytest.mark.parametrize("head", ["<script/>no</script>", "<title>no</title x>", "<style a=b/>no</style/>"])
def test_raw_text_in_a_head(head):
    assert _text(f"<head>{head}<p>one two") == "one two"


def test_a_page_without_elements_is_its_text():
    p = html_tree.train(html_tree.labelled_pages())
    assert html_tree.main_text("Only  text &amp;\n no tags", p) == "Only text & no tags"
    assert html_tree.main_text("Only <b>inline</b> <i/>tags", p) == "Only inline tags"
    assert html_tree.main_text("", p) == html_tree.main_text("<p></p>", p) == ""


def test_raw_text_runs_to_the_end():
    assert _text("<p>one</p><script>var a = '<p>no</p>'") == "one"


@pytest.mark.parametrize("tag", ["svg", "object", "video"])
def test_nested_hidden_elements_hide_all_they_hold(tag):
    assert _text(f"<p>one</p><{tag}><{tag}>no</{tag}>no</{tag}><p>two</p>") == "one two"
    assert _text(f"<p>one</p><{tag}><p>two</p><{tag}>no</{tag}>") == "one two"


def test_quotes_quote_after_an_equals_sign_only():
    assert _text("<p title=it's>one</p><p title=\"a>b\" lang='c>d'>two</p><p it's>three</p>") == "one two three"


@pytest.mark.parametrize("part", ["<b>x</i>", "<b><p>x", "<svg>", "<div>", "<li>x", '<p a="x ', "<td><b>x", "<!-- x", "< a ", "<title>x", "</p>"])
def test_time_grows_with_the_page(part):
    p = html_tree.train(html_tree.labelled_pages(20))
    took = []
    for n in (4_000, 32_000):
        began = time.process_time()
        html_tree.main_text(part * n, p)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.3


@pytest.mark.parametrize("parts", [("<li><div>", "<b>", "<li>x</li>"), ("<p>", "<b>", "<p>x"), ("<table>", "<i>", "<td>x"), ("<dl>", "<u>", "<dt>x<dd>y")])
def test_elements_in_a_deep_nest_of_inline_ones(parts):
    p = html_tree.train(html_tree.labelled_pages(20))
    took = []
    for n in (3_000, 24_000):
        began = time.process_time()
        html_tree.main_text(parts[0] + parts[1] * n + parts[2] * n, p)
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0] + 0.3


def test_a_page_of_megabytes():
    p = html_tree.train(html_tree.labelled_pages())
    paragraphs = [f"word {i} and more words of an article that goes on and on" for i in range(60_000)]
    page = "<body><nav><a href=/>home</a></nav><article>" + "".join(f"<p>{x}</p>" for x in paragraphs) + "</article></body>"
    assert len(page) > 3_000_000 and html_tree.main_text(page, p) == "\n".join(paragraphs)


def _article(page):
    """The test pages mark their article; its blocks, without a parser."""
    blocks = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", re.search("<article>(.*)</article>", page, re.S)[1])
    lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_agreement_on_the_pages(spark, sf):
    from riffle.llm.queries import QUERIES

    got = {r.page_id: r for r in QUERIES["op9_html_tree"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    same = sum(got[r.page_id].text == _article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) for r in pages)
    assert same >= 0.99 * len(pages) > 0
