"""Nested containers: the winning path is widened to the whole main part."""

import pytest

from tessera.llm import html_text as H
from tests.llm.test_html_text import FRAME, SCHEMA

LONG = "long text " * 60


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<article><h1>Head</h1><p>intro</p><div><p>own</p><section>{LONG}</section></div></article>", f"Head intro own {LONG}"),
        (f"<div class=content><h1>Head</h1><p>intro</p><div class=part>{LONG}</div></div>", f"Head intro {LONG}"),
        (f"<article><p>intro</p><table><tr><td>{LONG}</table></article>", f"intro {LONG}"),
        (f"<div class=wrap><div class=part>{LONG}</div><div class=links><a href='/1'>one</a> <a href='/2'>two</a></div></div>", LONG),
        (f"<main><article><p>a</p></article><article><div>{LONG}</div></article></main>", f"a {LONG}"),
    ],
)
def test_text_around_the_winner_stays(spark, body, text):
    assert H.extract(FRAME.format(body), None) == text.strip()
    got = H.main_text(spark.createDataFrame([(k, "http://h/", FRAME.format(body)) for k in range(3)], SCHEMA)).collect()
    assert {r.text for r in got} == {text.strip()}


def test_deep_nesting_needs_no_deep_stack():
    page = "<html><body>" + "<div>" * 1500 + "<p>" + LONG + "</div>" * 1500
    assert H.extract(page, None) == LONG.strip()


@pytest.mark.parametrize("tag", ["b", "span", "div", "section", "li", "p", "a", "td"])
def test_elements_nested_ten_thousand_deep(tag):
    deep = f"<{tag} class='box'>x " * 10_000 + f"</{tag}>" * 10_000
    page = f"<body><article><p>begin {'word ' * 30}</p>{deep}<p>end</p></article></body>"
    elements, pieces = H.parse(page)
    paths = H.scored(elements, pieces)
    assert max(map(len, paths), default=0) < 300
    text = H.extract(page, None)
    assert text.startswith("begin word") and text.endswith("end") and text.split().count("x") == 10_000


def test_unclosed_and_unmatched_tags_in_numbers():
    page = "<body><article><p>begin</p>" + "<i>a</b>" * 10_000 + "</article></body>"
    assert H.extract(page, None) == "begin " + "a" * 10_000


def test_formulas_drawings_objects_and_raw_text_are_content():
    page = (
        "<body><article><p>one</p><math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math><svg><path d='M0'/><text>label</text></svg>"
        "<object data='a'>fallback</object><xmp>a < b &amp;</xmp><textarea>t &amp; u</textarea>"
        "<script>no()</script><style>no</style><form><textarea>no</textarea><input></form><p>last</p></article></body>"
    )
    assert H.extract(page, None) == "one x<2labelfallback a < b &amp; t & u last"
