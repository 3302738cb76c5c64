"""Main text: vectors of markup, consensus of hosts, awkward rows."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text as H

SCHEMA = "page_id bigint, url string, html string"
FRAME = "<html><head><title>T</title><style>x</style></head><body><nav><a href=/>Home</a></nav>{}<footer>&copy; us</footer></body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>one <b>two</b>three<p>four</article>", "A & B one twothree four"),
        ("<article><p>a<br>b</p>\n\n<ul><li>x<li>y</ul></article>", "a b x y"),
        ("<article><p>5 &lt; 6 &#233; &eacute;&nbsp;z</p><script>var t='</p>'</script><!-- no --></article>", "5 < 6 é é z"),
        ("<div class='sidebar'><p>never this one, it is long enough to win otherwise</p></div><div class=content><p>this</p></div>", "this"),
        ("<article><header><h1>Head</h1></header><p>text</p><div class='ad'>buy</div><aside>more</aside><form><input> go</form></article>", "Head text"),
        ("<main><p>text</p><section id='comments'><p>me too</p></section><div class='cookie-notice'>ok?</div></main>", "text"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table><pre>a  b\nc</pre></article>", "1 2 3 a b c"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("", ""),
    ],
)
def test_vectors(body, text):
    assert H.extract(FRAME.format(body), None) == text


def test_host_consensus_beats_the_page_itself(spark):
    """A page whose longest container is not the article's place on its host."""
    usual = FRAME.format("<div class='post-12'><p>" + "story word " * 30 + "</p></div><div class='extra'><p>short</p></div>")
    odd = FRAME.format("<div class='post-99'><p>brief story</p></div><div class='extra'><p>" + "filler text here " * 20 + "</p></div>")
    rows = [(i, f"http://h.example/{i}", usual) for i in range(9)] + [(9, "https://H.example:80/x", odd), (10, "http://other.example/", odd)]
    got = {r.page_id: r for r in H.main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got[9].text == "brief story" and got[9].path == "html>body>div.post"
    assert got[10].text.startswith("filler")
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_awkward_rows(spark):
    rows = [(1, None, None), (None, "not a url", ""), (2, "http://a/", "plain text only"), (2, "http://a/", "plain text only"), (3, "//b/", "<" * 500), (4, "http://a/", "<article>" * 300 + "deep" + "</article>" * 300), (5, "http://a/", "<p a='" + "x" * 10_000), (6, "http://a/", "<article>" + "<p>w" * 20_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("host", "path", "text", "n_chars")})
    got = {r.page_id: r.text for r in H.main_text(df).collect()}
    assert H.main_text(df).count() == len(rows)
    assert got[1] == "" and got[None] == "" and got[2] == "plain text only" and got[4] == "deep"
    assert got[6] == " ".join(["w"] * 20_000)
    assert H.main_text(spark.createDataFrame([], SCHEMA)).count() == 0
