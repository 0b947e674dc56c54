"""Page text by parsing, on pages with nesting, unclosed elements and containers named as furniture."""

import pytest

from corpusloom.functions.html import page_text, page_texts

PAGES = [
    ("<div class='cookie-banner'>Accept</div><p>real text</p>", "real text"),
    ("<header>a <header>b</header> c</header> kept", "kept"),
    ("<nav>menu <div><ul><li>x<li>y</ul></div></nav>body text", "body text"),
    ("<div id='Sidebar-2'><p>links</p><div>more</div></div><p>one<p>two", "one two"),
    ("<html><head><title>T</title><style>p{}</style></head><body>in <b>body</b><!-- not this --></body></html>", "in body"),
    ("<p>a &amp; b &lt;c&gt; &eacute;&#233;</p>", "a & b <c> éé"),
    ("<script>if (a < b) { document.write('<p>no</p>') }</script>yes", "yes"),
    ("<ul><li class='social'>share<li>item</ul>", "item"),
    ("text <br> more<img class='banner'> end", "text more end"),
    ("<div class='modal'>never closed <p>all of it", ""),
    ("</div></p>stray ends", "stray ends"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    (None, ""),
    ("", ""),
    ("plain", "plain"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_page_text(html, text):
    assert page_text(html) == text


def test_long_nesting_and_columns(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(k, "b", h) for k, (h, _) in enumerate(PAGES)] + [(99, "b", deep), (99, "b", deep)]
    frame = spark.createDataFrame(rows, "page_id long, other string, html string")
    found = page_texts(frame)
    assert found.columns == ["page_id", "other", "body"]
    assert sorted((r["page_id"], r["body"]) for r in found.collect()) == sorted([(k, t) for k, (_, t) in enumerate(PAGES)] + [(99, "x"), (99, "x")])
    assert page_texts(frame.limit(0)).count() == 0
