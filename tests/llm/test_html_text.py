from __future__ import annotations

import pytest

from parchmill.llm import html_text
from parchmill.llm.queries import queries


def text(source, template=()):
    root = html_text.parse(source)
    html_text.hash_subtrees(root)
    return html_text.main_text(root, set(template))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="with-sidebar"><header>Site</header><nav><ul><li><a href="/a">A</a></ul></nav><!-- ad --><div class="ad box">Buy</div>
<article class="post"><header class="entry-header"><h1>Head &amp;\n line</h1></header><p><b>One<br><p>Two&nbsp;&eacute;&#33;<p>
<ul><li>x<li>y</ul><aside>Side</aside><form><p>mail</p></form><div id="comments"><p>first!</p></div>
<table><tr><td>c1<td>c2</table><div role="alert">A</div><span hidden>no</span><p style="display: none">no</p>
tail</article><div class="cookie-notice">Cookies</div><footer>&copy; x</footer>"""


def test_article():
    assert text(PAGE) == "Head & line\nOne\nTwo é!\nx\ny\nc1\nc2\ntail"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b</i></p></p>", "a\nb"),
        ("<main><p>in</p></main><p>out", "in"),
        ("<body><p>a &lt;b&gt; &unknown; &am", "a <b> &unknown; &am"),
        ("<p>cut <a href='x", "cut"),
        ("<p>1 < 2 and <3</p><!-- open", "1 < 2 and <3"),
        ("<article>one</article><article>two</article>", "one\ntwo"),
        ("<aside><article>teaser</article></aside><article>real</article>", "real"),
        ("<div>a <b>b</b><i> c</i></div>d", "a b c\nd"),
        ("<textarea><p>x</textarea>y", "y"),
        ("<pre>a\n  b</pre>", "a b"),
    ],
)
def test_small_pages(source, want):
    assert text(source) == want


def test_deep_and_long_pages():
    assert text("<div>" * 20_000 + "x") == "x"
    assert text("<p>" + "word " * 100_000) == ("word " * 100_000).strip()


def test_templates_are_deleted_but_not_from_articles(spark):
    rows = [(i, f"http://Host.org/{i}", f"<div><b>Menu</b> of all</div><div>Text {i}</div>") for i in range(30)]
    rows += [(100 + i, "http://host.org/r", f"<article><p>Reprint</p><p>{i}</p></article>") for i in range(30)]
    rows += [(200, "http://lone.org/", "<div><b>Menu</b> of all</div>"), (201, None, None), (201, None, None), (None, "x", "")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    found = {r.page_id: r.text for r in got}
    assert found[3] == "Text 3" and found[103] == "Reprint\n3" and found[200] == "Menu of all" and found[201] == ""
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(none).collect() == []


def test_query(spark, sf_dir):
    """Pages of the table mark their article: its blocks by plain string work."""
    import html
    import re

    sources = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for row in queries()["op1_html_text"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", sources[row.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?h1>|</?p>", article)]
        assert row.text == "\n".join(block for block in blocks if block)


def texts_of(spark, rows):
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {row.page_id: row.text for row in got}


def test_counts_decide_inside_articles(spark):
    """A box with no telling name goes where it recurs; copies of an article keep what they hold."""
    box = "<div><p>Join our list</p><ul><li>now</ul></div>"
    page = "<article><h1>Title {0}</h1><p>Text {0}</p><p>Reprint</p>{1}<ul><li>item {0}</ul></article>"
    rows = [(i, "http://a.org/x", page.format(i, box if i % 2 else "")) for i in range(40)]
    rows += [(100 + i, "http://b.org/x", page.format(i, box if i < 4 else "")) for i in range(40)]
    copy = "<article><h1>One</h1><p>{}</p><ul><li>kept</ul></article>"
    rows += [(200 + i, "http://c.org/x", copy.format(i)) for i in range(20)]
    rows += [(300 + i, "http://d.org/x", "<div>whole page</div>") for i in range(20)]
    rows += [(400 + i, None, f"<div>no host</div><p>{i}</p>") for i in range(20)]
    found = texts_of(spark, rows)
    for i in range(40):
        assert found[i] == f"Title {i}\nText {i}\nReprint\nitem {i}"
        assert ("Join our list" in found[100 + i]) == (i < 4)
    for i in range(20):
        assert found[200 + i] == f"One\n{i}\nkept"
        assert found[300 + i] == "whole page" and found[400 + i] == f"no host\n{i}"


def test_counts_as_by_brute_force(spark):
    import random

    rng = random.Random(8)
    boxes = [f"<div><p>box {k}</p></div>" for k in range(12)]
    pages = {}
    for i in range(120):
        own = [box for k, box in enumerate(boxes) if rng.random() < 0.02 * (k + 1)]
        pages[i] = (f"http://h{i % 3}.org/", own, f"<article><h1>t{i}</h1>" + "".join(own) + "</article>")
    found = texts_of(spark, [(i, url, html) for i, (url, _, html) in pages.items()])
    deleted = 0
    for i, (url, own, _) in pages.items():
        same = [other for address, other, _ in pages.values() if address == url]
        counts = {box: sum(box in other for other in same) for box in own}
        kept = [box for box in own if counts[box] < html_text.MIN_PAGES or counts[box] < html_text.MIN_SHARE * len(same)]
        deleted += len(own) - len(kept)
        assert found[i] == "\n".join([f"t{i}", *(box[8:-10] for box in kept)])
    assert deleted


@pytest.mark.parametrize("name", ["related-work", "widget-guide", "header-files", "social-history"])
def test_a_name_counts_as_a_whole(name):
    assert text(f'<article><p>a</p><div class="{name}">b</div></article>') == "a\nb"


@pytest.mark.parametrize("name", ["related-posts", "ad", "box ad", "cookie-notice", "site_footer", "commentList comments-12"])
def test_names_that_tell_no_content(name):
    assert text(f'<article><p>a</p><div class="{name}">b</div></article>') == "a"


def test_formulas_are_text():
    assert text("<article><p>so <math><mi>x</mi></math> is</p></article>") == "so x is"
