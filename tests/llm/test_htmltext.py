"""Main text: the cut into blocks, the network's gradients, its labels on pages of known text."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import htmltext, queries
from ledgerloom.llm.common import table


@pytest.fixture(scope="module")
def model(spark):
    return htmltext.fit(table(spark, "/root/testdata/sf0.001", "pages"))


def texts(page):
    return [b.text for b in htmltext.blocks(page)]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, []),
        ("", []),
        ("just text", ["just text"]),
        ("<p>a<p>b<br>c\n d<b>e</b>f", ["a", "b c def"]),
        ("<p>x &amp; y&nbsp;&lt;z&gt; &copy 1 &#233;&#xe9; &am</p>", ["x & y <z> © 1 éé &am"]),
        ("<script>if (a < b) document.write('<p>no</p>')</script><p>yes", ["yes"]),
        ("<STYLE>p{}</STYLE ><p>yes<!-- <p>no</p> --> on<!-- open", ["yes on"]),
        ("<p title='a > b' class=\"x\">t</p><img alt=\"<p>no</p>\">u", ["t", "u"]),
        ("<div>a<div>b</div>c</div>d", ["a", "b", "c", "d"]),
        ("<p>1 < 2 and 3<4</p>", ["1 < 2 and 3<4"]),
        ("<p>cut off <a href=\"x", ["cut off"]),
        ("<script>never closed <p>no", []),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<p> \t\n </p><p>\x85x y</p>", ["x y"]),
        ("</p></div></x>a</p>", ["a"]),
        ("<a <a <a", ["<a <a"]),
    ],
)
def test_blocks(page, expected):
    assert texts(page) == expected


def test_paths():
    page = '<body><div class="siteHeader main-nav" id=top><ul><li><a href=#>Home</a> x</ul></div><article><p>t <span class="ad">u</span><p>v</article><p>w'
    found = htmltext.blocks(page)
    assert {"t:div", "c:site", "c:header", "c:main", "c:nav", "c:top", "t:li"} <= found[0].path and found[0].linked == pytest.approx(4 / 6)
    assert "c:ad" in found[1].path and "t:article" in found[1].path
    assert "c:ad" not in found[2].path and found[2].leaf == ("p", "article")
    assert "t:article" not in found[3].path


def test_many_tags_take_linear_time():
    for page in ("<a <" * 200_000, "<p x='" * 200_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<!--" * 200_000, "</b>" * 200_000):
        assert len(htmltext.blocks(page)) <= 1


def test_gradients():
    rng = random.Random(1)
    cut = [htmltext.blocks(htmltext.made_page(rng, ["one", "two", "three"])) for _ in range(3)]
    cut = [c for c in cut if c]
    net, made = htmltext.Labeller(), htmltext.Vectors().of([b for c in cut for b in c])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    lengths, n = np.array([len(c) for c in cut]), sum(map(len, cut))
    truth = np.random.default_rng(1).integers(0, 2, n).astype(float)
    there = np.ones((n, htmltext.PATH_SIZE + htmltext.WORD_SIZE + htmltext.MEASURES))
    there[::2, htmltext.PATH_SIZE :] = 0

    def loss():
        g, _ = net.forward(net.inputs(made) * there, lengths)
        return float(np.mean(np.logaddexp(0, g) - truth * g))

    grad = net.gradients(made, lengths, truth, there)
    for k, v in net.p.items():
        at = np.unravel_index(np.argmax(np.abs(grad[k])), v.shape)
        v[at] += 1e-2
        up = loss()
        v[at] -= 2e-2
        down = loss()
        v[at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(float(grad[k][at]), rel=0.03, abs=1e-5), k


def test_order_of_pages_does_not_matter(model):
    rng = random.Random(4)
    cut = [htmltext.blocks(htmltext.made_page(rng, ["one", "two", "three"])) for _ in range(40)] + [[]]
    together = model.main(cut)
    assert all((a == b).all() for a, b in zip(together, (model.main([c])[0] for c in cut)))


def test_held_out_pages(model):
    """Made pages that the network has not seen, with other words."""
    rng = random.Random(99)
    words = "amber river stone under cloud merry walks beyond seven doors quietly".split()
    right = n = whole = 0
    for _ in range(300):
        cut = [b for b in htmltext.blocks(htmltext.made_page(rng, words)) if b.text[0] in (htmltext.MAIN, htmltext.REST)]
        truth = np.array([b.text[0] == htmltext.MAIN for b in cut])
        for b in cut:
            b.text = b.text.strip(htmltext.MAIN + htmltext.REST) or "-"
        own = model.main([cut])[0]
        right, n, whole = right + (own == truth).sum(), n + len(truth), whole + (own == truth).all()
    assert right / n > 0.985 and whole / 300 > 0.85


WRITTEN = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class="page">
<div id="cookie-banner"><p>We use cookies to make this site work.</p><button>Accept</button></div>
<header class="site-header"><a href="/"><b>The Daily</b></a><p>News since 1990</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Sport</a></li></ul></nav>
<div class="wrapper"><{0}><h1>A long walk</h1><p>It began &amp; went on.</p>
<div class="advertisement"><p>Buy our shoes, they are the best shoes.</p></div>
<p>Then it rained.<br>It stopped.</p><ul><li>First hill</li><li>Second hill</li></ul><p>End.</p></{1}>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>I walked there too, and it was a fine day.</p></div><div class="comment"><p>No.</p></div></section>
<aside class="sidebar"><h3>Related</h3><p>Another walk that we wrote about last year.</p></aside></div>
<form action="/s"><label>Mail</label><input><button>Sign up</button></form>
<footer><p>&copy; 2020 The Daily. All rights reserved.</p></footer><script>var p = "<p>no</p>";</script></body></html>"""


@pytest.mark.parametrize("kind", ["article", "main", 'div class="entry-content"', 'div id="content"', 'section class="post"'])
def test_written_pages(model, kind):
    page = WRITTEN.replace("{0}", kind).replace("{1}", kind.split()[0])
    cut = htmltext.blocks(page)
    own = model.main([cut])[0]
    assert [b.text for b, keep in zip(cut, own) if keep] == ["A long walk", "It began & went on.", "Then it rained. It stopped.", "First hill", "Second hill", "End."]


def truth_of(page):
    """The article of the given tables' pages, by their one layout."""
    body = page[page.index("<article>") + 9 : page.rindex("</article>")]
    lines = re.sub(r"</?(?:p|h1)>", "\n", body).replace("<br>", " ").replace("<b>", "").split("\n")
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in lines) if t)


def test_query(spark):
    rows = {r.page_id: r for r in queries.op11_maintext(spark, "/root/testdata/sf0.01").collect()}
    given = table(spark, "/root/testdata/sf0.01", "pages").collect()
    assert len(rows) == len(given)
    for r in given:
        own = rows[r.page_id]
        assert (own.url, own.text, own.n_chars) == (r.url, truth_of(r.html), len(truth_of(r.html)))


def test_odd_rows(spark, model):
    long = "<article>" + "".join(f"<p>Paragraph {i} is here.</p>" for i in range(3000)) + "</article><footer>&copy; us</footer>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p></p>"), (4, "u", long), (4, "u", long), (None, "u", "<article><p>A \U0001f600.</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = htmltext.extracted(df.withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit("mine"))).collect()
    by = sorted(((r.page_id or 0, r.n_chars, r.text) for r in got), key=lambda r: r[:2])
    assert [r[:2] for r in by] == [(0, 4), (1, 0), (2, 0), (3, 0), *[(4, len(by[-1][2]))] * 2]
    assert by[-1][2] == "\n".join(f"Paragraph {i} is here." for i in range(3000))
    assert htmltext.main_text(df.where("false"), model).count() == 0
    assert htmltext.extracted(df.where("false")).count() == 0
    kept = htmltext.main_text(df.withColumn("n", F.lit(1)), model, out_col="body")
    assert kept.columns == ["page_id", "url", "html", "n", "body"]
