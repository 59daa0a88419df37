import random
from html import escape

import pytest
from pyspark.sql import functions as F

from strataprobe.llm import extraction as x

SCHEMA = "page_id long, url string, html string"


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(n)).capitalize() + "."


def page(rng, number, short=False, template="div"):
    """(html, main text) of a page whose sidebar and comments may outweigh it."""
    blocks = [sentence(rng, 6)] + [sentence(rng, rng.randrange(12, 40)) for _ in range(1 if short else rng.randrange(4, 9))]
    body = f"<h1>{escape(blocks[0])}</h1>" + "".join(f"<p>{escape(b)}</p>\n" for b in blocks[1:])
    noise = "".join(f"<p>{sentence(rng, 25)}</p>" for _ in range(6))
    main = {
        "div": f'<div class="wrap"><div class="x{number}9 post-{number}">{body}</div><div class="k{number}">{noise if short else ""}</div></div>',
        "article": f'<main class="has-sidebar"><article id="a{number}">{body}<footer>by me</footer></article></main>',
    }[template]
    html = (
        f'<html><head><title>T {number}</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>'
        f'<div id="cookie-notice"><p>We use cookies, and so on, for your own good.</p></div>{main}<aside><p>{sentence(rng, 30)}</p></aside><section class="comments"><article class="comment"><p>{sentence(rng, 60)}</p></article></section>'
        f'<form action="/s"><p>Search here.</p><input></form><div class="ad">{sentence(rng, 20)}</div><footer>&copy; me</footer></body></html>'
    )
    return html, "\n".join(blocks)


def test_hosts_agree_on_the_container(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(40):
        html, text = page(rng, i, short=i % 5 == 0)
        rows.append((i, f"http://A.example.com/{i}", html))
        want[i] = text
    for i in range(100, 115):
        html, want[i] = page(rng, i, template="article")
        rows.append((i, f"https://b.example.com?x={i}", html))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["page_id"]: r for r in x.main_texts(df).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert got[0]["paths"][0] == "div.wrap > div.*.post-*"
    assert x.extract(rows[0][2]) != want[0]  # alone, the noise outweighs it


def test_merged_winners_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, f"http://a.example.com/{i}", page(rng, i, short=i % 4 == 0)[0]) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, x.main_texts(df).select("page_id", "text").collect()))
    monkeypatch.setattr(x, "broadcast_bytes", lambda spark: 0)
    assert sorted(map(tuple, x.main_texts(df).select("page_id", "text").collect())) == want


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("  \n ", ""),
        ("no markup at &#x61;ll &amp; done", "no markup at all & done"),
        ("<p>One<p>Two<br>lines &nbsp; here<ul><li>a<li>b</ul>", "One\nTwo lines here\na\nb"),
        ("<article><p>x <!-- <p>no</p> --> y<script>if (a<b) {}</script>z</p></article>", "x yz"),
        ("<article><h1>T</h1><p><b>Bold<br><p>Next</p></article><footer>f</footer>", "T\nBold\nNext"),
        ("<div><table><tr><td>1<td>2<tr><td>3</table>end of it.</div>", "1\n2\n3\nend of it."),
        ('<article><p title="a > b">Text</p><p class=\'x\' hidden>no</p></article>', "Text"),
        ("<article><header><p>By me</p><h1>Head</h1></header><p>Text.</p></article>", "Head\nText."),
        ("<form><h1>Head</h1><p>All in a form.</p><input></form>", "Head\nAll in a form."),
        ("<nav>only a menu</nav>", ""),
        ("<p>open <b>and <i>never", "open and never"),
        ("<p>cut off <a href='x", "cut off"),
        ("<script>never closed <p>no</p>", ""),
        ("<!-- never closed <p>no</p>", ""),
        ("<p>a</p></div></div></p><p>b</p>", "a\nb"),
        ("<title>T</title><p>x</p><textarea><p>no</p></textarea>", "x"),
        ("<article><p>5 < 6 and 7 > 3 &lt;b&gt;</p></article>", "5 < 6 and 7 > 3 <b>"),
        ("<P CLASS=Nav-Item>no</P><DIV CLASS='longform'>Yes.</DIV>", "Yes."),
        ('<body><div class="page"><div class="post"><h2><b>Title</b></h2><div class="text"><p>Body one, and on.</p><p>Two.</p></div></div><div class="c7"><p>Not much.</p></div></div>', "Title\nBody one, and on.\nTwo."),
        ("<a href=x>link<p>para one, long enough to be text.</a><p>two</p>", "link\npara one, long enough to be text.\ntwo"),
    ],
)
def test_pages(html, text):
    assert x.extract(html) == text


def test_names_are_generalised():
    assert x.general("post-8471") == "post-*" and x.general("css-1a2b3c") == "css-*" and x.general("Main_Body") == "main-body"
    assert x.words_of("siteHeader has-sidebar no_comments") == {"site", "header", "has", "no"}
    page = x.Page('<body><div class="b a a-12"><section id="s-9"><p>x')
    assert page.path(3) == "div.a.a-*.b > section.#s-*"
    assert x.path_key(page.path(4)) == page.path_keys()[4]


def test_hostile_pages_end():
    for html in ["<" * 50_000, "<!--" * 50_000, "<a href='" * 20_000, "<div>" * 20_000 + "x", "<b>" * 5_000 + "<p>x</p>" * 2_000, "</p>" * 50_000, "<p><b>" * 20_000 + "end"]:
        assert isinstance(x.extract(html), str) and isinstance(x.vote(html)[1], int)
    long = "<article>" + "<p>word here.</p>" * 100_000 + "</article>"
    assert len(x.extract(long)) == 11 * 100_000 - 1


def test_query(spark, tmp_path):
    rows = [(1, "http://h.example.com/a", "<article><p>Ünï &eacute;.</p></article>"), (1, "http://h.example.com/a", "<article><p>Ünï &eacute;.</p></article>"), (None, None, "<p>Alone.</p>"), (2, "no host", "<p>Alone too.</p>"), (3, "http://h.example.com/b", None)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("a").alias("host"), F.lit("b").alias("paths"), F.lit("c").alias("text"), F.lit(1).alias("n_chars"))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = x.op13_html_extraction(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(
        map(repr, [(1, rows[0][1], "Ünï é.", 6), (1, rows[0][1], "Ünï é.", 6), (None, None, "Alone.", 6), (2, "no host", "Alone too.", 10), (3, rows[4][1], "", 0)])
    )
    assert x.main_texts(df.limit(0)).collect() == []
