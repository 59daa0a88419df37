from strataprobe.llm import urls

from .helpers import union_find

SCHEMA = "page_id long, url string, html string, host string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, None, None) for i, u, h in rows], SCHEMA)


def link(to):
    return f'<html><head><LINK rel="canonical" href="{to}"></head></html>'


def judged(spark, rows, rules=urls.RULES, links=None):
    known = spark.createDataFrame(links, "src string, dst string") if links else None
    return {r["page_id"]: r for r in urls.judge_urls(pages(spark, rows), rules, known).collect()}


def test_rules(spark):
    rows = [(1, "http://A.example.NET/en/1", None), (2, "http://x.net", None), (3, "http://x.net/", ""), (4, "https://m.example.com/de/x?u=://q", "x"), (5, "http://notexample.com/de/", ""), (6, "ftp://y.org/fr/#a", ""), (7, None, ""), (8, "no scheme", ""), (9, "a://b://c.net/d", ""), (10, "http://example.net/enx", ""), (11, "page#http://x.net/a", None), (12, "http://q.org/fr#://z.net/", "")]
    got = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in judged(spark, rows).items()}
    assert got == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("x.net", "", None, "allow"),
        3: ("x.net", "/", "net/", "block"),
        4: ("m.example.com", "/de/x", "example.com/de/", "block"),
        5: ("notexample.com", "/de/", None, "allow"),
        6: ("y.org", "/fr/", "org/fr/", "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("b:", "//c.net/d", None, "allow"),
        10: ("example.net", "/enx", "net/", "block"),
        11: ("x.net", "/a", "net/", "block"),
        12: ("q.org", "/fr", None, "allow"),
    }


def test_blocks_reach_aliases_but_not_past_an_allow(spark):
    rows = [
        (1, "http://a.com/1", link("http://b.com/1")),
        (2, "http://b.com/1", '<meta http-equiv="refresh" content="0; url=http://evil.net/x">'),
        (3, "http://c.com/1", link("http://evil.net/x#frag")),
        (4, "http://d.com/1", link("http://e.net/z")),
        (5, "http://good.org/fr/1", link("http://e.net/z")),
        (6, "http://alone.com/", ""),
        (7, "http://alone.com/", ""),
    ]
    got = {k: (r["verdict"], r["via"]) for k, r in judged(spark, rows).items()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("allow", "default"), 5: ("allow", "rule"), 6: ("allow", "default"), 7: ("allow", "default")}


def test_links_are_resolved(spark):
    refresh = lambda to: f'<meta content="3;URL={to}" http-equiv=refresh>'
    rows = [
        (1, "http://a.com/x/1", link("//evil.net/x")),  # protocol-relative
        (2, "http://b.com/2", link("/3")),  # to 3, which refreshes to a blocked host
        (3, "http://b.com/3", refresh("https://EVIL.net/y#top")),
        (4, "HTTP://C.com/d/e", link("../f?a=1&amp;b=2")),
        (5, "http://c.com/f?a=1&b=2", refresh("HTTP://evil.NET/z")),
        (6, "http://d.com/1", link("http://fine.com/1") + refresh("http://fine.com/2") + link("http://evil.net/w")),  # all tags count
        (7, "http://e.com/1", link("mailto:me@x.net") + link("#top") + link("") + refresh("javascript:go(1)")),
        (8, "http://m.com/en/p", link("http://example.com/de/x")),
        (9, "http://M.com/en/q?k", link("p")),
        (10, "no scheme", link("//evil.net/x")),
        (11, "http://f.com?q", link("?r")),
        (12, "http://f.com?r", link("./.././evil")),
        (13, "http://f.com/evil", "x" * 200_000 + link("http://evil.net/")),
        (14, None, link("http://evil.net/")),
    ]
    got = {k: r["verdict"] for k, r in judged(spark, rows).items()}
    assert [k for k, v in sorted(got.items()) if v == "block"] == [1, 2, 3, 4, 5, 6, 8, 9, 11, 12, 13]


def test_known_links_against_union_find(spark):
    import random

    rng = random.Random(8)
    names = [f"http://h{i}.{'net' if i % 7 == 0 else 'org'}/{'fr/' if i % 11 == 0 else 'x/'}" for i in range(60)]
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    got = judged(spark, [(i, n, None) for i, n in enumerate(names)], links=[(names[a], names[b]) for a, b in links])
    root = union_find(60, links)
    rule = ["block" if n.split("/")[2].endswith(".net") else "allow" if n.split("/")[3] == "fr" else None for n in names]
    for i in range(60):
        mates = {rule[k] for k in range(60) if root[k] == root[i]}
        want = rule[i] or ("block" if "block" in mates and "allow" not in mates else "allow")
        assert got[i]["verdict"] == want, i


def test_empty(spark):
    assert urls.judge_urls(pages(spark, []), urls.RULES).count() == 0
