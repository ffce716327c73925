"""Relative targets of canonical links and refreshes, against Python's own resolution."""

from html import unescape
from urllib.parse import urldefrag, urljoin

from kinscribe.llm.url_filters import page_links, url_filter

PAGES = ["http://h.fr/a/b/c.html?q=1#f", "https://h.fr/a/", "http://h.fr/x"]
TARGETS = ["index.html", "?id=3", "../b", "./b", "../../../up", ".", "..", "./", "../", "sub/./x/../y?z=../w", "/a?x=1&amp;y=2", "//k.fr/p?x=1&amp;y=2", "/a/../b/", "/./d", "p?to=http://else.fr/q", "#part", "http://k.fr/full?a=1&amp;b=2", "&#x2e;&#46;/n", "caf&#233;", "&amp;lt;x", "&copy"]


def tag(k, target):
    return f'<link rel="canonical" href="{target}">' if k % 2 else f'<meta http-equiv="refresh" content="0; url={target}">'


def test_targets_against_urljoin(spark):
    rows = [(k, u, "<head>" + tag(k + i, t)) for k, (u, i, t) in enumerate((u, i, t) for u in PAGES for i, t in enumerate(TARGETS))]
    entities = lambda t: t if t == "&copy" else unescape(t)
    want = sorted((u, urldefrag(urljoin(u, entities(t)))[0]) for u in PAGES for t in TARGETS)
    got = page_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((x.source, urldefrag(x.target)[0]) for x in got) == want


def test_empty_folders_stay(spark):
    rows = [(1, "http://h.fr/x/y", tag(1, "a//b"))]  # as RFC 3986 has it; urljoin drops one slash
    assert [x.target for x in page_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == ["http://h.fr/x/a//b"]


def test_other_schemes_give_no_edge(spark):
    rows = [(1, "http://h.fr/x", tag(1, "mailto:a@b.fr")), (2, "http://h.fr/x", tag(1, "javascript:go('http://b.fr/')")), (3, "nothing", tag(1, "y")), (4, None, tag(1, "y"))]
    assert page_links(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 0


def test_blocks_reach_relative_aliases(spark):
    blocked = "http://s.example.com/en/1"
    rows = [
        (1, "http://one.fr/a/page", tag(1, "../hub?x=1&amp;y=2")), (2, "http://one.fr/hub?x=1&y=2", tag(1, blocked)), (3, "http://one.fr/a/index.html", tag(0, "?id=3")), (4, "http://one.fr/a/index.html?id=3", tag(1, "./page")),
        (5, "http://one.fr/b/page", tag(1, "index.html")), (6, "http://one.fr/b/index.html", None),
    ]
    got = {x.page_id: x.verdict for x in url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}
