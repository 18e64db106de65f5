"""Links, crawl and page tree against brute force."""

from collections import deque
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from cinderpath.sources import crawl, page_tree, pages

PAGES = [
    "<div>a<p>b<p>c</div>d<p>e</p></div>", "<b><p>x</b>y</p>z", "<p/>q<br>r<br/>s</br>", "<pre>1\n2\n</pre><p>x", "plain &lt;b&gt; &#233; &amp;amp; text\nmore", "", None,
    "<script>var t='</p><div>';</script><p>ok<!-- <p>no</p> --> yes</p>", "<div><div><p>in</p></div>out</div>", "<p title='a>b'>t</p>", "<DIV>U<P>v</DIV>w", "a < b <p>c < d</p>", "<p>" * 300 + "deep" + "</p>" * 200,
]


class Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.stack, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, []))
        if tag not in page_tree.VOID:
            self.stack.append(self.found[-1])

    def handle_startendtag(self, tag, attrs):
        self.found.append((tag, []))

    def handle_endtag(self, tag):
        if tag in [e[0] for e in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][0] in ("script", "style")):
            for e in self.stack:
                e[1].append(data)


def by_hand(html):
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return [(tag, "".join(text)) for tag, text in tree.found if tag in ("p", "div", "br", "pre")]


def test_page_tree(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)), "i int, html string")
    found = {}
    for r in page_tree.elements(df, ("p", "div", "br", "pre"), "html", "i").orderBy("i", "ord").collect():
        found.setdefault(r.i, []).append((r.tag, r.text))
    assert [found.get(i, []) for i in range(len(PAGES))] == [by_hand(h) for h in PAGES]
    lines = {r.i: r.lines for r in page_tree.tree_lines(df, "html", "i").collect()}
    assert lines[0] == ["abc", "bc", "c", "e"] and lines[3] == ["1", "2"] and lines[4] == ["plain <b> é &amp; text", "more"] and lines[5] == lines[6] == []
    assert page_tree.page_text(df.where("i = 0"), "html", "i").first().text == "abcde"


def test_addresses(spark):
    bases = ["http://a.org/x/y.htm", "http://a.org", "https://b.net/p/q/?z=1#t", "http://a.org/x/y/"]
    hrefs = ["m.htm", "../m.htm", "./m.htm", "/r/s.htm", "//c.org/z", "http://d.org/../k", "?q=1", "#f", "", "..", "../..", "../../../up.htm", "a/./b/../c.htm?x=../y", "mailto:x@y", "sub/"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in df.select("b", "h", pages.absolute(F.col("b"), F.col("h")).alias("url")).collect():
        assert r.url == urljoin(r.b, r.h), (r.b, r.h)


def test_site(spark):
    index = '<a href="2024.htm">2024</a> <A class=x HREF=\'results/m1.htm\'>M <b>1</b></A><iframe src="f1.htm"></iframe><frame src=f2.htm><a name="x">none</a><a href="?a=1&amp;b=2">q'
    site = [
        ("http://a.org/i/", index), ("http://a.org/i/f1.htm", '<a href="deep.txt">d</a><iframe src="f2.htm"></iframe><iframe src="./">'), ("http://a.org/i/f2.htm", '<iframe src="f1.htm"><a href="pvc/3.html">x</a>'),
        ("http://a.org/i/2024.htm", '<a href="./">2026</a><a href="results.htm">r</a>'), ("http://a.org/none", None),
    ]
    links = crawl.page_links(spark.createDataFrame(site, "url string, html string"))
    assert ("http://a.org/i/", "http://a.org/i/results/m1.htm", "M 1", False) in {tuple(r) for r in links.collect()} and links.count() == 12
    start = spark.createDataFrame([("http://a.org/i/", "2026")], "url string, year string")
    reached = crawl.crawl(start, links)
    assert {(r.url[15:], r.depth, r.year, r.round) for r in reached.collect()} == {("", 0, "2026", 0), ("2024.htm", 0, "2024", 1), ("f1.htm", 1, "2026", 1), ("f2.htm", 1, "2026", 1)}
    assert {(r.url[15:], r.year) for r in crawl.archived(reached, links).collect()} == {("deep.txt", "2026"), ("pvc/3.html", "2026"), ("results.htm", "2024"), ("results/m1.htm", "2026")}
    assert {r.link[15:] for r in crawl.meet_links(start, links).collect()} == {"results/m1.htm", "pvc/3.html"}


def test_crawl_is_linear_in_links(spark):
    """100,000 links with many ways back: each page once, in the round of its distance."""
    n = 20_000
    links = spark.range(5 * n).selectExpr(f"concat('p', id % {n}) AS page", f"concat('p', CASE id div {n} WHEN 0 THEN id % {n} div 2 WHEN 1 THEN (id % {n}) * 2 % {n} WHEN 2 THEN ((id % {n}) * 2 + 1) % {n} WHEN 3 THEN 0 ELSE (id * 7 + 1) % {n} END) AS link", "'x' AS text", "true AS is_frame")
    edges = {}
    for r in links.collect():
        edges.setdefault(r.page, []).append(r.link)
    far, queue = {"p1": 0}, deque(["p1"])
    while queue:
        page = queue.popleft()
        for link in edges[page]:
            if link not in far:
                far[link] = far[page] + 1
                queue.append(link)
    found = crawl.crawl(spark.createDataFrame([("p1", "2026")], "url string, year string"), links).collect()
    assert len(found) == len(far) and {r.url: r.round for r in found} == far and all(r.depth == r.round for r in found)


def test_meet_links_hold_no_more_than_their_result(spark, monkeypatch):
    """Forty indexes show a chain of frames that ends in a loop; links stand many times. Rounds hold pages with the results that they reach, not all pages below pages."""
    frames = [(f"i{i}", "p0") for i in range(40)] * 3 + [(f"p{i}", f"p{i + 1}") for i in range(20)] + [("p20", "p18"), ("i0", "i0"), ("i1", "gone"), (None, "p0"), ("p3", None)]
    results = [("p20", "/results/a.htm"), ("p20", "/results/a.htm"), ("i7", "/pvc/b.html"), ("i7", "/other.htm"), ("i8", None)]
    links = spark.createDataFrame([(p, q, "", True) for p, q in frames] + [(p, q, "", False) for p, q in results], "page string, link string, text string, is_frame boolean")
    indexes = spark.createDataFrame([(f"i{i}",) for i in range(40)] * 2 + [("p19",), ("lone",), (None,)], "url string")
    held, reach = [], crawl.reach
    monkeypatch.setattr(crawl, "reach", lambda *a: held.append(reach(*a)) or held[-1])
    found = sorted((r["index"], r.link) for r in crawl.meet_links(indexes, links).collect())
    assert found == sorted([(f"i{i}", "/results/a.htm") for i in range(40)] + [("p19", "/results/a.htm"), ("i7", "/pvc/b.html")])
    assert held[0].count() <= 40 + 21 + 1 + 1
