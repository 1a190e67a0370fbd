import os

from pyspark.sql import functions as F

from sitegraph.operators import links as L
from scanner import scan_tags

GOLDEN = os.path.join(os.path.dirname(__file__), "golden")


def _extract(spark, html, url="./orchard.test/guide/trees/index.html"):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return L.extract_links(df).orderBy("pos")


def test_inline_tags(spark):
    got = [(r.tag, r.raw_link, r.type_attr) for r in
           _extract(spark, '<p><a href="pear"><b>1</b></a>, <img src="fig" type="image/gif"/>').collect()]
    assert got == [("a", "pear", None), ("img", "fig", "image/gif")]


def test_lexical_quirks(spark):
    html = ('<article data-href="x1"><a>no link</a><a href="">empty</a>'
            '<link type="text/css" href="s.css" href=""><img src="i.png" type="image/png">'
            '<script>var a="<a href=\\"q\\">";</script><A HREF="upper">'
            '<a href="first" href="last">')
    got = [(r.tag, r.raw_link, r.type_attr) for r in _extract(spark, html).collect()]
    assert got == scan_tags(html)
    assert ("a", "x1", None) in got and ("a", "last", None) in got
    assert all(link != "upper" for _, link, _ in got)


def test_golden_page_tags(spark):
    html = open(os.path.join(GOLDEN, "orchard.html"), encoding="utf-8").read()
    got = [(r.tag, r.raw_link, r.type_attr) for r in _extract(spark, html).collect()]
    assert got == scan_tags(html)
    assert got[0] == ("link", "css/season.css", "text/css") and ("a", "second.html", None) in got
    assert len(got) == 14


def test_no_limit_on_the_length_of_a_tag(spark):
    for n in (1500, 5000, 1_000_000):
        for html in (f'<a href="/x" title="{"y" * n}">t</a>', f'<a title="{"y" * n}" href="/x">t</a>',
                     f'<img {"data " * (n // 5)} src="/x">'):
            assert [r.raw_link for r in _extract(spark, html).collect()] == ["/x"], n
    assert _extract(spark, '<a href="/x" ' + "y" * 100_000).count() == 0


def test_page_links_classify_and_scope(spark):
    html = ('<a href="/a">x</a><a href="https://other.org/b">y</a>'
            '<img src="/i.png"><link href="/s.css"><a href="rel/c.html">z</a>')
    df = spark.createDataFrame([(1, "https://h.org/dir/page.html", html)], "page_id long, url string, html string")
    got = sorted((r.link_type, r.url) for r in L.page_links(df, scope="same").collect())
    assert got == [("HTML", "https://h.org/a"), ("HTML", "https://h.org/dir/rel/c.html"),
                   ("IMAGE", "https://h.org/i.png"), ("STYLE", "https://h.org/s.css")]
    got_all = L.page_links(df, scope="none").count()
    assert got_all == 5
