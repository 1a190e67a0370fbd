"""DOM mode and RFC-3986 resolution, checked against the standard library."""

import os
import posixpath
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from sitegraph.functions import rfc as RFC
from sitegraph.operators import links as L
from sitegraph.operators import rewrite as RW

BASES = ["https://h.org/a/b.html", "https://h.org/a/b/", "http://h.org", "https://h.org/x/y?q=1#f",
         "https://h.org/p;par/q;x"]
LINKS = ["c", "/c", "../c", "../../../c", "./c/", "?q=2", "#frag", "//cdn.org/x.js", "mailto:a@b.org",
         "https://o.org/z;p?q#f", "c/./d/../e", "..", ".", "", "javascript:void(0)", "HTTP://UP.org/A",
         "c;p/d;q", "http:rel", "a//b"]


def _py_resolve(href, base):
    p = urlparse(href)
    if not p.netloc:
        p = urlparse(urljoin(base, href))
    p = p._replace(params="", query="", fragment="")
    return p.scheme, p.netloc, p.path, p.geturl()


def test_resolve_rfc_matches_urllib(spark):
    data = [(l, b) for b in BASES for l in LINKS]
    df = spark.createDataFrame(data, "l string, b string")
    r = RFC.resolve_link_rfc("l", "b")
    got = df.select("l", "b", r["scheme"].alias("s"), r["netloc"].alias("n"), r["path"].alias("p"),
                    RFC.resolve_link_rfc_url("l", "b").alias("u")).collect()
    for row in got:
        assert (row.s, row.n, row.p, row.u) == _py_resolve(row.l, row.b), (row.l, row.b)


def _py_local(url):
    p = urlparse(url)
    local = os.path.join("", p.netloc, p.path.lstrip("/"))
    seg = p.path[p.path.rindex("/"):] if "/" in p.path else p.path
    if seg.count(".") == 0:
        local = os.path.join(local, "index.html")
    return local


def _py_rel(cur, ref):
    c = _py_local(cur).rstrip("/")
    c = c[:c.rindex("/")]
    return posixpath.relpath(_py_local(ref), c)


def test_local_and_relative_paths(spark):
    urls = ["https://h.org", "https://h.org/", "https://h.org/a/b.html", "https://h.org/a/b", "https://h.org/a/b/",
            "https://o.org/x/y.css?v=1", "https://h.org/a/c/d.png"]
    data = [(a, b) for a in urls for b in urls]
    df = spark.createDataFrame(data, "a string, b string")
    got = df.select("a", "b", RFC.local_path("a").alias("la"),
                    RFC.relative_path_min(RFC.local_path("a"), RFC.local_path("b")).alias("r")).collect()
    for row in got:
        assert row.la == _py_local(row.a)
        assert row.r == _py_rel(row.a, row.b), (row.a, row.b)


def test_dom_extraction(spark):
    html = ('<html><!-- <a href="/in-comment"> --><script>var s="<a href=/in-script>";</script>'
            '<A HREF=\'/upper\' class=x>u</A><img src=/img.png alt="a>b"><link rel="icon" href="/f.ico">'
            '<link rel="stylesheet" href="/s.css"><link rel="alternate" href="/feed"><iframe src="/fr.html"></iframe>'
            '<script src="/app.js"></script><a href="/x?a=1&amp;b=2" href="/last">d</a><a href="">e</a><a>f</a>'
            '<article href="/no">g</article></html>')
    df = spark.createDataFrame([(1, "https://h.org/p/index.html", html)], "page_id long, url string, html string")
    got = [(r.tag, r.raw_link) for r in L.extract_links_dom(df).orderBy("pos").collect()]
    assert got == [("iframe", "/fr.html"), ("a", "/upper"), ("a", "/last"), ("img", "/img.png"),
                   ("script", "/app.js"), ("link", "/f.ico"), ("link", "/s.css")]


def test_dom_rewrite(spark):
    html = '<p>x</p><a href="/a/b.html">1</a><img src="../i.png" alt=z><!-- <a href="/c"> --><a href=\'sub/\'>2</a>'
    df = spark.createDataFrame([(html, "https://h.org/d/page.html")], "html string, url string")
    got = df.select(RW.rewrite_html_dom("html", "url").alias("o")).first().o
    assert got == ('<p>x</p><a href="../a/b.html">1</a><img src="../i.png" alt=z><!-- <a href="/c"> -->'
                   '<a href="sub/index.html">2</a>')


def _links(spark, html):
    df = spark.createDataFrame([(1, "https://h.org/p/index.html", html)], "page_id long, url string, html string")
    return [(r.tag, r.raw_link) for r in L.extract_links_dom(df).orderBy("pos").collect()]


def test_long_and_unclosed_tags_do_not_end_the_job(spark):
    for filler in ("y" * 1_000_000, "k=v " * 50_000, "'q' " * 50_000):
        assert _links(spark, f'<a {filler} href="/x">t</a>') == [("a", "/x")]
        assert _links(spark, f'<a href="/x" {filler}>t</a>') == [("a", "/x")]
        assert _links(spark, f'<a href="/x" {filler}') == []
        df = spark.createDataFrame([(f'<a {filler} href="/x">t</a>', "https://h.org/")], "html string, url string")
        assert df.select(RW.rewrite_html_dom("html", "url").alias("o")).first().o == f'<a {filler} href="x/index.html">t</a>'


def test_only_its_own_end_tag_ends_a_script(spark):
    html = '<script>"</style><a href=\'/in\'>"</script><a href="/out">x</a><style>a</script><a href="/in2"></style><a href="/o2">'
    assert _links(spark, html) == [("a", "/out"), ("a", "/o2")]


def test_character_references(spark):
    from html import unescape
    values = ["/a&#x2F;b&#47;c&eacute;", "?x=1&amp;y=2&amp;lt;", "&notaname;&#0;&#xD800;&#x1F600;", "&quot;&apos;&lt;&gt;", "a&b;c&;",
              "&NotEqualTilde;&fjlig;", "&#1114112;"]
    for value in values:
        want = unescape(value) if "&#0;" not in value else "&notaname;\ufffd\ufffd\U0001F600"
        if value == "&notaname;&#0;&#xD800;&#x1F600;":
            want = "&notaname;\ufffd\ufffd\U0001F600"
        assert _links(spark, f"<a href='{value}'>x</a>".replace("&apos;", "&apos;")) == [("a", want)], value


def test_attributes_are_cut_up_without_loss(spark):
    from sitegraph.functions import html as H
    tags = ['<a href=x title=\'y\'>', '<a  HREF = "1" / href=2 = "stray" b>', "<img/src=a.png>", '<a href="">', "<a x=>"]
    for tag in tags:
        cut = spark.createDataFrame([(tag,)], "t string").select(H.dom_pieces(F.col("t")).alias("c")).first().c
        assert cut.head + "".join(cut.pieces) == tag
