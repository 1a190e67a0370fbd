"""Tag scans: any page is cut up in linear time, without loss, and as the plain rules say."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.operators import links as L
from sitegraph.operators import rewrite as RW
from scanner import scan_tags

PARTS = ["<a ", "<link ", "<img ", "<script ", "<b>", ">", 'href="', 'src="', 'type="', '"', "'", "x", " ", "/", "=", "<", "</a>",
         'href="u"', 'src="v"', 'type="t/p"', 'alt="1>2"', "<!--", "-->", "</script>", "<style>", "</style>", "&amp;", "<iframe src=y>"]


def pages(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randint(1, 25))) for _ in range(n)]


def _frame(spark, htmls):
    return spark.createDataFrame([(k, "https://h.org/p/index.html", h) for k, h in enumerate(htmls)],
                                 "page_id long, url string, html string")


def test_random_pages_follow_the_plain_rules(spark):
    """A tag starts at the first place where one with a link can be read; an empty value
    makes a tag of it (but no link), so pages with empty values are left to other tests."""
    htmls = [h for h in pages(3, 6000) if '=""' not in h]
    found = {}
    for r in L.extract_links(_frame(spark, htmls)).collect():
        found.setdefault(r.page_id, []).append((r.pos, r.tag, r.raw_link, r.type_attr))
    for k, h in enumerate(htmls):
        assert [x[1:] for x in sorted(found.get(k, []))] == scan_tags(h), h


@pytest.mark.parametrize("cut", [H.lexical_pieces, H.dom_cut])
def test_pieces_make_up_the_page(spark, cut):
    htmls = pages(5, 3000)
    got = _frame(spark, htmls).select("page_id", F.array_join(
        F.transform(cut("html"), lambda x: F.concat(x["gap"], x["token"])), "").alias("whole")).collect()
    assert {r.page_id: r.whole for r in got} == dict(enumerate(htmls))


def test_pieces_hold_the_scanned_tokens(spark):
    df = _frame(spark, pages(7, 3000))
    got = df.select(F.filter(F.transform(H.dom_cut("html"), lambda x: x["token"]), lambda t: t != "").alias("a"),
                    H.dom_scan("html").alias("b"),
                    F.filter(F.transform(H.lexical_pieces("html"), lambda x: x["token"]), lambda t: t.endswith(">")).alias("c"),
                    H.lexical_tokens("html").alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)


@pytest.mark.parametrize("run", [
    lambda df: L.extract_links(df).count(), lambda df: L.extract_links_dom(df).count(),
    lambda df: RW.rewrite_links(df).select(F.length("html")).first()[0],
    lambda df: RW.rewrite_links_dom(df).select(F.length("html")).first()[0]], ids=["lnk1", "lnk2", "rw1", "rw2"])
def test_a_megabyte_of_tags_that_never_end(spark, run):
    """Four times the page may not take sixteen times as long; before, a megabyte took hours."""
    for unit in ("<a ", "<!--", "<script>", "<a <img ", '<a href="x" ', "<a '", '"<a ', "<style>"):
        df = _frame(spark, [unit * (1_000_000 // len(unit))])
        t0 = time.monotonic()
        run(df)
        assert time.monotonic() - t0 < 30, unit


def test_what_never_ends_takes_the_rest(spark):
    def links(html):
        return [(r.tag, r.raw_link) for r in L.extract_links_dom(_frame(spark, [html])).orderBy("pos").collect()]
    assert links('<a href="/1">x</a><!-- <a href="/2">') == [("a", "/1")]
    assert links('<a href="/1">x</a><script>var a; <a href="/2">') == [("a", "/1")]
    assert links('<a href="/1">x</a><a title="oops href="/2">y</a') == [("a", "/1")]
    assert links('<script src="/s.js"> <a href="/2">') == [("script", "/s.js")]


def test_every_named_reference(spark):
    from html.entities import html5
    names = sorted(k for k in html5 if k.endswith(";"))
    df = spark.createDataFrame([(n, f"a&{n}b") for n in names], "n string, v string")
    got = {r.n: r.d for r in df.select("n", H.decode_entities(F.col("v")).alias("d")).collect()}
    assert got == {n: f"a{html5[n]}b" for n in names}
