"""Link extraction in DOM mode takes a page apart once, and resolves only the links that are asked for."""

from sitegraph.operators import links as L
from sitegraph.plans import crawl as C

PAGE = ('<p><A href="b">x</a><script src="s.js">var a="<img src=no>";</script><img src=i.png><!-- <a href=c> -->'
        '<iframe src="f.html"></iframe><link rel="icon" href="fav.ico"><img alt="none"><link href="x"><a href="?q">y</a>'
        '<link rel="stylesheet" type="text/css" href="t.css"></p>')


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(html")


def pages(spark):
    return spark.createDataFrame([(1, "http://h/d/", PAGE), (2, "http://h/e", "<a href=z>"), (3, None, PAGE), (4, "http://h/", None)],
                                 "page_id bigint, url string, html string")


def test_one_scan_a_page(spark):
    assert scans(L.extract_links_dom(pages(spark), resolve=True)) == 1
    assert scans(C.rfc_link_table(pages(spark))) == 1


def test_resources_only_are_the_resources_of_all(spark):
    d = L.extract_links_dom(pages(spark), resolve=True)
    own = L.extract_links_dom(pages(spark), resolve=True, resources_only=True)
    assert own.columns == d.columns
    assert sorted(own.collect(), key=str) == sorted(L.split_pages_resources(d)[1].collect(), key=str)
    assert [(r.pos, r.raw_link) for r in own.where("page_id = 1").orderBy("pos").collect()] == [
        (3, "i.png"), (4, "s.js"), (5, "fav.ico"), (6, "t.css")]
