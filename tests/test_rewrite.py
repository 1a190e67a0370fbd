import os

from pyspark.sql import functions as F

from sitegraph.operators import rewrite as RW

GOLDEN = os.path.join(os.path.dirname(__file__), "golden")


def _rw(spark, html, hint):
    df = spark.createDataFrame([(html, hint)], "html string, hint string")
    return df.select(RW.rewrite_html(F.col("html"), F.col("hint")).alias("o")).first().o


def test_golden_rewrite_whole_file(spark):
    src = open(os.path.join(GOLDEN, "orchard.html"), encoding="utf-8").read()
    exp = open(os.path.join(GOLDEN, "orchard.rewritten.html"), encoding="utf-8").read()
    got = _rw(spark, src, "./orchard.test/guide/trees/index.html")
    assert got == exp


def test_rewrite_is_idempotent(spark):
    src = open(os.path.join(GOLDEN, "orchard.html"), encoding="utf-8").read()
    once = _rw(spark, src, "./orchard.test/guide/trees/index.html")
    assert _rw(spark, once, "./orchard.test/guide/trees/index.html") == once


def test_rewrite_keeps_other_bytes(spark):
    html = 'x<a class="k" href="/a/b">t</a><a href="../keep">u</a><p>y</p><img src="i.png" alt="z">'
    got = _rw(spark, html, "./h.org/d/index.html")
    assert got == ('x<a class="k" href="../../h.org/a/b">t</a><a href="../keep">u</a><p>y</p>'
                   '<img src="../../h.org/d/i.png" alt="z">')
