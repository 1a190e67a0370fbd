"""File sources and sinks: round trips through real files."""

import os
import tempfile

from pyspark.sql import functions as F

from sitegraph.sinks import writers as W
from sitegraph.sources import readers as RD


def _tmp():
    return tempfile.mkdtemp(prefix="sg-io-")


def test_manifest_round_trip(spark):
    df = spark.createDataFrame([("HTML", "https://a.org/x"), ("IMAGE", "https://a.org/i.png")], "link_type string, url string")
    d = os.path.join(_tmp(), "m")
    W.write_manifest(df, d)
    extra = spark.createDataFrame([("NO",), ("  STYLE \t https://a.org/s.css  ",), ("",)], "value string")
    got = sorted(tuple(r) for r in RD.read_manifest(spark, d).unionByName(RD.parse_manifest_lines(extra)).collect())
    assert got == [("HTML", "https://a.org/x"), ("IMAGE", "https://a.org/i.png"), ("STYLE", "https://a.org/s.css")]


def test_seeds_and_url_list(spark):
    d = _tmp()
    with open(os.path.join(d, "seeds.txt"), "w") as f:
        f.write("https://b.org/\n\n  https://a.org/x  \n\n")
    seeds = RD.read_seeds(spark, os.path.join(d, "seeds.txt"))
    assert sorted(r.url for r in seeds.collect()) == ["https://a.org/x", "https://b.org/"]
    out = os.path.join(d, "urls")
    W.write_url_list(seeds.unionByName(seeds), out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert sorted(lines) == ["https://a.org/x", "https://b.org/"]


def test_archive_round_trip(spark):
    root = os.path.join(_tmp(), "arc")
    rows = spark.createDataFrame(
        [("a.org/x/index.html", "a.org/x/index.html", "a.org", "<p>1</p>"),
         ("b.org/index.html", "b.org/index.html", "b.org", "<p>2</p>")],
        "page_key string, save_path string, host string, body string")
    rows = rows.withColumn("fetched_at", F.current_timestamp())
    W.write_archive(rows, root)
    back = W.read_saved(spark, root)
    assert sorted(r.save_path for r in back.collect()) == ["a.org/x/index.html", "b.org/index.html"]
    # a saved file tree read back with its mtimes
    tree = _tmp()
    for rel, body in (("a.org/x/index.html", b"<p>1</p>"), ("b.org/s.css", b"p{}")):
        os.makedirs(os.path.dirname(os.path.join(tree, rel)), exist_ok=True)
        with open(os.path.join(tree, rel), "wb") as f:
            f.write(body)
    got = sorted((r.save_path, r.host, bytes(r.body)) for r in RD.read_archive(spark, tree).collect())
    assert got == [("a.org/x/index.html", "a.org", b"<p>1</p>"), ("b.org/s.css", "b.org", b"p{}")]


SCHEMA = "save_path string, host string, body string, fetched_at timestamp_ntz"


def _copies(spark, *rows):
    from datetime import datetime
    return spark.createDataFrame([(p, h, b, datetime(2024, 1, d)) for p, h, b, d in rows], SCHEMA)


def test_writes_merge_and_newest_wins(spark):
    root = os.path.join(_tmp(), "up")
    W.write_archive(_copies(spark, ("a.org/x", "a.org", "v1", 2), ("a.org/y", "a.org", "y1", 2), ("", "", "no host", 2)), root)
    W.write_archive(_copies(spark, ("a.org/x", "a.org", "v2", 3), ("a.org/y", "a.org", "old", 1), ("123/z", "123", "z1", 3),
                            ("123/z", "123", "z0", 2)), root)
    W.write_archive(_copies(spark), root)
    got = sorted(tuple(r)[:3] for r in W.read_saved(spark, root).collect())
    assert got == [("", "", "no host"), ("123/z", "123", "z1"), ("a.org/x", "a.org", "v2"), ("a.org/y", "a.org", "y1")]


def test_a_change_of_columns_is_refused_and_loses_nothing(spark):
    import pytest
    root = os.path.join(_tmp(), "up")
    first = _copies(spark, ("a.org/x", "a.org", "v1", 2))
    W.write_archive(first, root)
    with pytest.raises(ValueError):
        W.write_archive(first.withColumn("extra", F.lit(1)), root)
    with pytest.raises(ValueError):
        W.write_archive(first.withColumn("host", F.lit(1)), root)
    assert W.read_saved(spark, root).count() == 1
    other = _tmp()
    open(os.path.join(other, "file"), "w").close()
    with pytest.raises(ValueError):
        W.write_archive(first, other)


def test_the_number_of_buckets_stays_with_the_table(spark):
    root = os.path.join(_tmp(), "up")
    W.write_archive(_copies(spark, *[(f"a/{k}", "a", "1", 2) for k in range(50)]), root, buckets=4)
    W.write_archive(_copies(spark, *[(f"a/{k}", "a", "2", 3) for k in range(50)]), root, buckets=9)
    assert [r.body for r in W.read_saved(spark, root).collect()] == ["2"] * 50


def test_session_settings_stay(spark):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    W.write_archive(_copies(spark, ("a.org/x", "a.org", "v1", 2)), os.path.join(_tmp(), "up"))
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_archive_tree_with_a_relative_root(spark, monkeypatch):
    tree = _tmp()
    os.makedirs(os.path.join(tree, "out", "layout", "out"))
    with open(os.path.join(tree, "out", "layout", "out", "p.html"), "w") as f:
        f.write("x")
    assert [r.save_path for r in RD.read_archive(spark, f"{tree}/out/").collect()] == ["layout/out/p.html"]
