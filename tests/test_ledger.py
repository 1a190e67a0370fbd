"""The archive run with a ledger: broken off anywhere, repeated, and with changed tables."""

import pytest
from pyspark.sql import functions as F

from sitegraph.plans import archive as P
from sitegraph.plans import ledger as G
from sitegraph.sinks import writers as W
from sitegraph.streaming.streams import stream_folder

AS_OF = "2024-01-02 00:00:00"
PAGES = [(0, "https://s.org/", '<a href="/a">x</a><a href="/b/c.html">x</a><img src="/i.png"><a href="/none">x</a>'),
         (1, "https://s.org/a", '<a href="/">x</a>'), (2, "https://s.org/b/c.html", '<a href="../far">x</a>'),
         (3, "https://s.org/i.png", "bytes")]


def _tables(spark, pages=PAGES, held=()):
    corpus = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    archive = spark.createDataFrame([(k,) for k in held], "save_path string").withColumn(
        "fetched_at", F.to_timestamp_ntz(F.lit("2024-01-01 23:59:00")))
    return corpus.where("page_id = 0").select("url"), corpus, archive


def _run(spark, root, tables, **options):
    ledger = G.Ledger(spark, root)
    rows, missing = P.archive_run(ledger, *tables, AS_OF, depth=1, **options)
    return ledger.computed, sorted(map(tuple, rows.collect())), sorted(map(tuple, missing.collect()))


def _plain(tables):
    rows = P.archive_site(*tables, depth=1, as_of=AS_OF)
    missing = P.missing_fetches(P.fetch_plan(*tables, depth=1, as_of=AS_OF))
    return sorted(map(tuple, rows.collect())), sorted(map(tuple, missing.collect()))


def test_content_digest_ignores_order_and_counts_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None), (None, "b")], "k int, s string")
    one = G.content_digest(df)
    assert one == G.content_digest(df.repartition(7).orderBy(F.desc("s")))
    others = [df.distinct(), df.limit(0), df.withColumn("k", F.col("k").cast("bigint")), df.withColumnRenamed("s", "t"),
              df.select("s", "k"), df.fillna("", ["s"]), df.unionAll(df)]
    assert len({one, *map(G.content_digest, others)}) == 1 + len(others)


def test_a_second_run_computes_nothing(spark):
    tables, root = _tables(spark), stream_folder(spark, "ledger")
    first = _run(spark, root, tables)
    assert first[0] == ["manifest", "plan", "rows"]
    assert first[1:] == _plain(tables) and first[1] and first[2]
    again = _run(spark, root, (tables[0], tables[1].repartition(3), tables[2]))
    assert again == ([], *first[1:])


@pytest.mark.parametrize("broken", ["manifest", "plan", "rows"])
def test_a_run_broken_in_a_stage_is_taken_up(spark, broken, monkeypatch):
    tables, root = _tables(spark), stream_folder(spark, "ledger")
    finished = G.Ledger._finished

    class Lost(Exception):
        pass

    def lost(self, path):
        if f"/{broken}/" in path:  # what a writer leaves that was killed before it committed
            spark.range(3).write.parquet(path)
            marker = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
            marker.getFileSystem(spark._jsc.hadoopConfiguration()).delete(marker, False)
            raise Lost
        return finished(self, path)

    with monkeypatch.context() as m:
        m.setattr(G.Ledger, "_finished", lost)
        with pytest.raises(Lost):
            _run(spark, root, tables)
    stages = ["manifest", "plan", "rows"]
    assert _run(spark, root, tables) == (stages[stages.index(broken):], *_plain(tables))


def test_changed_tables_and_parameters_are_computed_anew(spark):
    tables, root = _tables(spark), stream_folder(spark, "ledger")
    _run(spark, root, tables)
    held = _tables(spark, held=["s.org/a/index.html"])  # a new archive: a new plan of the same crawl
    got = _run(spark, root, held)
    assert got == (["plan", "rows"], *_plain(held)) and got[1] != _plain(tables)[0]
    changed = _tables(spark, [*PAGES[:3], (3, "https://s.org/i.png", "other bytes")])
    assert _run(spark, root, changed) == (["manifest", "plan", "rows"], *_plain(changed))
    assert _run(spark, root, tables, force=True)[0] == ["plan", "rows"]
    assert _run(spark, root, tables)[0] == []


def test_empty_tables_and_the_rows_go_into_an_archive(spark):
    root = stream_folder(spark, "ledger")
    assert _run(spark, root, _tables(spark, []))[1:] == ([], [])
    table = stream_folder(spark, "ledger-table")
    rows, _ = P.archive_run(G.Ledger(spark, root), *_tables(spark), AS_OF, depth=1)
    W.write_archive(rows, table)
    assert W.read_saved(spark, table).count() == rows.count() == 4
