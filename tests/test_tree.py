"""The saved tree (SRC2) with a folder a page: who writes and who lists its files."""

from pyspark.sql import functions as F

from sitegraph.sinks import writers as W
from sitegraph.sources import readers as RD


def test_tree_holds_every_row(spark, tmp_path):
    rows = [("site=a/page_id=1", "<p>é</p>"), ("site=a/page_id=2", None), ("site=b/page_id=3", "x"),
            ("site=b/page_id=3", "x"), ("site=b/page_id=4", "")]
    df = spark.createDataFrame(rows, "folder string, html string")
    for root in (str(tmp_path / "plain"), f"file:{tmp_path}/uri"):
        assert W.write_tree(df, root, body="html", end=b"\x01") == 4
        saved = {r.save_path: bytes(r.body) for r in RD.read_archive(spark, root).collect()}
        assert saved == {"site=a/page_id=1/part-0": "<p>é</p>\x01".encode(), "site=a/page_id=2/part-0": b"\x01",
                         "site=b/page_id=3/part-0": b"x\x01x\x01", "site=b/page_id=4/part-0": b"\x01"}
    assert W.write_tree(df.limit(0), str(tmp_path / "none"), body="html") == 0


def test_tree_is_listed_by_few_tasks(spark, tmp_path):
    folders = spark.range(400).select(F.concat(F.lit("site=a/page_id="), "id").alias("folder"), F.lit("x").alias("body"))
    W.write_tree(folders, str(tmp_path / "tree"))
    sc = spark.sparkContext
    before = spark.conf.get(RD._LISTING)
    sc.setJobGroup("listing", "the tree's folders")
    try:
        saved = RD.read_archive(spark, str(tmp_path / "tree"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < sum(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * sc.defaultParallelism
    assert saved.count() == 400
    assert spark.conf.get(RD._LISTING) == before
