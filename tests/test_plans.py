"""Physical-plan properties that matter at scale (read from explain output)."""

import os
import re

from pyspark.sql import functions as F

from sitegraph.operators import links as L

SF = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_one_shuffle_partial_agg_pruned_scan(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    q = L.manifest_counts(L.page_links(pages, scope="same"))
    plan = _plan(q)
    # only url and html are read; page_id is pruned
    assert re.search(r"ReadSchema: struct<url:string,html:string>", q._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert plan.count("hashpartitioning") == 1            # one shuffle, on (link_type, url)
    assert "partial_count" in plan                         # map-side combine before it
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "BroadcastExchange" not in plan


def test_filter_reaches_the_scan(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").filter(F.col("url").startswith("https://"))
    txt = L.page_links(pages, scope="same")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(url), StringStartsWith(url,https://)]" in txt


def test_resolution_not_duplicated_by_filter_pushdown(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plan = _plan(L.page_links(pages, scope="same"))
    # the per-link work sits in one generator; no Filter operator evaluates
    # the resolution (it would run twice: once to filter, once to project)
    filters = [line for line in plan.splitlines() if re.match(r"^[\s:+-]*\*?\s*\(?\d*\)?\s*Filter", line)]
    assert all("regexp" not in f for f in filters), filters
    assert plan.count("Generate") == 1


def test_no_broadcast_hints_or_python_udfs_in_library():
    """Outside the text operators, Python runs in one place: the state of the TTL stream."""
    bad = []
    for dirpath, dirs, files in os.walk(os.path.join(ROOT, "sitegraph")):
        dirs[:] = [d for d in dirs if d != "llm"]
        for f in files:
            if f.endswith(".py"):
                src = open(os.path.join(dirpath, f)).read()
                if re.search(r'F\.broadcast\(|\.hint\((?!"rebalance")|@udf|F\.udf\(|pandas_udf|arrow_udf|applyIn|mapIn|transformWithState'
                                 r'|localCheckpoint', src):
                    bad.append(f)
    assert bad == ["streams.py"]
