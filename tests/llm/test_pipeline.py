import corpus_pipeline
import pytest
from cases import CLASHES, prose
from pyspark.sql import functions as F
from test_decontaminate import brute as hits
from test_ngram_join import brute as components
from test_quality_rules import failed
from test_secrets import scan

import __spark_entry__
from sitegraph.llm import queries

HEX = "0123456789abcdef" * 2
ITEM = prose(70, 25)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [(k, prose(k, 40 + k % 30), "en", f"s{k % 3}") for k in range(60)]
    rows += [(100, rows[3][1], "en", "s0"), (101, rows[3][1] + " more", "fr", None), (102, prose(80, 30) + " " + ITEM, "en", "s1"),
             (103, prose(81, 30) + f' token = "{HEX}" ' + prose(82, 10), None, "s1"), (104, "too short", "en", "s1"),
             (105, None, "en", "s1"), (None, prose(83, 30), "en", "s2"), (106, "again and again " * 30, "en", "s2")]
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn(
        "n_chars", F.length("text").cast("bigint"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages_and_their_effects(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = [(d, t) for d, t, *_ in rows]
    expected = {
        "quality_rules": lambda x: [r for r in x if not failed(r[1])],
        "ngram_jaccard_join": lambda x: [r for r in x if r[0] is None or (r[0], r[0]) in {(d, c) for d, _, c in components(x)}],
        "benchmark_decontamination": lambda x: [r for r in x if not hits(r[1], [(1, ITEM)])[1]],
        "secret_scan": lambda x: x,
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        left = expected[name](left)
        assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted((d for d, _ in left), key=repr), name
        docs = out
    for r in docs.collect():
        assert not scan(r.text) and r.n_chars == len(r.text)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.collect()} == {d for d, _ in left}


def test_run_and_registration(spark, tables):
    folder, _ = tables
    assert corpus_pipeline.run(spark, folder).count() > 0
    names = __spark_entry__.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(names)
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_clashing_columns_and_empty_table(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, value in CLASHES.items():
        docs = docs.withColumn(name, F.lit(value))
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, folder)
            assert some.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, some, folder).collect()
