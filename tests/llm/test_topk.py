import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegraph.llm import topk as T


def brute(rows, k=5, every=50):
    """Each query row against all other rows, exactly."""
    lengths = {}
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    for _, v in good:
        lengths[len(v)] = lengths.get(len(v), 0) + 1
    d = max(lengths, key=lambda n: (lengths[n], n))
    good = [g for g in good if len(g[1]) == d]
    out = []
    for a, (i, q) in enumerate(good):
        if i is None or i % every:
            continue
        best = sorted(((-sum(x * y for x, y in zip(q, v)), j is None, j or 0, j)
                       for b, (j, v) in enumerate(good) if b != a))[:k]
        out += [(i, n + 1, x[3], -x[0]) for n, x in enumerate(best)]
    return sorted(out, key=repr)


def run(spark, rows, every=50, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr(
        "*", "1 AS id", "2 AS node", "'x' AS v", "0 AS block")
    got = T.top_k(df, F.col("id") % every == 0, **options)
    return sorted([(r.query_id, r.rank, r.id, r.score) for r in got.collect()], key=repr)


def random_rows(seed, n, d, spread=0.2):
    r = random.Random(seed)
    return [(k, [r.gauss(0, spread) for _ in range(d)]) for k in range(n)]


@pytest.mark.parametrize("n,d", [(700, 16), (3, 4), (1, 2), (90, 1)])
def test_equals_brute_force(spark, n, d):
    rows = random_rows(n, n, d)
    assert run(spark, rows) == brute(rows)


def test_copies_ties_nulls_and_odd_vectors(spark):
    rows = random_rows(4, 160, 6)
    hot = rows[10][1]
    rows += [(k, hot) for k in range(200, 330)]                  # a group of copies
    rows += [(50, hot), (50, hot), (100, rows[3][1])]            # an id on several rows
    rows += [(None, hot), (None, rows[5][1]), (400, None), (450, [1.0, None] * 3), (500, [math.nan] * 6),
             (550, [math.inf] * 6), (600, [0.5]), (650, []), (-50, [0.0] * 6), (700, [900.0] * 6)]
    assert run(spark, rows, every=10) == brute(rows, every=10)


def test_blocks_and_outliers(spark, monkeypatch):
    monkeypatch.setattr(T, "LEAST_ROWS", 50)
    monkeypatch.setattr(T, "SAMPLE", 64)
    rows = random_rows(8, 600, 5) + [(1000, [1e6, -1e6, 3.0, 0.0, 1.0]), (1050, [-1e6, 1e6, 3.0, 0.0, 1.0])]
    assert run(spark, rows, every=25, k=3) == brute(rows, k=3, every=25)


def test_empty(spark):
    assert run(spark, []) == run(spark, [(0, None)]) == run(spark, [(0, [])]) == []


def test_few_vectors_are_read(spark, tmp_path):
    """The bounds leave a small share of all pairs."""
    from sitegraph.llm.common import Scratch
    from sitegraph.llm.vectors import of_one_length, usable
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors, d = of_one_length(usable(df, "vec_id", "embedding"))
    scratch = Scratch(spark, "test-topk")
    nodes, _ = T.distinct_vectors(vectors, d, 5, scratch)
    edges = T.borders(nodes, d)
    found = T.scan(T.approximations(nodes, edges), nodes.limit(50).select("node", "v"), edges, 6, 1)
    assert found.where("node IS NOT NULL").count() < 50 * nodes.count() * 0.1
