import math
import random

import numpy as np
import pytest

from sitegraph.llm import whitening as W
from sitegraph.llm.vectors import of_one_length, usable


def model_of(vectors):
    """Brute force: exact integers by definition, then eigh."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    z = [[n * r[k] - s[k] for k in range(d)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in z) / n ** 3 for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    return x, s, z, cov, values[::-1], axes[:, ::-1]


def rows(spark, vectors, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(vectors)), vectors)), "vec_id bigint, embedding array<float>")


def vectors(seed, n, d, scale=1.0):
    r = random.Random(seed)
    mix = [[r.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    out = []
    for _ in range(n):
        g = [r.gauss(0, scale) for _ in range(d)]
        out.append([float(np.float32(sum(a * b for a, b in zip(g, m)))) for m in mix])
    return out


@pytest.mark.parametrize("n,d,scale", [(300, 7, 1.0), (40, 3, 1e4), (25, 5, 2.0 ** 30)])
def test_equals_brute_force(spark, n, d, scale):
    given = vectors(n, n, d, scale)
    x, s, z, cov, values, axes = model_of(given)
    df, found = of_one_length(usable(rows(spark, given), "vec_id", "embedding"))
    model = W.fit(df, found)
    assert (model.n, model.sums) == (n, s)
    assert model.trace == pytest.approx(np.trace(cov), rel=1e-14)
    assert model.eigenvalues == pytest.approx(values, rel=1e-9)
    white = {r.id: r for r in W.whiten(df, d, model).collect()}
    for k in range(n):
        assert int(white[k].deviation) == sum(v * v for v in z[k])
        for c in range(d):
            want = sum(v * a for v, a in zip(z[k], axes[:, c])) / n / math.sqrt(values[c])
            sign = np.sign(model.components[:, c] @ axes[:, c])
            assert white[k].whitened[c] == pytest.approx(sign * want, rel=1e-6, abs=1e-6)
    assert W.identity_error(W.whiten(df, d, model), n, d) < 1e-6


def test_query_drops_unusable_vectors(spark, tmp_path):
    given = vectors(5, 60, 40)
    bad = [None, [], [1.0] * 39 + [None], [float("nan")] * 40, [float("inf")] * 40, [0.5] * 3, [1e30] * 40]
    df = rows(spark, given + bad + given[:3], [*range(60), *range(100, 107), 3, 3, None])
    df.selectExpr("*", "1 AS id", "'x' AS v", "0 AS n").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = W.op11_whitening(spark, str(tmp_path)).collect()
    assert {r.n for r in got} == {63} and {r.component for r in got} == set(range(1, 33))
    assert len(got) == 63 * 32 and {r.vec_id for r in got} == {*range(60), None}
    *_, z, cov, values, axes = model_of(given + given[:3])
    assert {r.deviation for r in got if r.vec_id == 7} == {sum(v * v for v in z[7])}
    shares = {r.component: r.explained for r in got}
    assert [shares[c] for c in range(1, 33)] == pytest.approx(list(values[:32] / np.trace(cov)), rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4


@pytest.mark.parametrize("given", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [None], [[]]])
def test_without_variance_there_are_no_components(spark, tmp_path, given):
    rows(spark, given).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert W.op11_whitening(spark, str(tmp_path)).collect() == []


def test_fewer_rows_than_dimensions(spark, tmp_path):
    rows(spark, vectors(9, 4, 10)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = W.op11_whitening(spark, str(tmp_path)).collect()
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-4
