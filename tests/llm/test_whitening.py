import math
import random

import numpy as np
import pandas as pd
import pytest
from common import SF
from docops.llm import whitening
from docops.llm.queries import op13_whitening
from docops.llm.whitening import fit, semidefinite_cholesky, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string"


def brute(rows, k=8):
    """{vec_id: (deviation, whitened)}, n, shares, from Python integers and numpy's eigh."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    n = len(kept)
    sums = [sum(c) for c in zip(*(x for _, x in kept))]
    y = np.array([[n * a - s for a, s in zip(x, sums)] for _, x in kept], dtype=object)
    dev = [int(sum(a * a for a in r)) for r in y]
    c = y.astype(float) / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    return n, [(i, d, (r @ w[:, :k]) / np.sqrt(e[:k])) for (i, _), d, r in zip(kept, dev, c)], e[:k] / e.sum()


def check(got, rows, k=8, at_most=1e-8):
    n, want, shares = brute(rows, k)
    assert {r.n for r in got} == {n} and len(got) == n * k
    assert all(r.identity_error <= 1e-4 for r in got) and len({r.identity_error for r in got}) == 1
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    for j in range(k):
        pairs = [(by[i][j + 1].whitened, w[j]) for i, _, w in want]
        sign = math.copysign(1, sum(a * b for a, b in pairs))
        assert max(abs(a - sign * b) for a, b in pairs) < at_most
    assert all(by[i][1].deviation == d for i, d, _ in want)
    assert all(abs(by[want[0][0]][j + 1].explained - shares[j]) <= 1e-9 for j in range(k))


def table(n=200, d=12, seed=1):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate((r.normal(size=(n, d)) * np.arange(1, d + 1) * 0.1 + 3).astype(np.float32))]


def test_query(spark):
    d = pd.read_parquet(f"{SF}/embeddings.parquet")
    check(op13_whitening(spark, SF).collect(), [(i, v.tolist()) for i, v in zip(d.vec_id, d.embedding)])


def test_odd_rows(spark):
    rows = table()
    odd = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [float("nan"), *rows[0][1][1:]]), (903, [float("inf"), *rows[0][1][1:]]), (904, []), (905, [-math.inf] * 12)]
    df = spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows + odd], SCHEMA)
    check(whiten(df).collect(), rows)
    other = df.unionByName(spark.createDataFrame([(906, [1.0, 2.0], 1, "", "")], SCHEMA))
    assert sorted(map(str, whiten(other).select("vec_id", "component", "n", "deviation").collect())) == sorted(map(str, whiten(df).select("vec_id", "component", "n", "deviation").collect()))


def test_repeats_and_rows_without_id(spark):
    rows = table(60, 9)
    df = spark.createDataFrame([(None if i < 5 else i // 2, v, 1, "", "") for i, v in rows], SCHEMA)
    got = whiten(df, 3).collect()
    n, want, _ = brute(rows, 3)
    assert len(got) == 180 and {r.n for r in got} == {60} and sum(r.vec_id is None for r in got) == 15
    assert sorted(r.deviation for r in got) == sorted(d for _, d, _ in want for _ in range(3))


def test_one_vector_for_a_third_of_the_rows(spark):
    rows = table(300, 10)
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    check(whiten(spark.createDataFrame([(i, v, 1, "", "") for i, v in rows], SCHEMA)).collect(), rows)


@pytest.mark.parametrize("seed", range(3))
def test_nearly_dependent_columns(spark, seed):
    """Columns that differ in a few units of a million: the shift, and more passes than two."""
    r = random.Random(seed)
    base = [[r.gauss(0, 1000) for _ in range(6)] for _ in range(400)]
    rows = [(i, [*b, *(x + r.gauss(0, 0.01) for x in b[:3])]) for i, b in enumerate(base)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, "", "") for i, v in rows], SCHEMA)
    model = fit(df)
    assert model.passes >= 3
    n, _, _ = brute(rows)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], np.int64)
    y = (len(x) * x - x.sum(0)) / len(x)
    values = np.linalg.svd(y, compute_uv=False) ** 2 / len(x)
    assert np.allclose(model.eigenvalues, values, rtol=1e-8)


def test_dependent_columns(spark):
    """Three columns twice and one constant: six components, and no more."""
    rows = [(i, [*v, *v[:3], 2.5]) for i, v in table(100, 6)]
    df = spark.createDataFrame([(i, v, 1, "", "") for i, v in rows], SCHEMA)
    model = fit(df)
    assert model.passes < whitening.PASSES
    got = whiten(df).collect()
    assert len(got) == 600 and all(r.identity_error < 1e-6 for r in got)
    check(whiten(df, 6).collect(), rows, 6)


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "", "") for i in range(4)], SCHEMA)
    assert whiten(same).collect() == [] and whiten(same.limit(0)).collect() == []
    one = whiten(spark.createDataFrame([(i, [1.0, float(i)], 1, "", "") for i in range(2)], SCHEMA)).collect()
    assert [r.component for r in one] == [1, 1] and sorted(round(r.whitened, 9) for r in one) == [-1, 1]


def test_what_does_not_fit(spark):
    with pytest.raises(Exception, match="does not fit"):
        whiten(spark.createDataFrame([(1, [1e30], 1, "", ""), (2, [1.0], 1, "", "")], SCHEMA)).collect()


def test_semidefinite():
    r = np.random.default_rng(0).normal(size=(5, 3))
    g = r @ r.T
    c = semidefinite_cholesky(g)
    assert np.allclose(c.T @ c, g)
