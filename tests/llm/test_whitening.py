import math

import numpy as np
import pytest

from ticketlens.llm import whitening as W


def brute(data, k):
    rows = [(i, v) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max((len(v) for _, v in rows), default=0)
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] + [100000] * (d - len(v)) for _, v in rows]
    n = len(rows)
    sums = [sum(r[j] for r in x) for j in range(d)]
    apart = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    c = np.array([[a - s / n for a, s in zip(r, sums)] for r in x])
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return [i for i, _ in rows], n, apart, e, c @ q / np.sqrt(e), e / np.trace(v)


def check(spark, data, k=8):
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, component string")
    got = W.whiten(df, k).collect()
    ids, n, apart, e, w, share = brute(data, k)
    k = len(e)
    assert len(got) == len(ids) * k
    at = {i: p for p, i in enumerate(ids)}
    sign = {}
    for r in got:
        p, j = at[r.vec_id], r.component - 1
        assert r.n == n and int(r.deviation) == apart[p]
        assert abs(r.explained - share[j]) <= 1e-10 * share[j]
        if abs(w[p, j]) > 1e-3:
            sign.setdefault(j, np.sign(r.whitened / w[p, j]))
        assert abs(r.whitened * sign.get(j, 1) - w[p, j]) < 1e-7
        assert r.identity_error < 1e-9


def spread(seed, n, d):
    rnd = np.random.default_rng(seed)
    scale = np.linspace(1, 3, d)
    return [(i, [float(x) for x in row]) for i, row in enumerate((rnd.standard_normal((n, d)) * scale / 8).astype(np.float32))]


def test_many_dimensions(spark):
    data = spread(1, 600, 48)
    data += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 48), (1003, [float("inf")] + [0.0] * 47), (1004, [0.5, 0.25]), (1005, [])]
    check(spark, data)


def test_few_dimensions_and_ties(spark):
    data = spread(2, 200, 5)
    data += [(500 + i, data[0][1]) for i in range(300)]  # copies
    check(spark, data)


def test_null_ids_stay_and_large_sums_are_exact(spark):
    data = [(None, [1000.0, -3.0]), (1, [-1e6, 5.0]), (2, [1e6, 2.0]), (3, [7.0, 1e6])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = W.whiten(df).collect()
    assert {r.vec_id for r in got} == {None, 1, 2, 3} and len(got) == 8
    x = [[math.floor(1024 * c) for c in v] for _, v in data]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * a - t) ** 2 for a, t in zip(r, s)) for (i, _), r in zip(data, x)}
    assert {r.vec_id: int(r.deviation) for r in got} == want


def test_no_variance_and_no_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, []), (2, [])]):
        got = W.whiten(make(rows))
        assert got.collect() == [] and got.columns[0] == "vec_id"
    line = W.whiten(make([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_too_large_entries_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        W.whiten(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("shape", ["flat", "steep", "low rank", "pairs"])
def test_leading_against_a_dense_solver(shape):
    d, k = 60, 8
    rnd = np.random.default_rng(3)
    q = np.linalg.qr(rnd.standard_normal((d, d)))[0]
    e = {"flat": np.linspace(1, 1.3, d)[::-1], "steep": 10.0 ** -np.arange(d) * 1e6, "low rank": np.r_[5.0, 4, 3, np.zeros(d - 3)],
         "pairs": np.repeat(np.linspace(1, 4, d // 2)[::-1], 2)}[shape]
    v = (q * e) @ q.T
    got, vectors, residual = W.leading(lambda x: v @ x, lambda: float(np.trace(v)), d, k)
    assert residual <= W.TOLERANCE * 10
    assert np.allclose(got, e[:k], rtol=0, atol=1e-12 * e[0])
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(v @ vectors - vectors * got).max() < 1e-11 * e[0]
