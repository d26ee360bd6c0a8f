"""Whitening against a dense eigendecomposition and exact integer sums."""

import math

import numpy as np
import pytest


def brute(rows, components=16):
    """{(id, position): [(component, n, deviation, whitened, explained)]} by NumPy and Python integers."""
    use = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 2.0 ** 46 for c in v)]
    sizes = [len(v) for _, v in use]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d))
    use = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in use if len(v) == dim]
    fit = sorted({tuple(x) for _, x in use})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * x - t) / n for x, t in zip(v, s)] for v in fit])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = []
    for i, x in use:
        y = np.array([(n * a - t) / n for a, t in zip(x, s)])
        out.append((i, n, sum((n * a - t) ** 2 for a, t in zip(x, s)), y @ u / np.sqrt(e), e / np.trace(cov)))
    return out, e


def check(got, rows, components=16):
    want, e = brute(rows, components)
    k = len(e)
    assert len(got) == k * len(want)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    sign = None
    for i, n, away, z, share in want:
        mine = [by[(i, away)][c + 1][0] for c in range(k)]
        w = np.array([r["whitened"] for r in mine])
        if sign is None and (np.abs(z) > 1e-3).all():
            sign = np.sign(w * z)
        assert {r["n"] for r in mine} == {n}
        assert np.allclose([r["explained"] for r in mine], share, rtol=1e-6)
        assert np.abs(np.abs(w) - np.abs(z)).max() < 1e-8
        if sign is not None:
            assert np.abs(w - sign * z).max() < 1e-8
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1


def table_of(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, "clash", 3) for i, v in rows],
                                 f"vec_id long, embedding array<{kind}>, label int, x string, id int")


def test_odd_rows(spark):
    from flowforge.llm.whitening import whiten
    r = np.random.default_rng(4)
    base = (r.standard_normal((300, 20)) * np.linspace(3, 0.4, 20)).astype(np.float32).tolist()
    rows = list(enumerate(base)) + [(1000 + i, base[7]) for i in range(500)]  # a hot vector
    rows += [(5, base[5]), (5, base[6]), (None, base[8]), (2000, None), (2001, []), (2002, base[1][:5]),
             (2003, [None] + base[1][1:]), (2004, [math.nan] + base[1][1:]), (2005, [math.inf] + base[1][1:]),
             (2006, [3e38] + base[1][1:]), (2007, base[0][:5])]
    df = table_of(spark, rows).repartition(7)
    check(whiten(df).collect(), [(i, v) for i, v in rows])
    assert whiten(df.limit(0)).count() == 0
    assert whiten(table_of(spark, [(1, base[0]), (2, base[0]), (3, None)])).count() == 0  # nothing varies
    assert whiten(table_of(spark, [(1, None)])).count() == 0


@pytest.mark.parametrize("dim,n", [(1, 40), (2, 30), (5, 60), (40, 12)])
def test_few_dimensions_and_low_rank(spark, dim, n):
    from flowforge.llm.whitening import whiten
    r = np.random.default_rng(dim)
    x = (r.standard_normal((n, dim)) * np.linspace(5, 1, dim)).tolist()
    got = whiten(table_of(spark, list(enumerate(x)), "double")).collect()
    k = min(16, dim, n - 1)  # centred vectors have rank n - 1 at most
    assert {r["component"] for r in got} == set(range(1, k + 1))
    check(got, list(enumerate(x)), k)


def test_query_on_test_data(spark):
    from flowforge.llm.queries import op12_embedding_whitening
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op12_embedding_whitening(spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), rows)


@pytest.mark.parametrize("spectrum", ["flat", "steep", "pairs", "clustered"])
def test_solver(spectrum):
    """Residuals reach double precision in a space far smaller than the dimension."""
    from flowforge.llm.whitening import jacobi_davidson
    dim = 400
    e = {"flat": np.linspace(1, 2, dim), "steep": 10.0 ** np.linspace(-9, 4, dim),
         "pairs": np.repeat(np.linspace(1, 50, dim // 2), 2), "clustered": 1 + 1e-7 * np.arange(dim)}[spectrum]
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((dim, dim)))[0]
    v = (q * e) @ q.T
    calls = []
    got, u, residual = jacobi_davidson(lambda b: calls.append(b.shape[1]) or v @ b, dim, 16)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    assert np.abs(got - want).max() <= 1e-12 * want[0]
    assert residual.max() <= 1e-12 * want[0]
    assert np.abs(u.T @ u - np.eye(16)).max() < 1e-13
    print(spectrum, len(calls))


def test_minres_solves_the_projected_equation():
    from flowforge.llm.whitening import minres
    r = np.random.default_rng(3)
    a = r.standard_normal((30, 30))
    a = a + a.T
    off = np.linalg.qr(r.standard_normal((30, 4)))[0]
    p = np.eye(30) - off @ off.T
    rhs, shifts = p @ r.standard_normal((30, 3)), np.array([0.3, -1.0, 2.5])
    t = minres(lambda b: a @ b, shifts, off, rhs, 60, 1e-13)
    for j in range(3):
        assert np.abs(p @ (a - shifts[j] * np.eye(30)) @ p @ t[:, j] - rhs[:, j]).max() < 1e-9
