import numpy as np
import pytest
from emberline.functions.kernel import bessel_i, choose_order, coefficients
from emberline.operators import heat


def graph(n, p, seed):
    rng = np.random.default_rng(seed)
    return [(i, j, 0.2 + rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < p]


def exact(n, edges, start, t):
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    d = w.sum(1)
    scale = np.divide(1, np.sqrt(d), out=np.zeros(n), where=d > 0)
    values, vectors = np.linalg.eigh(np.eye(n) - scale[:, None] * w * scale[None, :])
    s = np.zeros(n)
    for i, v in start:
        s[i] = v
    return vectors @ (np.exp(-t * values) * (vectors.T @ s))


@pytest.mark.parametrize("t", [0.5, 2.0, 16.0])
def test_field_is_the_matrix_exponential(spark, t):
    edges, start = graph(60, 0.08, 42), [(7, 1.0), (23, 0.5)]
    adj = heat.adjacency(spark.createDataFrame(edges, "a long, b long, w double"))
    field = heat.heat_field(adj, spark.createDataFrame(start, "i long, v double"), t)
    want = exact(60, edges, start, t)
    got = {r.i: r.v for r in field.collect()}
    assert max(abs(got.get(i, 0.0) - want[i]) for i in range(60)) < 1e-8


def test_joins_and_kernel_agree(spark):
    """Both paths have the same rows and values, in a graph of two parts with a seed outside of either; vectors that are
    extended are those made at once."""
    edges = [*graph(30, 0.15, 7), *((100 + a, 100 + b, w) for a, b, w in graph(8, 0.5, 9))]
    adj = heat.adjacency(spark.createDataFrame(edges, "a long, b long, w double")).cache()
    seeds = spark.createDataFrame([(3, 1.0), (500, 0.5)], "i long, v double")
    rows = lambda df: {tuple(r)[:-1]: r.v for r in df.collect()}
    same = lambda x, y: x.keys() == y.keys() and all(abs(v - y[k]) < 1e-12 for k, v in x.items())
    small, large = (rows(heat.heat_field(adj, seeds, 1.0, 8, kernel_entries=n)) for n in (10**6, 0))
    assert same(small, large) and len(small) == adj.select("i").distinct().count() + 1
    whole = rows(heat.chebyshev(adj, seeds, 8))
    for entries in (10**6, 0):
        kept = heat.Vectors(adj, seeds, entries)
        for order in (0, 1, 2, 5, 8):
            kept.extend(order)
            assert same(rows(kept.table()), {k: v for k, v in whole.items() if k[0] <= order})
        assert same(rows(kept.field(1.0, 8)), small)


def test_isolated_seed_keeps_the_arithmetic(spark):
    adj = heat.adjacency(spark.createDataFrame([(1, 2, 1.0)], "a long, b long, w double"))
    field = heat.heat_field(adj, spark.createDataFrame([(9, 1.0)], "i long, v double"), 2.0)
    # a node without edges has M = 0: odd orders vanish, even ones alternate
    v = {r.i: r.v for r in field.collect()}[9]
    assert abs(v - sum(c * (0 if k % 2 else (-1) ** (k // 2)) for k, c in enumerate(coefficients(2.0)))) < 1e-12


def test_loops_and_parallel_edges(spark):
    e = spark.createDataFrame([(1, 1, 9.0), (1, 2, 0.5), (2, 1, 0.7)], "a long, b long, w double")
    assert sorted(map(tuple, heat.adjacency(e).collect())) == [(1, 2, 0.7), (2, 1, 0.7)]


def test_bessel_constants():
    assert abs(bessel_i(0, 3) - 4.880792585865) < 1e-9
    assert abs(bessel_i(1, 3) - 3.953370217403) < 1e-9
    assert abs(bessel_i(5, 10) - 777.188286403) < 1e-6
    assert [choose_order(t) for t in (2, 4, 16)] == [21, 25, 52]
