import math

import numpy as np
import pytest

from sparkloom.operators import graph
from sparkloom.tensor import from_numpy

DAG = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 4), (4, 5), (5, 3)]
K4 = [(i, j) for i in range(4) for j in range(i)]


def adjacency(spark, n, edges, symmetric=False, fill=0.0):
    a = np.full((n, n), fill)
    for i, j in edges:
        a[i, j] = 1.0
        if symmetric:
            a[j, i] = 1.0
    return from_numpy(spark, a, fill)


def test_bfs(spark):
    assert list(graph.bfs_levels(adjacency(spark, 6, DAG), 0).to_numpy()) == [1, 2, 2, 3, 3, 4]
    assert list(graph.bfs_levels(adjacency(spark, 4, [(0, 1), (2, 3)]), 0).to_numpy()) == [1, 2, 0, 0]


def test_closure_and_strong_components(spark):
    reach = graph.closure(adjacency(spark, 6, DAG)).to_numpy()
    assert ["".join(str(int(x)) for x in row) for row in reach] == ["111111", "011111", "001111", "000100", "000111", "000101"]
    edges = [(0, 1), (1, 2), (1, 4), (1, 5), (2, 3), (2, 6), (3, 2), (3, 7), (4, 0), (4, 5), (5, 6), (6, 5), (6, 7), (7, 7)]
    assert list(graph.strong_components(adjacency(spark, 8, edges)).to_numpy()) == [0, 0, 2, 2, 0, 5, 5, 7]


@pytest.mark.parametrize("n,edges,want", [(5, [], [0, 1, 2, 3, 4]), (4, [(0, 1), (2, 3)], [0, 0, 2, 2]), (5, [(0, 1), (1, 2), (2, 3), (3, 4)], [0] * 5), (5, [(0, 1), (1, 2)], [0, 0, 0, 3, 4])])
def test_components(spark, n, edges, want):
    assert list(graph.components(adjacency(spark, n, edges, True)).to_numpy()) == want


def test_shortest_paths(spark):
    assert list(graph.bellman_ford(adjacency(spark, 6, DAG, fill=math.inf), 0).to_numpy()) == [0, 1, 1, 2, 2, 3]
    d = graph.all_pairs(adjacency(spark, 6, DAG, True, math.inf)).to_numpy()
    assert (d == d.T).all() and list(d[0]) == [0, 1, 1, 2, 2, 3]


def test_reduction(spark):
    for w, gone in ((30, True), (15, False), (20, True)):
        a = np.array([[np.inf, 10, w], [np.inf, np.inf, 10], [np.inf] * 3])
        assert math.isinf(graph.transitive_reduction(from_numpy(spark, a, np.inf)).to_numpy()[0, 2]) is gone


def test_pagerank(spark):
    r = np.random.default_rng(1)
    a = r.random((7, 7)) * (r.random((7, 7)) < 0.3)
    out = a.sum(0)
    m = np.where(out > 0, a / np.where(out > 0, out, 1), 1 / 7)
    x = np.full(7, 1 / 7)
    for _ in range(100):
        y = 0.85 * m @ x + 0.15 / 7
        if np.linalg.norm(y - x) < 1e-8:
            break
        x = y
    assert np.allclose(graph.pagerank(from_numpy(spark, a)).to_numpy(), x, atol=1e-9)


def test_centrality_and_cliques(spark):
    assert list(graph.betweenness(adjacency(spark, 5, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)])).to_numpy()) == [0, 1, 1, 3, 0]
    a = adjacency(spark, 5, [*K4, (4, 1), (4, 2), (4, 3)], True)
    assert (graph.triangles(a), graph.four_cliques(a)) == (7.0, 2.0)


def test_markov_clustering(spark):
    a = adjacency(spark, 8, [(c, c + k) for c in (0, 4) for k in (1, 2, 3)], True)
    clusters = graph.mcl_clusters(graph.markov_clustering(a)).toPandas()
    assert clusters.groupby("cluster")["vertex"].apply(sorted).tolist() == [[0, 1, 2, 3], [4, 5, 6, 7]]
