"""Distributed communities against the sequential ones: modularity, names, odd graphs."""

import itertools
import random

import pytest
from sequential_louvain import louvain_labels, modularity

from storyspark.operators import communities


def planted(groups, size, inner, outer, seed):
    rng = random.Random(seed)
    nodes = [(g, i) for g in range(groups) for i in range(size)]
    return [(g * size + i, h * size + j, float(rng.randint(1, 3))) for (g, i), (h, j) in itertools.combinations(nodes, 2) if rng.random() < (inner if g == h else outer)]


def ring(cliques, size):
    edges = [(c * size + i, c * size + j, 1.0) for c in range(cliques) for i, j in itertools.combinations(range(size), 2)]
    return edges + [(c * size, (c * size + size + 1) % (cliques * size), 1.0) for c in range(cliques)]


@pytest.mark.parametrize("edges", [planted(4, 12, 0.6, 0.05, 1), planted(3, 20, 0.3, 0.06, 2), ring(8, 5), [(i, i + 1, 1.0) for i in range(30)]], ids=["clear", "blurred", "ring", "path"])
def test_modularity_of_sequential(spark, edges):
    got = communities.louvain(spark.createDataFrame(edges, "a long, b long, w double")).collect()
    label = {r["node"]: r["community"] for r in got}
    a, b, w = zip(*edges)
    q = modularity(a, b, w, label)
    assert set(label) == {*a, *b} and abs(q - got[0]["modularity"]) < 1e-6
    assert q >= modularity(a, b, w, louvain_labels(a, b, w)) - 0.01
    assert all(min(n for n in label if label[n] == c) == c for c in set(label.values()))


def test_odd_graphs(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "a long, b long, w double")
    assert communities.louvain(df()).count() == 0 and communities.louvain(df((1, 2, 0.0), (None, 1, 1.0))).count() == 0
    assert sorted((r["node"], r["community"]) for r in communities.louvain(df((1, 2, 1.0), (1, 2, 1.0), (2, 1, 3.0))).collect()) == [(1, 1), (2, 1)]
    loops = {r["node"]: r["community"] for r in communities.louvain(df((1, 1, 5.0), (2, 2, 5.0), (1, 2, 0.1))).collect()}
    assert loops == {1: 1, 2: 2}
