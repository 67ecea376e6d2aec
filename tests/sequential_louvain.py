"""Louvain communities of one small graph, node after node: the measure for the distributed ones."""

import numpy as np


def modularity(a, b, w, label: dict) -> float:
    m = float(np.sum(w))
    inside = sum(x for p, q, x in zip(a, b, w) if label[p] == label[q]) / m
    strength: dict = {}
    for p, q, x in zip(a, b, w):
        for n in (p, q):
            strength[label[n]] = strength.get(label[n], 0.0) + x
    return inside - sum((s / (2 * m)) ** 2 for s in strength.values())


def louvain_labels(a, b, w) -> dict:
    """Communities of one graph by greedy modularity moves, level by level, nodes in order (so the result is fixed)."""
    nodes = sorted({*a, *b})
    where = {n: n for n in nodes}
    adj: dict = {n: {} for n in nodes}
    for p, q, x in zip(a, b, w):
        adj[p][q] = adj[p].get(q, 0.0) + x
        adj[q][p] = adj[q].get(p, 0.0) + x
    m2 = sum(sum(v.values()) for v in adj.values())
    while True:
        label = {n: n for n in adj}
        degree = {n: sum(v.values()) for n, v in adj.items()}
        total = dict(degree)
        moved, any_move = True, False
        while moved:
            moved = False
            for n in sorted(adj):
                own = label[n]
                total[own] -= degree[n]
                gain: dict = {own: 0.0}
                for k, x in adj[n].items():
                    if k != n:
                        gain[label[k]] = gain.get(label[k], 0.0) + x
                best = max(sorted(gain), key=lambda c: (gain[c] - total[c] * degree[n] / m2 + (1e-12 if c == own else 0)))
                total[best] += degree[n]
                if best != own:
                    label[n], moved, any_move = best, True, True
        if not any_move:
            return where
        where = {n: label[c] for n, c in where.items()}
        grown: dict = {c: {} for c in set(label.values())}
        for n, v in adj.items():
            for k, x in v.items():
                grown[label[n]][label[k]] = grown[label[n]].get(label[k], 0.0) + x
        adj = grown
