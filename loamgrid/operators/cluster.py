"""Community detection on landmark graphs (driver): constant Potts model with local moves and refinement."""

from __future__ import annotations

import numpy as np


def kmeans(x: np.ndarray, k: int, seed: int = 123, rounds: int = 50) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = [x[rng.integers(len(x))]]
    near = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < min(k, len(x)) and near.sum() > 0:
        centers.append(x[rng.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, ((x - centers[-1]) ** 2).sum(1))
    c = np.array(centers)
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        if (new == own).all():
            break
        own = new
        c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return own


def renumbered(label: np.ndarray) -> np.ndarray:
    """Numbers from 0 in order of first appearance."""
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def _moved(w: np.ndarray, size: np.ndarray, label: np.ndarray, gamma: float, rng, within: np.ndarray | None = None) -> np.ndarray:
    """Nodes go, one by one, where the quality sum(w in) - gamma * sizes gains most; only inside ``within`` where given."""
    label = label.copy()
    total = np.bincount(label, size, len(w))
    for _ in range(20):
        moves = 0
        for i in rng.permutation(len(w)):
            own = label[i]
            near = np.flatnonzero(w[i])
            near = near[near != i]
            if within is not None:
                near = near[within[near] == within[i]]
            if not len(near):
                continue
            pull = np.bincount(label[near], w[i, near], len(w))
            total[own] -= size[i]
            options = np.unique(np.append(label[near], own))
            gain = pull[options] - gamma * size[i] * total[options]
            best = options[int(np.argmax(gain))]
            if gain.max() <= gain[options == own][0] + 1e-12:
                best = own
            label[i] = best
            total[best] += size[i]
            moves += best != own
        if not moves:
            break
    return label


def communities(w: np.ndarray, resolution: float = 0.8, start: np.ndarray | None = None, rounds: int = 10, seed: int = 123) -> np.ndarray:
    """Labels of the nodes of a symmetric graph. The resolution is per thousand, as densities of graphs of this kind are small."""
    gamma = resolution * 1e-3
    w = np.array(w)
    np.fill_diagonal(w, 0)
    rng = np.random.default_rng(seed)
    label = np.arange(len(w)) if start is None else renumbered(start)
    for _ in range(rounds):
        before = label
        node = np.arange(len(w))  # of the original nodes, in the aggregated graph
        g, size = w, np.ones(len(w))
        own = label
        while True:
            own = renumbered(_moved(g, size, own, gamma, rng))
            fine = renumbered(_moved(g, size, np.arange(len(g)), gamma, rng, own))
            if fine.max() + 1 == len(g):
                break
            member = np.eye(fine.max() + 1, dtype=w.dtype)[fine]
            coarse = np.zeros(fine.max() + 1, int)
            coarse[fine] = own
            g, size, node = member.T @ g @ member, member.T @ size, fine[node]
            np.fill_diagonal(g, 0)
            own = renumbered(coarse)
        label = renumbered(own[node])
        if (label == before).all():
            break
    return label


def connectivity(w: np.ndarray, label: np.ndarray, clusters: int | None = None) -> np.ndarray:
    """Mean weight between the nodes of each two clusters, pairs without an edge and a node with itself included."""
    one = np.eye(clusters or int(label.max()) + 1)[label]
    size = one.sum(0)
    return one.T @ w @ one / np.maximum(np.outer(size, size), 1)


def absorbed(w: np.ndarray, label: np.ndarray, small: int = 3) -> np.ndarray:
    """Clusters of at most ``small`` nodes join the cluster of the largest mean connection; ties go to the lowest label."""
    label = renumbered(label)
    while True:
        sizes = np.bincount(label)
        weak = np.flatnonzero((sizes > 0) & (sizes <= small))
        if not len(weak) or (sizes > 0).sum() < 2:
            return renumbered(label)
        mean = connectivity(w, label, len(sizes))
        i = weak[np.argmin(sizes[weak])]
        mean[i, i] = -1
        mean[i, sizes == 0] = -1
        label = np.where(label == i, int(np.argmax(mean[i])), label)


def named(label: np.ndarray) -> list[str]:
    """cluster.01, cluster.02, ... with as many digits as the last needs."""
    label = renumbered(label)
    width = max(2, len(str(label.max() + 1)))
    return [f"cluster.{x + 1:0{width}d}" for x in label]
