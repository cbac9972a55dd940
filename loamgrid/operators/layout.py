"""A layout of the landmark graph in two dimensions (driver, landmark-sized)."""

from __future__ import annotations

import numpy as np

#: Fixed curve of the pull 1 / (1 + A d^(2 B)), for a least distance of 0.1.
A, B = 1.577, 0.895


def two_dimensional(w: np.ndarray, start: np.ndarray, epochs: int = 500, seed: int = 123, negatives: int = 5, rate: float = 1.0) -> np.ndarray:
    """Coordinates of the nodes of a symmetric fuzzy graph: edges pull in proportion to their weight, random pairs push.

    All edges of an epoch move together, an edge of weight w in a share w / max w of the epochs.
    """
    n = len(w)
    src, dst = np.nonzero(np.triu(w, 1))
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 2))
    x[:, : start.shape[1]] = start[:, :2]
    x = 10 * (x - x.min(0)) / np.maximum(np.ptp(x, axis=0), 1e-12) + rng.normal(0, 1e-4, (n, 2))
    if not len(src):
        return x
    often = w[src, dst] / w[src, dst].max()
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        live = rng.random(len(src)) < often
        a, b = src[live], dst[live]
        gap = x[a] - x[b]
        d2 = (gap * gap).sum(1)
        pull = -2 * A * B * np.maximum(d2, 1e-12) ** (B - 1) / (1 + A * d2**B)
        move = np.clip(pull[:, None] * gap, -4, 4)
        shift = np.zeros_like(x)
        np.add.at(shift, a, move)
        np.add.at(shift, b, -move)
        a = np.repeat(np.r_[a, b], negatives)
        b = rng.integers(0, n, len(a))
        gap = x[a] - x[b]
        d2 = (gap * gap).sum(1)
        push = np.where(a == b, 0, 2 * B / ((0.001 + d2) * (1 + A * d2**B)))
        np.add.at(shift, a, np.clip(push[:, None] * gap, -4, 4))
        x += step * np.clip(shift, -4, 4)
    return x
