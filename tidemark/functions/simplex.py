"""Nearest point to the origin in a convex hull (Wolfe 1976): the small solve behind donor weights."""

from __future__ import annotations

import numpy as np


def nearest_in_hull(points: np.ndarray, tol: float = 1e-12, rounds: int = 10_000) -> np.ndarray:
    """Weights (>= 0, sum 1) of the rows of ``points`` whose combination has the smallest norm."""
    return hull_weights(points, tol, rounds)[0]


def hull_weights(points: np.ndarray, tol: float = 1e-12, rounds: int = 10_000) -> tuple[np.ndarray, bool]:
    """The weights of ``nearest_in_hull``, and whether the search ended by itself within ``rounds``."""
    count = len(points)
    scale = np.abs(points).max() or 1.0
    p = points / scale
    gram = p @ p.T
    start = int(np.argmin(np.diag(gram)))
    members, weights, settled = [start], np.array([1.0]), False
    for _ in range(rounds):
        slope = gram[:, members] @ weights
        norm = float(weights @ slope[members])
        best = int(np.argmin(slope))
        if slope[best] >= norm - tol * max(1.0, float(np.diag(gram).max())) or best in members:
            settled = True
            break
        members.append(best)
        weights = np.append(weights, 0.0)
        while True:
            size = len(members)
            kkt = np.zeros((size + 1, size + 1))
            kkt[1:, 1:] = gram[np.ix_(members, members)]
            kkt[0, 1:] = kkt[1:, 0] = 1.0
            affine = np.linalg.lstsq(kkt, np.eye(1, size + 1)[0], rcond=None)[0][1:]
            if affine.min() > 0:
                weights = affine
                break
            shrinking = affine <= 0
            reach = weights[shrinking] / np.maximum(weights[shrinking] - affine[shrinking], 1e-300)
            step = float(min(1.0, reach.min()))
            weights = weights + step * (affine - weights)
            keep = weights > 1e-14
            if keep.all():
                keep[np.argmin(np.where(shrinking, weights, np.inf))] = False
            members = [m for m, kept in zip(members, keep, strict=True) if kept]
            weights = weights[keep]
    out = np.zeros(count)
    out[members] = weights / weights.sum()
    return out, settled
