"""Nyström features from kernel values at landmarks."""

from __future__ import annotations

import numpy as np


def whitener(landmark_kernel: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """W with K(x, L) W the Nyström features of x: the inverse root of the landmarks' kernel matrix."""
    values, vectors = np.linalg.eigh((landmark_kernel + landmark_kernel.T) / 2 + ridge * np.eye(len(landmark_kernel)))
    return (vectors / np.sqrt(np.maximum(values, ridge))).astype(np.float64)


def logistic_fit(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """w, b of 1 / (1 + exp(-(x w + b))) for labels y, with Platt's smoothed targets; the ridge is on standardised columns."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mid, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.concatenate([(x - mid) / scale, np.ones((len(x), 1))], 1)
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - t) + penalty @ w)
    return w[:-1] / scale, float(w[-1] - (w[:-1] / scale) @ mid)
