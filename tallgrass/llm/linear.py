"""Linear models fitted by dual coordinate descent, and their calibration."""

from __future__ import annotations

import numpy as np


def hinge_dcd(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, c: np.ndarray, epochs: int = 20, tolerance: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model; rows are (indices, values), labels -1 or 1, c a cost per row."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norms = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, values = rows[i]
            if norms[i] == 0:
                continue
            gradient = labels[i] * float(w[at] @ values) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * labels[i] * values
                worst = max(worst, abs(new - alpha[i]) * norms[i])
                alpha[i] = new
        if worst < tolerance:
            break
    return w


def platt(margins: np.ndarray, labels: np.ndarray, steps: int = 60, share: float | None = None) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a * margin + b))), by Newton's method on smoothed targets.

    With ``share``, rows are weighted so that label 1 has that share of them.
    """
    n1, n0 = float((labels > 0).sum()), float((labels <= 0).sum())
    weight = np.ones(len(margins)) if share is None else np.where(labels > 0, share / max(1, n1), (1 - share) / max(1, n0)) * len(margins)
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(np.std(margins)) or 1.0
    x = np.stack([margins / scale, np.ones(len(margins))], 1)
    theta = np.array([1.0, np.log((weight[labels > 0].sum() + 1) / (weight[labels <= 0].sum() + 1))])

    def loss(t):
        z = x @ t
        return float(weight @ (np.logaddexp(0, z) - target * z)) + 1e-4 * float(t @ t)

    now = loss(theta)
    for _ in range(steps):
        p = sigmoid(x @ theta)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 2e-4 * np.eye(2), x.T @ (weight * (p - target)) + 2e-4 * theta)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > now:
            size /= 2
        theta = theta - size * step
        before, now = now, loss(theta)
        if before - now < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Coefficients, the constant last, of a ridge logistic regression by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(t):
        z = x @ t
        return float(weight @ (np.logaddexp(0, z) - y * z)) + 0.5 * float(penalty @ (t * t))

    theta = np.zeros(x.shape[1])
    now = loss(theta)
    for _ in range(steps):
        p = sigmoid(x @ theta)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(theta)), x.T @ (weight * (p - y)) + penalty * theta)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > now:
            size /= 2
        theta = theta - size * step
        before, now = now, loss(theta)
        if before - now < 1e-9:
            break
    return theta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
