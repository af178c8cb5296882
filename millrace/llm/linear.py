"""Small linear models in numpy, fitted in the dual over a bounded sample of labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def gram(x: np.ndarray, bias: float = 1.0) -> np.ndarray:
    """Inner products of the rows, with a constant feature of size `bias`."""
    return (x @ x.T).astype(np.float64) + bias


def logistic_dual(k: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float, steps: int = 25) -> np.ndarray:
    """Row weights `alpha` of the L2-regularised logistic regression with inner products `k`; the margin of
    a new row is the sum of alpha times its inner products. Newton steps, damped."""
    n = len(target)
    alpha, f = np.zeros(n), np.zeros(n)

    def loss(f: np.ndarray, alpha: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0.0, np.where(target > 0.5, -f, f)) + 0.5 * l2 * alpha @ f)

    now = loss(f, alpha)
    for _ in range(steps):
        p = sigmoid(f)
        d = np.maximum(weight * p * (1 - p), 1e-6)
        z = f + weight * (target - p) / d
        step = np.linalg.solve(k + np.diag(l2 / d), z) - alpha
        size = 1.0
        while size > 1e-3:
            tried = alpha + size * step
            g = k @ tried
            if (after := loss(g, tried)) <= now:
                break
            size /= 2
        else:
            break
        done = now - after < 1e-7 * max(1.0, now)
        alpha, f, now = tried, g, after
        if done:
            break
    return alpha


def logistic_primal(x: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float, steps: int = 40) -> np.ndarray:
    """Weights of the same regression where features are fewer than rows. The last column of `x` is the
    constant; it is penalised like the rest."""
    theta = np.zeros(x.shape[1])

    def loss(theta: np.ndarray) -> float:
        f = x @ theta
        return float(weight @ np.logaddexp(0.0, np.where(target > 0.5, -f, f)) + 0.5 * l2 * theta @ theta)

    now = loss(theta)
    for _ in range(steps):
        p = sigmoid(x @ theta)
        gradient = x.T @ (weight * (p - target)) + l2 * theta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + l2 * np.eye(len(theta))
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-4 and (after := loss(theta - size * step)) > now:
            size /= 2
        if size <= 1e-4:
            break
        theta, done, now = theta - size * step, now - after < 1e-8 * max(1.0, now), after
        if done:
            break
    return theta


def hinge_dual(k: np.ndarray, sign: np.ndarray, cost: np.ndarray, epochs: int = 60, seed: int = 7) -> np.ndarray:
    """Row weights of the linear support vector machine with hinge loss, by dual coordinate descent: one
    dual variable at a time moves to its best value in [0, cost]."""
    n = len(sign)
    a, f = np.zeros(n), np.zeros(n)
    diagonal = np.maximum(np.diag(k), 1e-9)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            new = min(max(a[i] - (sign[i] * f[i] - 1.0) / diagonal[i], 0.0), cost[i])
            if (change := new - a[i]) != 0.0:
                a[i] = new
                f += (change * sign[i]) * k[i]
                moved = max(moved, abs(change) * diagonal[i])
        if moved < 1e-3:
            break
    return a * sign


def folds_of(target: np.ndarray, folds: int, seed: int = 11) -> np.ndarray:
    """A fold for each row, near equal in size and in each value's rows, fixed by the seed."""
    mixed = np.random.default_rng(seed).permutation(len(target))
    order = mixed[np.argsort(np.asarray(target)[mixed], kind="stable")]
    fold = np.zeros(len(target), np.int64)
    fold[order] = np.arange(len(target)) % folds
    return fold


def out_of_fold(k: np.ndarray, fold: np.ndarray, fit) -> np.ndarray:
    """Margins of each row by the model fitted without the row's fold; `fit(rows)` gives row weights."""
    margin = np.zeros(len(fold))
    for held in np.unique(fold):
        rows, rest = np.flatnonzero(fold != held), np.flatnonzero(fold == held)
        margin[rest] = k[np.ix_(rest, rows)] @ fit(rows)
    return margin


@dataclass(frozen=True)
class Calibration:
    """Probability = sigmoid(slope * margin + offset)."""

    slope: float
    offset: float

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * np.asarray(margin, dtype=np.float64) + self.offset)


#: Least slope of a calibration, per standard deviation of the margins: a greater margin is always likelier.
LEAST_SLOPE = 0.1


def calibrate(margin: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 60) -> Calibration:
    """Platt scaling with smoothed targets: a two-parameter logistic regression of label on margin. Where a label has
    so few rows that their margins out of fold say nothing, the slope is the least one."""
    up, down = float(weight @ target), float(weight @ (1 - target))
    goal = np.where(target > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(float(np.std(margin)), 1e-9)
    x = np.column_stack([margin / scale, np.ones_like(margin)])
    theta = np.array([1.0, np.log((up + 1) / (down + 1))])
    for _ in range(steps):
        p = sigmoid(x @ theta)
        gradient = x.T @ (weight * (p - goal)) + 1e-3 * theta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        change = np.linalg.solve(curve, gradient)
        theta = theta - np.clip(change, -2.0, 2.0)
        if np.abs(change).max() < 1e-8:
            break
    return Calibration(max(float(theta[0]), LEAST_SLOPE) / scale, float(theta[1]))
