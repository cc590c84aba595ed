"""Logistic regression in numpy, for bounded samples on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method; without both classes only the constant is set."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    share = (y @ weight + 0.5) / (weight.sum() + 1.0)
    beta[-1] = logit(np.array(share))
    if len(np.unique(y > 0.5)) < 2:
        return beta
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6

    def loss(b):
        z = x @ b
        return weight @ (np.logaddexp(0, z) - y * z) + 0.5 * penalty @ b**2

    now = loss(beta)
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        gradient = x.T @ (weight * (p - y)) + penalty * beta
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        rate = 1.0
        while rate > 1e-4 and loss(beta - rate * step) > now:
            rate /= 2
        new = loss(beta - rate * step)
        if rate <= 1e-4 or now - new < 1e-7 * max(1.0, abs(now)):
            break
        beta, now = beta - rate * step, new
    return beta


def predict_dense(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return sigmoid(x @ beta[:-1] + beta[-1])


class Sparse:
    """Rows of binary features: columns of row i are ids[bounds[i] : bounds[i + 1]]; extra columns are dense."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, width: int, extra: np.ndarray | None = None):
        self.ids, self.bounds, self.width = ids, bounds, width
        self.row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.extra = np.empty((len(bounds) - 1, 0)) if extra is None else extra

    def take(self, rows: np.ndarray) -> Sparse:
        counts = np.diff(self.bounds)[rows]
        bounds = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts) + np.repeat(self.bounds[rows], counts)
        return Sparse(self.ids[at], bounds, self.width, self.extra[rows])

    def times(self, beta: np.ndarray) -> np.ndarray:
        z = np.bincount(self.row, beta[self.ids], len(self.bounds) - 1)
        return z + self.extra @ beta[self.width : -1] + beta[-1]

    def transposed(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.ids, v[self.row], self.width), self.extra.T @ v, [v.sum()]))


def fit_sparse(x: Sparse, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, rounds: int = 150) -> np.ndarray:
    """Weights, the last for the constant, by accelerated gradient steps scaled by each column's curvature."""
    size = x.width + x.extra.shape[1] + 1
    beta = np.zeros(size)
    beta[-1] = logit(np.array((y @ weight + 0.5) / (weight.sum() + 1.0)))
    if len(np.unique(y)) < 2:
        return beta
    penalty = np.full(size, l2)
    penalty[-1] = 1e-6
    # an upper bound of the curvature, by diagonal dominance: each row's weight times its row sum
    row_sum = np.diff(x.bounds) + np.abs(x.extra).sum(1) + 1.0
    bound = 0.25 * np.concatenate((np.bincount(x.ids, (weight * row_sum)[x.row], x.width), np.abs(x.extra).T @ (weight * row_sum), [weight @ row_sum])) + penalty
    ahead, before, t = beta.copy(), beta, 1.0
    for _ in range(rounds):
        gradient = x.transposed(weight * (sigmoid(x.times(ahead)) - y)) + penalty * ahead
        beta = ahead - gradient / bound
        if (ahead - beta) @ (beta - before) > 0:  # overshot: start again from here
            t, ahead = 1.0, beta
        else:
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = beta + (t - 1) / after * (beta - before)
            t = after
        done = np.abs(beta - before).max() < 1e-4 * max(1.0, np.abs(beta).max())
        before = beta
        if done:
            break
    return beta
