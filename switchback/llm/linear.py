"""Sparse multinomial logistic regression: FTRL-proximal training with an elastic net,
and temperature calibration."""

from __future__ import annotations

import numpy as np


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, dims: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dims × classes) and bias. ``rows``: (indices, values); ``targets``: a
    probability of each class for each row."""
    classes = targets.shape[1]
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))  # the last row is the bias

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(0)
    bound = [(np.append(index, dims).astype(np.int32), np.append(value, 1.0).astype(np.float32)) for index, value in rows]
    for _ in range(epochs):
        for k in order.permutation(len(bound)):
            index, value = bound[k]
            w = weights(index)
            g = value[:, None] * (softmax(value @ w) - targets[k])[None, :]
            more = n[index] + g * g
            z[index] += g - (np.sqrt(more) - np.sqrt(n[index])) / alpha * w
            n[index] = more
    full = weights(slice(None))
    return full[:dims].astype(np.float32), full[dims].astype(np.float32)


def logits(rows, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.array([value @ weights[index] + bias for index, value in rows]).reshape(len(rows), len(bias))


def temperature(scores: np.ndarray, targets: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section over its logarithm."""
    if not len(scores):
        return 1.0

    def loss(t: float) -> float:
        return float(-(targets * np.log(softmax(scores / np.exp(t)) + 1e-12)).sum())

    low, high, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
