"""A small linear-chain conditional random field: training by stochastic gradient on the conditional likelihood, Viterbi decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """weights[feature, label], transitions[from, to], start[label]."""

    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: feature ids, a row per token."""
        return self.weights[x].sum(axis=1)


def _gradients(model: Chain, x: np.ndarray, y: np.ndarray):
    """(node, pair): expected less seen labels and label pairs, by the forward-backward recursion, each step scaled to sum to one."""
    e = model.emissions(x)
    n, labels = e.shape
    e = np.exp(e - e.max(axis=1, keepdims=True))
    step = np.exp(model.transitions - model.transitions.max())
    ahead, back, scale = np.empty((n, labels)), np.ones((n, labels)), np.ones(n)
    v = np.exp(model.start - model.start.max()) * e[0]
    ahead[0] = v / v.sum()
    for t in range(1, n):
        v = (ahead[t - 1] @ step) * e[t]
        scale[t] = v.sum()
        ahead[t] = v / scale[t]
    for t in range(n - 2, -1, -1):
        back[t] = step @ (e[t + 1] * back[t + 1]) / scale[t + 1]
    node = ahead * back
    node /= node.sum(axis=1, keepdims=True)
    pair = np.zeros((labels, labels))
    if n > 1:
        pair = (ahead[:-1, :, None] * step[None] * ((e[1:] * back[1:]) / scale[1:, None])[:, None, :]).sum(axis=0)
        np.subtract.at(pair, (y[:-1], y[1:]), 1)
    node[np.arange(n), y] -= 1
    return node, pair


def train(sequences: list[tuple[np.ndarray, np.ndarray]], features: int, labels: int, epochs: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 5, pad: int | None = None) -> Chain:
    """Fit by AdaGrad over the sequences (feature ids per token, label per token), in a seeded order. The feature `pad` fills rows up and weighs nothing."""
    model = Chain(np.zeros((features, labels)), np.zeros((labels, labels)), np.zeros(labels))
    seen = Chain(np.full((features, labels), 1e-6), np.full((labels, labels), 1e-6), np.full(labels, 1e-6))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(sequences)):
            x, y = sequences[i]
            if not len(y):
                continue
            node, pair = _gradients(model, x, y)
            where, inverse = np.unique(x, return_inverse=True)
            g = np.zeros((len(where), labels))
            np.add.at(g, inverse.reshape(x.shape), np.repeat(node[:, None, :], x.shape[1], axis=1))
            g += decay * model.weights[where]
            seen.weights[where] += g * g
            model.weights[where] -= rate * g / np.sqrt(seen.weights[where])
            if pad is not None:
                model.weights[pad] = 0
            pair += decay * model.transitions
            seen.transitions += pair * pair
            model.transitions -= rate * pair / np.sqrt(seen.transitions)
            seen.start += node[0] ** 2
            model.start -= rate * node[0] / np.sqrt(seen.start)
    return model


def viterbi(e: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Labels of the best path; of equal ones, that of smaller labels."""
    n = len(e)
    if not n:
        return np.zeros(0, np.int64)
    score = start + e[0]
    back = np.zeros((n, len(start)), np.int64)
    for t in range(1, n):
        step = score[:, None] + transitions
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + e[t]
    out = np.empty(n, np.int64)
    out[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def certain(e: np.ndarray, model: Chain, label: int) -> np.ndarray:
    """Tokens that take `label` on every best path: no change of the neighbouring transitions makes up for the loss of emission."""
    parts = np.concatenate([model.transitions.ravel(), model.start])
    bound = 2 * (parts.max() - parts.min())
    rest = np.delete(e, label, axis=1).max(axis=1)
    return e[:, label] - rest > bound


def decode(e: np.ndarray, first: np.ndarray, model: Chain, label: int) -> np.ndarray:
    """Best labels of many sequences laid end to end (first: their offsets).

    Tokens that are certain of `label` cut the sequences, exactly; Viterbi runs
    over the stretches between them, each with its certain neighbours.
    """
    out = np.full(len(e), label, np.int64)
    open_ = np.flatnonzero(~certain(e, model, label))
    if not len(open_):
        return out
    row = np.searchsorted(first, open_, "right") - 1
    cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(row) > 0)) + 1
    for group, r in zip(np.split(open_, cut), row[np.concatenate([[0], cut])], strict=True):
        lo, hi = max(int(first[r]), int(group[0]) - 1), min(int(first[r + 1]), int(group[-1]) + 2)
        part = e[lo:hi].copy()
        for t in (lo, hi - 1):  # a certain neighbour is held
            if t < group[0] or t > group[-1]:
                part[t - lo] -= 1e9
                part[t - lo, label] += 1e9
        begin = model.start if lo == first[r] else np.zeros_like(model.start)
        out[lo:hi] = viterbi(part, model.transitions, begin)
    return out
