"""A small character tagger in numpy: bidirectional LSTM under a linear-chain CRF, with its gradients."""

from __future__ import annotations

import numpy as np

HIDDEN = 12
#: Characters with an id of their own; others fall into classes.
_OWN = "@.-+()_%/:,=#\n "
CLASSES = 6 + len(_OWN)


def char_ids(text: str) -> np.ndarray:
    """0 padding, 1 lower case, 2 capital, 3 digit, 4 letter beyond ASCII, 5 other, then ``_OWN``."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return _ASCII[np.minimum(code, 128)]


_ASCII = np.full(129, 5, dtype=np.int64)
_ASCII[97:123], _ASCII[65:91], _ASCII[48:58], _ASCII[128] = 1, 2, 3, 4
for _k, _c in enumerate(_OWN):
    _ASCII[ord(_c)] = 6 + _k


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))


def new_model(tags: int, seed: int = 7) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    model = {
        "input": draw.normal(0, 0.3, (2, CLASSES, 4 * HIDDEN)), "recur": draw.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN)),
        "bias": np.zeros((2, 1, 4 * HIDDEN)), "out": draw.normal(0, 0.2, (2 * HIDDEN, tags)), "out_bias": np.zeros(tags),
        "trans": np.zeros((tags, tags)),
    }
    model["bias"][:, :, HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
    return model


def _run(model: dict, ids: np.ndarray) -> dict:
    """Forward pass of both directions at once. ids: (batch, length)."""
    n, length = ids.shape
    both = np.stack([ids, ids[:, ::-1]])
    gates, cells, hidden = [], [np.zeros((2, n, HIDDEN))], [np.zeros((2, n, HIDDEN))]
    for t in range(length):
        z = np.stack([model["input"][d][both[d, :, t]] for d in (0, 1)]) + hidden[-1] @ model["recur"] + model["bias"]
        g = _sigmoid(z)
        g[..., 3 * HIDDEN :] = np.tanh(z[..., 3 * HIDDEN :])
        i, f, o, c = np.split(g, 4, axis=-1)
        cells.append(f * cells[-1] + i * c)
        hidden.append(o * np.tanh(cells[-1]))
        gates.append(g)
    h = np.stack(hidden[1:], axis=2)  # (2, n, length, HIDDEN)
    joined = np.concatenate((h[0], h[1][:, ::-1]), axis=-1)
    return {"both": both, "gates": gates, "cells": cells, "hidden": hidden, "joined": joined, "scores": joined @ model["out"] + model["out_bias"]}


def loss_and_gradients(model: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood per window, and its gradients."""
    seen = _run(model, ids)
    e, trans = seen["scores"], model["trans"]
    n, length, k = e.shape
    alpha = np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for t in range(1, length):
        alpha[:, t] = _logsumexp(alpha[:, t - 1, :, None] + trans, axis=1) + e[:, t]
    total = _logsumexp(alpha[:, -1], axis=1)
    beta = np.zeros_like(e)
    for t in range(length - 2, -1, -1):
        beta[:, t] = _logsumexp(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
    marginal = np.exp(alpha + beta - total[:, None, None])
    pairs = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
    rows = np.arange(n)[:, None]
    gold = e[rows, np.arange(length), tags].sum() + trans[tags[:, :-1], tags[:, 1:]].sum()
    d_e = marginal.copy()
    d_e[rows, np.arange(length), tags] -= 1
    d_e /= n
    d_trans = pairs.sum(axis=(0, 1))
    np.subtract.at(d_trans, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    grads = {key: np.zeros_like(x) for key, x in model.items()}
    grads["trans"] = d_trans / n
    grads["out"] = np.einsum("nth,ntk->hk", seen["joined"], d_e)
    grads["out_bias"] = d_e.sum(axis=(0, 1))
    d_joined = d_e @ model["out"].T
    d_h = np.stack([d_joined[..., :HIDDEN], d_joined[:, ::-1, HIDDEN:]])
    next_h, next_c = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
    for t in range(length - 1, -1, -1):
        i, f, o, c = np.split(seen["gates"][t], 4, axis=-1)
        cell = np.tanh(seen["cells"][t + 1])
        dh = d_h[:, :, t] + next_h
        dc = next_c + dh * o * (1 - cell**2)
        dz = np.concatenate((dc * c * i * (1 - i), dc * seen["cells"][t] * f * (1 - f), dh * cell * o * (1 - o), dc * i * (1 - c**2)), axis=-1)
        for d in (0, 1):
            np.add.at(grads["input"][d], seen["both"][d, :, t], dz[d])
        grads["recur"] += seen["hidden"][t].transpose(0, 2, 1) @ dz
        grads["bias"] += dz.sum(axis=1, keepdims=True)
        next_h, next_c = dz @ model["recur"].transpose(0, 2, 1), dc * f
    return float((total.sum() - gold) / n), grads


def train(ids: np.ndarray, tags: np.ndarray, kinds: int, rounds: int, batch: int = 48) -> dict[str, np.ndarray]:
    """Adam over batches drawn in a fixed order."""
    model = new_model(kinds)
    m, v = ({k: np.zeros_like(x) for k, x in model.items()} for _ in (0, 1))
    draw = np.random.default_rng(11)
    for step in range(1, rounds + 1):
        pick = draw.integers(0, len(ids), batch)
        _, grads = loss_and_gradients(model, ids[pick], tags[pick])
        rate = 0.03 * min(1.0, 2 * (1 - step / (rounds + 1)))
        for key, g in grads.items():
            g = np.clip(g, -5, 5)
            m[key] = 0.9 * m[key] + 0.1 * g
            v[key] = 0.99 * v[key] + 0.01 * g**2
            model[key] = model[key] - rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-8)
    return model


def decode(model: dict[str, np.ndarray], ids: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Best tag sequence of each window (Viterbi). ``allowed[a, b]``: tag b may follow tag a."""
    if not len(ids):
        return np.zeros(ids.shape, dtype=np.int64)
    e = _run(model, ids)["scores"]
    trans = np.where(allowed, model["trans"], -1e9)
    n, length, k = e.shape
    best, back = e[:, 0], np.zeros((n, length, k), dtype=np.int64)
    for t in range(1, length):
        all_ways = best[:, :, None] + trans
        back[:, t] = all_ways.argmax(axis=1)
        best = all_ways.max(axis=1) + e[:, t]
    path = np.empty((n, length), dtype=np.int64)
    path[:, -1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        path[:, t - 1] = back[np.arange(n), t, path[:, t]]
    return path
