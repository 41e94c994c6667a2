"""Linear-chain conditional random fields in numpy: fit, and exact decoding."""

from __future__ import annotations

import numpy as np


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def chain_gradient(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray, mask: np.ndarray):
    """Negative log-likelihood of tagged sequences and its gradients.

    ``scores`` (batch, time, tags), ``moves[from, to]``, ``mask`` (batch, time)
    with all of a sequence's places first. Returns the loss, the gradient of
    the scores and that of the moves.
    """
    b, t, k = scores.shape
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for i in range(1, t):
        step = logsumexp(ahead[:, i - 1, :, None] + moves, axis=1) + scores[:, i]
        ahead[:, i] = np.where(mask[:, i, None], step, ahead[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = logsumexp(moves + (scores[:, i + 1] + back[:, i + 1])[:, None, :], axis=2)
        back[:, i] = np.where(mask[:, i + 1, None], step, back[:, i])
    total = logsumexp(ahead[:, -1], axis=1)
    single = np.exp(ahead + back - total[:, None, None]) * mask[:, :, None]
    pair = np.exp(ahead[:, :-1, :, None] + moves + (scores + back)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
    rows, cols = np.arange(b)[:, None], np.arange(t)[None, :]
    gold = (scores[rows, cols, tags] * mask).sum() + (moves[tags[:, :-1], tags[:, 1:]] * mask[:, 1:]).sum()
    grad = single.copy()
    np.add.at(grad, (rows.repeat(t, 1), cols.repeat(b, 0), tags), -mask.astype(float))
    grad_moves = pair.sum(axis=(0, 1))
    np.add.at(grad_moves, (tags[:, :-1], tags[:, 1:]), -mask[:, 1:].astype(float))
    return float(total.sum() - gold), grad, grad_moves


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of equally long sequences, ``(batch, time)``."""
    b, t, k = scores.shape
    best, frm = scores[:, 0], np.zeros((b, t, k), dtype=np.int8)
    for i in range(1, t):
        step = best[:, :, None] + moves
        frm[:, i] = step.argmax(axis=1)
        best = step.max(axis=1) + scores[:, i]
    out = np.zeros((b, t), dtype=np.int64)
    out[:, -1] = best.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = frm[np.arange(b), i, out[:, i]]
    return out


def surely_outside(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Places that have tag 0 on every best path, whatever their neighbours.

    Setting one place to 0 changes the moves into and out of it by a bounded
    amount; where the scores favour 0 by more, no best path has another tag.
    """
    k = len(moves)
    worst = np.zeros(k)
    for y in range(1, k):
        into = (moves[:, y] - moves[:, 0]).max()
        out = (moves[y, :] - moves[0, :]).max()
        worst[y] = max(into, 0.0) + max(out, 0.0)
    return ((scores[:, :1] - scores[:, 1:]) > worst[1:]).all(axis=1)


def decode(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Viterbi tags of one sequence; sure places split it, so only the rest is searched."""
    n = len(scores)
    tags = np.zeros(n, dtype=np.int64)
    open_ = np.flatnonzero(~surely_outside(scores, moves))
    if not len(open_):
        return tags
    cuts = np.flatnonzero(np.diff(open_) > 1) + 1
    for run in np.split(open_, cuts):
        a, z = int(run[0]), int(run[-1]) + 1
        lo, hi = max(a - 1, 0), min(z + 1, n)
        part = scores[lo:hi].copy()
        if lo < a:
            part[0, 1:] = -1e9
        if hi > z:
            part[-1, 1:] = -1e9
        tags[a:z] = viterbi(part[None], moves)[0][a - lo : z - lo]
    return tags
