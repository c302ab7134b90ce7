"""Linear-chain conditional random field with two states (clean 0, toxic 1) over tokens.

Many sequences are laid end to end and cut into equal lanes. A token's 2 x 2 potential matrix
leads from the state before it; a sequence's first token has equal rows, which forget what was
before. Lane products give each lane its message from either side, then all lanes step
together: exact marginals in a few numpy calls per step, with no padding to the longest text.
"""

from __future__ import annotations

import numpy as np

LIMIT = 30.0  # of a token's log-odds


class Chain:
    """trans: 2 x 2 log potentials; start: log potentials of a sequence's first state."""

    def __init__(self, trans: np.ndarray, start: np.ndarray):
        self.trans, self.start = np.asarray(trans, float), np.asarray(start, float)

    def marginals(self, odds: np.ndarray, first: np.ndarray, pairs: bool = False):
        """P(state 1) of each token, from log-odds and flags of first tokens; with pairs also the
        expected number of each transition (2 x 2) and of each start."""
        n = len(odds)
        if not n:
            return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
        steps = max(1, int(np.sqrt(n)))
        lanes = -(-n // steps)
        x, f = np.zeros(lanes * steps), np.zeros(lanes * steps, bool)
        x[:n], f[:n] = np.clip(odds, -LIMIT, LIMIT), first
        f[0] = True
        f[n:] = True
        x, f = np.exp(x).reshape(lanes, steps).T.copy(), f.reshape(lanes, steps).T.copy()
        a, s = np.exp(self.trans), np.exp(self.start)
        m00, m10 = np.where(f, s[0], a[0, 0]), np.where(f, s[0], a[1, 0])
        m01, m11 = np.where(f, s[1], a[0, 1]) * x, np.where(f, s[1], a[1, 1]) * x
        p = [np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)]
        for t in range(steps):
            q = p[0] * m00[t] + p[1] * m10[t], p[0] * m01[t] + p[1] * m11[t], p[2] * m00[t] + p[3] * m10[t], p[2] * m01[t] + p[3] * m11[t]
            z = q[0] + q[1] + q[2] + q[3]
            p = [v / z for v in q]
        prod = np.stack(p, axis=1).tolist()
        fw, u0, u1 = [], 1.0, 0.0
        for a00, a01, a10, a11 in prod:
            fw.append((u0, u1))
            u0, u1 = u0 * a00 + u1 * a10, u0 * a01 + u1 * a11
            z = u0 + u1
            u0, u1 = u0 / z, u1 / z
        bw, u0, u1 = [], 0.5, 0.5
        for a00, a01, a10, a11 in reversed(prod):
            bw.append((u0, u1))
            u0, u1 = a00 * u0 + a01 * u1, a10 * u0 + a11 * u1
            z = u0 + u1
            u0, u1 = u0 / z, u1 / z
        alpha = np.empty((steps + 1, 2, lanes))
        alpha[0] = np.array(fw).T
        for t in range(steps):
            v0, v1 = alpha[t]
            w0, w1 = v0 * m00[t] + v1 * m10[t], v0 * m01[t] + v1 * m11[t]
            z = w0 + w1
            alpha[t + 1, 0], alpha[t + 1, 1] = w0 / z, w1 / z
        beta = np.empty((steps, 2, lanes))
        v0, v1 = np.array(bw[::-1]).T
        for t in range(steps - 1, -1, -1):
            beta[t, 0], beta[t, 1] = v0, v1
            w0, w1 = m00[t] * v0 + m01[t] * v1, m10[t] * v0 + m11[t] * v1
            z = w0 + w1
            v0, v1 = w0 / z, w1 / z
        both = alpha[1:] * beta
        post = (both[:, 1] / (both[:, 0] + both[:, 1])).T.reshape(-1)[:n]
        if not pairs:
            return post
        xi = np.stack([alpha[:-1, 0] * m00 * beta[:, 0], alpha[:-1, 0] * m01 * beta[:, 1], alpha[:-1, 1] * m10 * beta[:, 0], alpha[:-1, 1] * m11 * beta[:, 1]])
        xi /= xi.sum(axis=0)
        inner = ~f
        begin = np.flatnonzero(first)
        return post, np.array([v[inner].sum() for v in xi]).reshape(2, 2), np.array([(1 - post[begin]).sum(), post[begin].sum()])


def train(types: np.ndarray, first: np.ndarray, labels: np.ndarray, features: list[np.ndarray], n_features: int, rounds: int = 40, l2: float = 2.0) -> tuple[np.ndarray, Chain]:
    """Weights of features and the chain. types: each token's word; features: each word's feature ids.

    Full-batch AdaGrad on the penalised conditional likelihood; the last feature is the bias."""
    owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
    feats = np.concatenate(features) if len(features) else np.zeros(0, np.int64)
    w, trans, start = np.zeros(n_features), np.zeros((2, 2)), np.zeros(2)
    real_t = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(real_t, (labels[inner - 1], labels[inner]), 1)
    begin = labels[first]
    real_s = np.array([(begin == 0).sum(), (begin == 1).sum()])
    sums = [np.full_like(v, 1e-6) for v in (w, trans, start)]
    for _ in range(rounds):
        odds = np.bincount(owner, w[feats], minlength=len(features))
        post, pair, begins = Chain(trans, start).marginals(odds[types], first, pairs=True)
        by_type = np.bincount(types, labels - post, minlength=len(features))
        grads = np.bincount(feats, by_type[owner], minlength=n_features) - l2 * w, real_t - pair - l2 * trans, real_s - begins - l2 * start
        for v, g, h in zip((w, trans, start), grads, sums):
            h += g * g
            v += 1.0 * g / np.sqrt(h)
    return w, Chain(trans, start)
