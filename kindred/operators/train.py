"""Training of the encoder: losses with their gradients, batches, labels, sampling by proximity, Adam.

Distances of a batch's graphs are labels; squared distances of embeddings and of codes are to equal them.
Labels are computed by the cluster (batch_labels); the model is fitted on the driver over a sample of at most
`most` graphs (train_sample), a documented bound. Encoding covers every graph (encode.encode)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import small_enough
from ..sources.scratch import written
from . import augment, encode, ged

Weights = dict[str, np.ndarray]
Graph = tuple[list[int], list[tuple[int, int, int]]]  # labels of vertices, (src, dst, label) of edges


@dataclass
class Settings:
    """Defaults of the model: weights of the loss terms, clipping limit, batches, step size and stopping."""

    emb: float = 10.0
    code: float = 1.0
    binary: float = 0.2
    decay: float = 0.0
    a: float = 0.05  # errors of codes weigh exp(a (prediction - label))
    limit: float = 11.0
    real: float = 1.0
    synthetic: float = 1.0
    batch: int = 10
    copies: int = 1
    edits: int = 1
    rate: float = 1e-3
    epochs: int = 1000
    long: int = 500
    short: int = 50
    gain: float = 0.1
    every: int = 50
    by_proximity: bool = False
    pool: int = 200
    near: int = 5
    refresh: int = 10
    step: int = 100


# Losses: (value, gradient)


def _weighted(d: np.ndarray, truth: np.ndarray, limit: float, a: float) -> tuple[np.ndarray, np.ndarray]:
    """exp(a (p - t)) (p - t)^2 and its slope in d, p being d clipped at limit; the slope passes the clipping unchanged."""
    gap = np.minimum(d, limit) - truth
    w = np.exp(a * gap)
    return w * gap**2, w * (a * gap**2 + 2 * gap)


def pair_loss(x: np.ndarray, truth: np.ndarray, limit: float, a: float = 0.0, bits: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Error of squared distances of all pairs i < j of a batch, over the square of the batch's size.

    bits: weights of the components, negative ones count as 0."""
    n, w = len(x), np.ones(x.shape[1]) if bits is None else np.maximum(bits, 0)
    diff = x[:, None, :] - x[None, :, :]
    value, slope = _weighted((diff**2 * w).sum(axis=2), truth, limit, a)
    upper = np.triu(np.ones((n, n)), 1)
    slope = slope * upper / n**2
    return float((value * upper).sum() / n**2), 2 * ((slope + slope.T)[:, :, None] * diff * w).sum(axis=1)


def copy_loss(x: np.ndarray, y: np.ndarray, edits: np.ndarray, limit: float, a: float = 0.0, bits: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """The same for graphs x (n, d) and their edited copies y (n, k, d); gradients of both."""
    w = np.ones(x.shape[1]) if bits is None else np.maximum(bits, 0)
    diff = x[:, None, :] - y
    value, slope = _weighted((diff**2 * w).sum(axis=2), edits, limit, a)
    g = 2 * slope[:, :, None] / slope.size * diff * w
    return float(value.mean()), g.sum(axis=1), -g


def binary_loss(c: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean distance of squared activations from a quarter: codes move to +-0.5."""
    gap = c**2 - 0.25
    return float(np.abs(gap).mean()), np.sign(gap) * 2 * c / c.size


def l1_loss(c: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
    return float(weight * np.abs(c).sum()), weight * np.sign(c)


def similarity_loss(c: np.ndarray, truth: np.ndarray, limit: float, margin: float | None = None, copies: np.ndarray | None = None, real: float = 1.0, synthetic: float = 1.0) -> float:
    """Deep supervised hashing: pairs nearer than limit are drawn together, others pushed to margin (half the width)."""
    margin = c.shape[1] / 2 if margin is None else margin
    d = ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    first = np.where(truth < limit, d, np.maximum(margin - d, 0)).mean()
    second = ((copies - c[:, None, :]) ** 2).sum(axis=2).mean() if copies is not None and copies.size else 0.0
    return float(real * first + synthetic * second)


def score_loss(scores: np.ndarray, truth: np.ndarray, edits: np.ndarray, limit: float, real: float = 1.0, synthetic: float = 1.0) -> float:
    """Weighted squared error of a pair scorer's (n, n + k) scores, clipped to 0..limit: batch pairs, then copies."""
    n = len(scores)
    error = (np.clip(scores, 0, limit) - np.concatenate([truth, edits], axis=1)) ** 2
    return float((error[:, :n].sum() * real + error[:, n:].sum() * synthetic) / error.size)


def masked_cross_entropy(scores: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> float:
    """Mean softmax cross entropy of the masked rows; 0 where the mask is empty."""
    m = mask.astype(float)
    top = scores.max(axis=1, keepdims=True)
    log_p = scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))
    return float(-((labels * log_p).sum(axis=1) * m).sum() / m.sum()) if m.sum() else 0.0


def masked_accuracy(scores: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> float:
    m = mask.astype(float)
    return float(((scores.argmax(axis=1) == labels.argmax(axis=1)) * m).sum() / m.sum()) if m.sum() else 0.0


def batch_loss(emb: np.ndarray, act: np.ndarray, truth: np.ndarray, edits: np.ndarray, s: Settings, bits: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of n graphs followed by their n * k copies, with its gradients in embeddings and activations."""
    n, k = edits.shape
    g_emb, g_act, total = np.zeros_like(emb), np.zeros_like(act), 0.0
    for x, g, share, a, w in ((emb, g_emb, s.emb, 0.0, None), (act, g_act, s.code, s.a, bits)):
        value, slope = pair_loss(x[:n], truth, s.limit, a, w)
        total += share * s.real * value
        g[:n] += share * s.real * slope
        if k:
            value, own, other = copy_loss(x[:n], x[n:].reshape(n, k, -1), edits, s.limit, a, w)
            total += share * s.synthetic * value
            g[:n] += share * s.synthetic * own
            g[n:] += share * s.synthetic * other.reshape(n * k, -1)
    value, slope = binary_loss(act)
    return total + s.binary * value, g_emb, g_act + s.binary * slope


# Gradients of the model


def backward(kept: dict, w: Weights, g_emb: np.ndarray, g_act: np.ndarray, grads: Weights) -> None:
    """Adds one graph's gradients to grads; kept is what encode.forward() returns."""
    pre = g_act * (0.5 - 2 * kept["act"] ** 2)  # slope of tanh(x) / 2
    grads["code1"] += np.outer(kept["hidden"], pre)
    g = (w["code1"] @ pre) * (kept["hidden"] > 0)
    grads["code0"] += np.outer(kept["emb"], g)
    g = g_emb + w["code0"] @ g
    for k in reversed(range(len(encode.DENSE))):
        if k < len(encode.DENSE) - 1:
            g = g * (kept["dense"][k + 1] > 0)
        grads[f"dense{k}"] += np.outer(kept["dense"][k], g)
        g = w[f"dense{k}"] @ g
    parts = np.split(g, np.cumsum(encode.CONV)[:-1])
    above = np.zeros_like(kept["x"][-1])
    for k in reversed(range(len(encode.CONV))):
        x = kept["x"][k + 1]
        mean = x.mean(axis=0)
        raw = w[f"pool{k}"] @ mean
        h = np.maximum(raw, 0)
        s = 1 / (1 + np.exp(-(x @ h)))
        g_logit = (x @ parts[k]) * s * (1 - s)
        g_raw = (x.T @ g_logit) * (raw > 0)
        grads[f"pool{k}"] += np.outer(g_raw, mean)
        g_x = above + np.outer(s, parts[k]) + np.outer(g_logit, h) + w[f"pool{k}"].T @ g_raw / len(x)
        g_z = kept["lap"] @ (g_x * (x > 0))
        grads[f"conv{k}"] += kept["x"][k].T @ g_z
        above = g_z @ w[f"conv{k}"].T


def loss_and_gradients(batch: list[Graph], truth: np.ndarray, edits: np.ndarray, w: Weights, s: Settings, bits: np.ndarray | None = None) -> tuple[float, Weights]:
    """batch: n graphs, then the copies of the first, of the second, ..."""
    kept = [encode.forward(nodes, edges, w) for nodes, edges in batch]
    value, g_emb, g_act = batch_loss(np.array([x["emb"] for x in kept]), np.array([x["act"] for x in kept]), truth, edits, s, bits)
    grads = {k: s.decay * x for k, x in w.items()}
    for x, ge, ga in zip(kept, g_emb, g_act):
        backward(x, w, ge, ga, grads)
    return value + s.decay * sum(float((x**2).sum()) for x in w.values()) / 2, grads


@dataclass
class Adam:
    rate: float = 1e-3
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-8
    steps: int = 0
    first: Weights = field(default_factory=dict)
    second: Weights = field(default_factory=dict)

    def update(self, w: Weights, grads: Weights) -> None:
        """Changes the weights in place."""
        self.steps += 1
        for k, g in grads.items():
            m = self.first[k] = self.b1 * self.first.get(k, 0.0) + (1 - self.b1) * g
            v = self.second[k] = self.b2 * self.second.get(k, 0.0) + (1 - self.b2) * g * g
            w[k] -= self.rate * (m / (1 - self.b1**self.steps)) / (np.sqrt(v / (1 - self.b2**self.steps)) + self.eps)


# Batches, labels and sampling


def cyclic_batches(n: int, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Endless batches of places 0..n-1 in order; at the end the order is dealt anew and fills the batch up."""
    order, at = np.arange(n), 0
    while True:
        out = order[at : at + size]
        at += len(out)
        if at >= n:
            order, at = rng.permutation(n), 0
        while len(out) < size:
            out = np.concatenate([out, order[: size - len(out)]])
        yield out


def proximity_sample(d: np.ndarray, at: int, near: int, far: int, rng: np.random.Generator, grown: bool = False) -> np.ndarray:
    """Places of the pool for one batch: `at`, near ones by exp(-d), far ones by exp(d), or by d where the pool has grown."""
    others = np.delete(np.arange(len(d)), at)
    x = d[at, others]

    def draw(weight: np.ndarray, n: int) -> np.ndarray:
        total = np.cumsum(weight)
        if not total[-1] > 0:  # all others are equal to it
            total = np.cumsum(np.ones(len(weight)))
        return others[np.searchsorted(total / total[-1], rng.random(n), side="right").clip(max=len(others) - 1)]

    # exp() of differences to the extremes has the same shares and cannot overflow
    return np.concatenate([[at], draw(np.exp(x.min() - x), near), draw(x if grown else np.exp(x - x.max()), far)])


class Pool:
    """A sliding pool of graphs and their embeddings: the oldest step leaves, the next graphs enter."""

    def __init__(self, graphs: list[Graph], size: int, step: int, w: Weights) -> None:
        self.graphs, self.size, self.step = graphs, min(size, len(graphs)), min(step, size, len(graphs))
        self.restart(w)

    def _embed(self, places: np.ndarray, w: Weights) -> np.ndarray:
        return np.array([encode.forward(*self.graphs[i % len(self.graphs)], w)["emb"] for i in places])

    def restart(self, w: Weights) -> None:
        self.bias, self.at, self.grown = 0, 0, False
        self.emb = self._embed(np.arange(self.size), w)
        self._measure()

    def _measure(self) -> None:
        sq = (self.emb**2).sum(axis=1)
        self.d = np.maximum(sq[:, None] + sq[None, :] - 2 * self.emb @ self.emb.T, 0)

    def slide(self, w: Weights) -> None:
        self.bias, self.at = self.bias + self.step, 0
        if self.bias > len(self.graphs):
            self.restart(w)
            return
        places = self.bias + self.size - self.step + np.arange(self.step)
        self.emb, self.grown = np.concatenate([self.emb[self.step :], self._embed(places, w)]), True
        self._measure()

    def sample(self, near: int, batch: int, rng: np.random.Generator) -> np.ndarray:
        """Places of the graphs of one batch; the anchor moves on."""
        if self.size == 1:
            return np.zeros(batch, np.int64)
        near = min(near, batch - 1)
        out = proximity_sample(self.d, self.at, near, batch - near - 1, rng, self.grown)
        self.at = (self.at + 1) % self.size
        return (out + self.bias) % len(self.graphs)


def structure_labels(graphs: DataFrame, batch: str, limit: int, steps: int = ged.STEPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((sid, nodes, edges) of distinct graphs; (batch, gid, sid); (s1, s2, n, ged) with s1 <= s2): n unordered pairs of graphs inside batches have
    these structures. Distances below limit, else limit; each pair of structures is searched once. All are stored tables."""
    own, _ = ged.structures(graphs)
    rows = graphs.select(F.col(batch).alias("batch"), "gid", "nodes", "edges")
    members = written(rows.join(own.select("sid", "nodes", "edges"), ["nodes", "edges"]).select("batch", "gid", "sid"), "members")
    per = members.groupBy("batch", "sid").agg(F.count("*").alias("n"))
    side = lambda k: per.select("batch", F.col("sid").alias(f"s{k}"), F.col("n").alias(f"n{k}"))
    n = F.when(F.col("s1") == F.col("s2"), F.floor(F.col("n1") * (F.col("n1") - 1) / 2)).otherwise(F.col("n1") * F.col("n2"))
    pairs = written(side(1).join(side(2), "batch").where("s1 <= s2").groupBy("s1", "s2").agg(F.sum(n).alias("n")), "pairs")
    graph = lambda k: own.select(F.col("sid").alias(f"s{k}"), F.col("nodes").alias(f"nodes{k}"), F.col("edges").alias(f"edges{k}"))
    d = ged.decided(pairs.where("s1 < s2").join(graph(1), "s1").join(graph(2), "s2"), limit - 1, steps)
    d = d.select("s1", "s2", "n", F.when(F.col("ged") < 0, limit).otherwise(F.col("ged")).cast("int").alias("ged"))
    return own.select("sid", "nodes", "edges"), members, written(d.union(pairs.where("s1 = s2").select("s1", "s2", "n", F.lit(0).alias("ged"))), "labels")


def batch_labels(graphs: DataFrame, batch: str, limit: int, steps: int = ged.STEPS) -> DataFrame:
    """(batch, qid, gid, ged) of all ordered pairs inside each batch: distances below limit, else limit.

    Each unordered pair of structures is searched once; a graph's distance to itself is 0. Batches are small by their meaning."""
    _, members, d = structure_labels(graphs, batch, limit, steps)
    d = d.select(F.col("s1").alias("low"), F.col("s2").alias("high"), "ged")
    pairs = members.select("batch", F.col("gid").alias("qid"), F.col("sid").alias("s1")).join(members.select("batch", "gid", F.col("sid").alias("s2")), "batch")
    pairs = pairs.select("batch", "qid", "gid", F.least("s1", "s2").alias("low"), F.greatest("s1", "s2").alias("high"))
    return pairs.join(F.broadcast(d) if small_enough(d) else d, ["low", "high"]).select("batch", "qid", "gid", "ged")


def train_sample(graphs: DataFrame, most: int = 2000, seed: int = 1) -> list[Graph]:
    """At most `most` graphs with vertices, the least by hash of gid: the documented bound of what training reads."""
    rows = graphs.where(F.size("nodes") > 0).select("gid", "nodes", "edges").orderBy(F.xxhash64("gid", F.lit(seed)), "gid").limit(most).collect()
    return [(list(r["nodes"]), [(e["src"], e["dst"], e["label"]) for e in r["edges"] or ()]) for r in rows]


def _copy(g: Graph, s: Settings, labels: int, rng: np.random.Generator) -> tuple[Graph, int]:
    nodes, edges, ops = list(g[0]), list(g[1]), 0
    for _ in range(int(rng.integers(1, s.edits + 1))):
        n, e, done = augment.EDITS[int(rng.integers(len(augment.EDITS)))](rng, nodes, edges, labels)
        if n:  # an encoder has nothing to say of a graph without vertices
            nodes, edges, ops = n, e, ops + done
    return (nodes, edges), ops


def stopped(losses: list[float], s: Settings) -> bool:
    """Whether the last epoch (from 0) is one to look at and the long mean is not `gain` over the short one."""
    epoch = len(losses) - 1
    return epoch > s.long and epoch % s.every == 0 and np.mean(losses[-s.long :]) - np.mean(losses[-s.short :]) < s.gain


def train(graphs: list[Graph], w: Weights, s: Settings | None = None, seed: int = 1, bits: np.ndarray | None = None) -> tuple[Weights, list[float]]:
    """(weights, loss of each epoch). Labels are exact below the limit: the search of a batch's pair has no step limit."""
    s = s or Settings()
    if not graphs:
        return w, []
    w, rng, adam, losses = {k: x.copy() for k, x in w.items()}, np.random.default_rng(seed), Adam(s.rate), []
    labels = 1 + max(max(nodes) for nodes, _ in graphs)
    cursor, pool, known = cyclic_batches(len(graphs), s.batch, rng), Pool(graphs, s.pool, s.step, w) if s.by_proximity else None, {}

    def distance(i: int, j: int) -> float:
        if i == j:
            return 0.0
        key = min(i, j), max(i, j)
        if key not in known:
            found = ged.edit_distance(*graphs[key[0]], *graphs[key[1]], int(s.limit) - 1, None)
            known[key] = s.limit if found < 0 else float(found)
        return known[key]

    for epoch in range(s.epochs):
        at = [int(i) for i in (pool.sample(s.near, s.batch, rng) if pool else next(cursor))]
        made = [_copy(graphs[i], s, labels, rng) for i in at for _ in range(s.copies)]
        truth = np.array([[distance(i, j) for j in at] for i in at])
        edits = np.array([ops for _, ops in made], float).reshape(len(at), s.copies)
        value, grads = loss_and_gradients([graphs[i] for i in at] + [g for g, _ in made], truth, edits, w, s, bits)
        adam.update(w, grads)
        losses.append(value)
        if pool and (epoch + 1) % s.refresh == 0:
            pool.slide(w)
        if stopped(losses, s):
            break
    return w, losses
