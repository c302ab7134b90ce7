"""Graph encoder: three graph convolutions, each pooled by attention, dense layers to an embedding and a code."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONV, DENSE, EMB, CODE = (256, 128, 64), (348, 256), 256, (128, 32)


def make_weights(features: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Seeded uniform weights of the right shapes, for encoders that are not trained."""
    rng = np.random.default_rng(seed)
    w = {}

    def layer(name: str, a: int, b: int) -> None:
        r = np.sqrt(6 / (a + b))
        w[name] = rng.uniform(-r, r, (a, b))

    for k, (a, b) in enumerate(zip((features, *CONV), CONV)):
        layer(f"conv{k}", a, b)
        layer(f"pool{k}", b, b)
    for k, (a, b) in enumerate(zip((sum(CONV), *DENSE), DENSE)):
        layer(f"dense{k}", a, b)
    layer("code0", EMB, CODE[0])
    layer("code1", CODE[0], CODE[1])
    return w


def save_weights(w: dict[str, np.ndarray]) -> bytes:
    f = io.BytesIO()
    np.savez_compressed(f, **w)
    return f.getvalue()


def load_weights(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data), allow_pickle=False))


def laplacian(n: int, edges: list) -> np.ndarray:
    """D^-1/2 (A + I) D^-1/2."""
    a = np.eye(n)
    for s, d in edges:
        if s != d:
            a[s, d] = a[d, s] = 1
    r = 1 / np.sqrt(a.sum(axis=1))
    return a * r[:, None] * r[None, :]


def mean_pool(x: np.ndarray) -> np.ndarray:
    """The mean of rows; 0 where there is none."""
    return x.mean(axis=0) if len(x) else np.zeros(x.shape[1])


def attention_pool(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of rows weighted by the sigmoid of their product with relu(w . mean)."""
    h = np.maximum(w @ x.mean(axis=0), 0)
    return (1 / (1 + np.exp(-(x @ h)))) @ x


def forward(nodes: list[int], edges: list, w: dict[str, np.ndarray]) -> dict:
    """All layers' values of one graph: lap, x (features, then each convolution), dense (their inputs and emb), emb, hidden, act.

    Labels beyond the features' width have no feature; emb is the embedding, act the code activations in -0.5..0.5."""
    width = w["conv0"].shape[0]
    x = np.zeros((len(nodes), width))
    for i, label in enumerate(nodes):
        if 0 <= label < width:
            x[i, label] = 1
    lap, xs = laplacian(len(nodes), [e[:2] for e in edges]), [x]
    for k in range(len(CONV)):
        xs.append(np.maximum(lap @ xs[-1] @ w[f"conv{k}"], 0))
    dense = [np.concatenate([attention_pool(x, w[f"pool{k}"]) for k, x in enumerate(xs[1:])])]
    for k in range(len(DENSE)):
        e = dense[-1] @ w[f"dense{k}"]
        dense.append(np.maximum(e, 0) if k < len(DENSE) - 1 else e)
    hidden = np.maximum(dense[-1] @ w["code0"], 0)
    return {"lap": lap, "x": xs, "dense": dense, "emb": dense[-1], "hidden": hidden, "act": 0.5 * np.tanh(hidden @ w["code1"])}


def encode_graph(nodes: list[int], edges: list, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(embedding, code activations) of one graph."""
    kept = forward(nodes, edges, w)
    return kept["emb"], kept["act"]


def encode(graphs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(gid, code, emb): bit i of the code is whether activation i is positive. Empty graphs have null for both.

    Equal structures are encoded once and joined back, many of an Arrow batch in one product a layer. A null label has no feature;
    an edge to a vertex that is not there raises ValueError."""
    from .ged import structures

    own, of = structures(graphs)
    found = _encoded(own.select(F.col("sid").alias("gid"), "nodes", "edges"), weights)
    return of.join(found.withColumnRenamed("gid", "sid"), "sid").select("gid", "code", "emb")


SMALL = 64  # vertices up to which graphs of one size are multiplied as dense matrices


class Block:
    """Several graphs as one: vertices numbered on, and D^-1/2 (A + I) D^-1/2 of each, as a stack of dense matrices where
    all have the same small size, else block-diagonal as sorted sparse rows."""

    def __init__(self, sizes: np.ndarray, labels: np.ndarray, counts: np.ndarray, src: np.ndarray, dst: np.ndarray):
        """sizes, counts: vertices (one or more) and edges of each graph; labels, src, dst: those of all graphs in order."""
        n, self.sizes, self.labels = int(sizes.sum()), sizes, labels
        self.starts = np.cumsum(sizes) - sizes
        first, size = np.repeat(self.starts, counts), np.repeat(sizes, counts)
        if ((src < 0) | (dst < 0) | (src >= size) | (dst >= size)).any():
            raise ValueError("an edge names a vertex that its graph does not have")
        self.stack = None
        if sizes[0] <= SMALL and (sizes == sizes[0]).all():
            self.stack = np.zeros((len(sizes), sizes[0], sizes[0]))
            graph, i = np.repeat(np.arange(len(sizes)), counts), np.arange(sizes[0])
            self.stack[graph, src, dst] = self.stack[graph, dst, src] = 1
            self.stack[:, i, i] = 1
            r = 1 / np.sqrt(self.stack.sum(axis=2))
            self.stack *= r[:, :, None] * r[:, None, :]
            return
        s, d, own = src + first, dst + first, np.arange(n, dtype=np.int64) * (n + 1)
        at = np.unique(np.concatenate([s * n + d, d * n + s, own]))  # each row holds its own place, none is empty
        row, self.column = np.divmod(at, n)
        self.rows = np.searchsorted(row, np.arange(n))
        r = 1 / np.sqrt(np.diff(np.append(self.rows, len(at))))
        self.weight = (r[row] * r[self.column])[:, None]

    def spread(self, x: np.ndarray) -> np.ndarray:
        """The block-diagonal matrix times x."""
        if self.stack is not None:
            return (self.stack @ x.reshape(*self.stack.shape[:2], -1)).reshape(x.shape)
        return np.add.reduceat(self.weight * x[self.column], self.rows, axis=0)

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum of x over each graph's vertices."""
        if self.stack is not None:
            return x.reshape(*self.stack.shape[:2], -1).sum(axis=1)
        return np.add.reduceat(x, self.starts, axis=0)

    def pooled(self, w: dict[str, np.ndarray]) -> np.ndarray:
        """(graphs, sum of CONV): the attention-pooled convolutions, as forward() computes them one by one."""
        w0, out = w["conv0"], []
        known = (self.labels >= 0) & (self.labels < len(w0))
        x = np.where(known[:, None], w0[np.where(known, self.labels, 0)], 0)  # one-hot features times conv0
        for k in range(len(CONV)):
            x = np.maximum(self.spread(x if k == 0 else x @ w[f"conv{k}"]), 0)
            h = np.repeat(np.maximum(self.total(x) / self.sizes[:, None] @ w[f"pool{k}"].T, 0), self.sizes, axis=0)
            share = (1 + np.tanh(np.einsum("ij,ij->i", x, h) / 2)) / 2  # the sigmoid
            out.append(self.total(share[:, None] * x))
        return np.concatenate(out, axis=1)


def blocks(b: pa.RecordBatch, vertices: int = 1024) -> Iterator[tuple[np.ndarray, Block]]:
    """(rows, block) of a batch's graphs (nodes, edges), at most so many vertices a block unless one graph has more; small
    graphs of one size together. Graphs without vertices are in none."""

    def column(name: str) -> tuple[np.ndarray, pa.Array]:
        lists = b[name]
        return np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64), lists.flatten()

    def places(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of the values of rows' lists, where they are in the flat column."""
        n = sizes[rows]
        return np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[rows] - (np.cumsum(n) - n), n)

    sizes, labels = column("nodes")
    counts, edges = column("edges")
    labels = np.asarray(labels.fill_null(-1), dtype=np.int64)
    src, dst = (np.asarray(edges.field(f), dtype=np.int64) for f in ("src", "dst"))
    if counts[sizes == 0].any():
        raise ValueError("an edge names a vertex that its graph does not have")
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    while len(order):
        size = sizes[order[0]]
        upto = np.cumsum(sizes[order[: vertices // size + 1]])
        n = max(1, int(np.searchsorted(upto, vertices, side="right")))
        if size <= SMALL:
            n = min(n, int(np.searchsorted(sizes[order[:n]], size, side="right")))
        now, order = order[:n], order[n:]
        v, e = places(now, sizes), places(now, counts)
        yield now, Block(sizes[now], labels[v], counts[now], src[e], dst[e])


def encode_block(block: Block, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings, code activations), a row for each graph."""
    x = block.pooled(w)
    for k in range(len(DENSE)):
        x = x @ w[f"dense{k}"]
        x = np.maximum(x, 0) if k < len(DENSE) - 1 else x
    return x, 0.5 * np.tanh(np.maximum(x @ w["code0"], 0) @ w["code1"])


def listed(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """n lists: the i-th of rows holds the i-th row of values, others are null."""
    held = np.zeros(n, dtype=bool)
    held[rows] = True
    offsets = np.concatenate([[0], np.cumsum(held * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[np.argsort(rows)].ravel()), mask=pa.array(~held))


def _encoded(graphs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    shared = graphs.sparkSession.sparkContext.broadcast(weights)  # fixed by the model's shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            rows, embs, acts = [np.zeros(0, np.int64)], [np.zeros((0, EMB))], [np.zeros((0, CODE[-1]))]
            for now, block in blocks(b):
                e, c = encode_block(block, w)
                rows.append(now)
                embs.append(e)
                acts.append(c)
            at = np.concatenate(rows)
            codes = np.zeros(b.num_rows, np.int64)
            codes[at] = (np.concatenate(acts) > 0) @ (1 << np.arange(CODE[-1], dtype=np.int64))
            none = np.ones(b.num_rows, dtype=bool)
            none[at] = False
            yield pa.record_batch([b["gid"], pa.array(codes, mask=none), listed(at, np.concatenate(embs), b.num_rows)], ["gid", "code", "emb"])

    return graphs.select("gid", "nodes", "edges").mapInArrow(run, "gid long, code long, emb array<double>")


def pair_loss(emb: np.ndarray, codes: np.ndarray, truth: np.ndarray, limit: float, a: float = 0.05) -> dict[str, float]:
    """Training losses of a batch: squared error of embedding distances, weighted squared error of code distances, and
    the codes' distance from +-0.5; means over pairs i < j, predictions clipped at limit. train.batch_loss is what training descends."""
    i, j = np.triu_indices(len(emb), 1)
    d_emb, d_code, t = ((emb[i] - emb[j]) ** 2).sum(axis=1), ((codes[i] - codes[j]) ** 2).sum(axis=1), truth[i, j]
    p_emb, p_code = np.minimum(d_emb, limit), np.minimum(d_code, limit)
    parts = {"emb": float(((p_emb - t) ** 2).mean()), "code": float((np.exp(a * (p_code - t)) * (p_code - t) ** 2).mean()), "binary": float(np.abs(codes**2 - 0.25).mean())}
    return parts | {"total": 10 * parts["emb"] + parts["code"] + 0.2 * parts["binary"]}
