"""Toxic spans and document scores from a linear-chain conditional random field.

Documents carry labels, tokens do not. From a bounded sample of labelled training documents
tokens are labelled first: in a toxic document a token is toxic if its word, or one of its
beginnings of 3 to 6 letters, is far more frequent among toxic documents than among others.
The field is trained on these tokens, with the word and its beginnings as features. In scoring,
forward-backward marginals tag tokens; a document's expected number of toxic tokens, beside
its length, gives its score through a logistic fitted on the same sample.

A null or empty text has no token and the score of no toxic token. Repeated rows are scored
alike. Without labelled documents of both kinds all scores are the share of toxic labels (0
without labels). Labels, lang, source and doc_id never enter a score. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, column, documents, per_worker, slices
from .crf import Chain, train

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = range(3, 7)
SAMPLE = 1500  # labelled documents of either kind, at most
TEXT_LIMIT = 40_000_000  # characters of the sample, at most: a document that no longer fits is left out, later ones that fit are not
LIFT, SEEN = 20.0, 4  # how much more frequent, and in how many toxic documents, a cue is
WORDS = 400_000  # entries that a worker keeps
_CACHE: dict = {}


def cues(word: str) -> list[str]:
    w = word.lower()
    return [f"={w}", *(f"^{w[:k]}" for k in BEGINNINGS if len(w) >= k)]


class Model:
    """weights of cues, the chain, and the logistic of log(toxic tokens + 1/2) and log(tokens + 1): a, b, c."""

    def __init__(self, weights: dict[str, float], bias: float, chain: Chain, logistic: tuple[float, float, float]):
        self.weights, self.bias, self.chain, self.logistic = weights, bias, chain, logistic

    def odds(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum([get(c, 0.0) for c in cues(word)])

    def marginals(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        n = [len(s) for s in sequences]
        full = [s for s in sequences if len(s)]
        if not full:
            return sequences
        first = np.zeros(sum(n), bool)
        first[np.cumsum([0, *map(len, full)])[:-1]] = True
        post = self.chain.marginals(np.concatenate(full), first)
        return np.split(post, np.cumsum(n)[:-1])

    def score(self, expected: float, tokens: int) -> float:
        a, b, c = self.logistic
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * math.log(expected + 0.5) + c * math.log(tokens + 1)))))


class _Odds(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        v = self.model.odds(word)
        if len(self) < WORDS:
            self[word] = v
        return v


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A model from whole texts and their labels."""
    share = sum(toxic) / len(toxic) if toxic else 0.0
    if not 0 < share < 1:
        return Model({}, 0.0, Chain(np.zeros((2, 2)), np.array([0.0, -30.0])), (30.0 if share else -30.0, 0.0, 0.0))
    # The sample's words are the driver's largest structures: kept once each, and as numbers in texts.
    ids: dict[str, int] = {}
    seqs = [np.fromiter((ids.setdefault(w, len(ids)) for w in WORD.findall(t or "")), np.int64) for t in texts]
    words = list(ids)
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    in1: Counter = Counter()
    in0: Counter = Counter()
    for ws, y in zip(seqs, toxic):
        (in1 if y else in0).update({c for i in np.unique(ws) for c in cues(words[i])})
    strong = {c for c, k in in1.items() if k >= SEEN and (k + 0.5) / n1 > LIFT * (in0[c] + 0.5) / n0}
    in1.update(in0)
    number = {c: i for i, c in enumerate(sorted(c for c, k in in1.items() if k >= SEEN))}
    del in0, in1
    features, hot = [], []
    for w in words:
        cs = cues(w)
        features.append(np.array([number[c] for c in cs if c in number] + [len(number)], np.int64))
        hot.append(any(c in strong for c in cs))
    hot = np.array(hot)
    types, lens = np.concatenate(seqs), np.array([len(ws) for ws in seqs])
    first = np.zeros(len(types), bool)
    first[(np.cumsum(lens) - lens)[lens > 0]] = True
    labels = (hot[types] & (np.repeat(toxic, lens) == 1)).astype(np.int64)
    w, chain = train(types, first, labels, features, len(number) + 1)
    model = Model({c: float(w[i]) for c, i in number.items() if abs(w[i]) > 1e-9}, float(w[-1]), chain, (0.0, 1.0, 0.0))
    odds = np.bincount(np.repeat(np.arange(len(features)), [len(f) for f in features]), w[np.concatenate(features)])
    post = chain.marginals(odds[types], first)
    expected = np.array([p.sum() for p in np.split(post, np.cumsum(lens)[:-1])])
    model.logistic = _logistic(np.log(expected + 0.5), np.log(lens + 1), np.array(toxic, float))
    return model


def _logistic(x: np.ndarray, z: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps on the likelihood with a small penalty."""
    v, d = np.zeros(3), np.stack([np.ones_like(x), x, z], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ v, -500, 500)))
        h = (d * (p * (1 - p))[:, None]).T @ d + 0.1 * np.eye(3)
        step = np.linalg.solve(h, d.T @ (y - p) - 0.1 * v)
        v += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(v[0]), float(v[1]), float(v[2])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, per_kind: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels of at most per_kind training documents of either kind, the first by a hash of their ids."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out()).distinct()
    picked = None
    for y in (0, 1):
        one = rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_kind)
        picked = one if picked is None else picked.union(one)
    ids = picked.toPandas()  # at most 2 * per_kind rows
    wanted = docs.sparkSession.createDataFrame(ids.astype({"doc_id": "int64", "toxic": "int32"}), "doc_id long, toxic int")
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id", "text").toLocalIterator()
    texts: list[str] = []
    toxic: list[int] = []
    size = 0
    for r in got:
        if size + len(r.text or "") <= TEXT_LIMIT:
            size += len(r.text or "")
            texts.append(r.text or "")
            toxic.append(r.toxic)
    return texts, toxic


def tag(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, expected (number of toxic tokens), spans: start and end of toxic tokens, in characters of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("expected", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        odds = per_worker(_CACHE, id(m), lambda: _Odds(m))
        for b in slices(batches):
            texts = [t or "" for t in column(b, "text")]
            post = m.marginals([np.fromiter(map(odds.__getitem__, WORD.findall(t)), float) for t in texts])
            expected = [float(p.sum()) for p in post]
            spans = []
            for t, p in zip(texts, post):
                bad = np.flatnonzero(p >= threshold)
                spans.append([])
                if len(bad):
                    at = [x.span() for x in WORD.finditer(t)]
                    spans[-1] = [{"start": at[i][0], "end": at[i][1]} for i in bad]
            yield arrow([column(b, "doc_id"), [m.score(e, len(p)) for e, p in zip(expected, post)], expected, spans], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, expected double, spans array<struct<start: int, end: int>>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(*training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return tag(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), F.col("expected").alias("toxic_tokens"))
