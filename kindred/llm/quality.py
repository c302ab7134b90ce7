"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target text (documents labelled good) and one of
raw text (all documents), give every document the log of its probability ratio. The ratio per
n-gram, times SHARPNESS, plus Gumbel noise keyed by the id, is a document's key; the k largest
keys are a sample without replacement with weights by the ratio. k is the number of documents
whose ratio is on the good side of the boundary that separates the labelled sample best.

Tokens keep what shows quality: short words and runs of other signs stand for themselves,
longer words for their letter case.

A null or empty text has ratio 0. The decision goes by row; rows that repeat an id share the
noise, and a null id has noise of its own. Without good labels the models are equal, and every
row is kept. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MODEL, arrow, column, documents, per_worker, slices, written
from .shingles import mix

TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
BUCKETS = 1 << 16
SAMPLE = 4000  # labelled documents of either kind, at most
SHARPNESS = 64.0
CHUNKS = 300_000  # entries that a worker keeps
BINS, FEW = 4096, 4096


def shape(token: str) -> str:
    c = token[0]
    if c.isdigit():
        return "9" * min(len(token), 4)
    if not c.isalpha() or len(token) <= 3:
        return token[:4]
    return "XX" if token.isupper() else "xx" if token.islower() else "Xx" if token[1:].islower() and c.isupper() else "xX"


class _Hashes(dict):
    """Chunks between white space to their tokens' 64-bit hashes, as bytes."""

    def __missing__(self, chunk: str) -> bytes:
        v = b"".join([xxhash.xxh3_64_digest(shape(t)) for t in TOKEN.findall(chunk)])
        if len(self) < CHUNKS:
            self[chunk] = v
        return v


def grams(text: str | None) -> np.ndarray:
    """Hash buckets of a text's tokens and of its adjacent pairs of tokens."""
    known = per_worker(MODEL, "hashes", _Hashes)
    h = np.frombuffer(b"".join(map(known.__getitem__, (text or "").split())), ">u8").astype(np.uint64)
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all n-grams by bucket; at most BUCKETS rows leave each task and reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            own = [grams(t) for t in column(b, "text")]
            total += np.bincount(np.concatenate(own), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket; the target is smoothed with the raw model."""
    p = (raw + 0.1) / (raw + 0.1).sum()
    q = (target + 1000 * p) / (target.sum() + 1000)
    return np.log(q) - np.log(p)


def ratios(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, log_weight (of the whole text), per_gram (its mean)."""
    schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64()), ("per_gram", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in slices(batches):
            own = [t[grams(x)] for x in column(b, "text")]
            w = [float(np.sum(x)) for x in own]
            yield arrow([column(b, "doc_id"), w, [v / max(len(x), 1) for v, x in zip(w, own)]], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, log_weight double, per_gram double")


def boundary(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the widest gap between neighbours at which the two kinds' error shares add up to least."""
    if not len(good) or not len(bad):
        return -math.inf
    x = np.concatenate([good, bad])
    y = np.concatenate([np.full(len(good), 1 / len(good)), np.full(len(bad), -1 / len(bad))])
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    cost = np.concatenate([[0.0], np.cumsum(y)])  # lost good minus caught bad below each cut
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    gaps = np.concatenate([[1.0], np.diff(x), [1.0]])
    best = np.flatnonzero((cost <= cost.min() + 1e-12) & (gaps > 0))
    return float(edges[best[np.argmax(gaps[best])]]) if len(best) else -math.inf


def top_k(rows: DataFrame, key: str, tie: str, k: int) -> tuple[float, int | None]:
    """The k-th largest (key, smaller tie first), found by narrowing bins; only counts reach the driver.

    Returns the last key taken and the last tie at that key."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    while low < high:
        width = (high - low) / BINS
        if width == 0 or low + width == low:
            break
        inside = rows.where(F.col(key).between(low, high))
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("int"))
        counts = {r.b: (r.n, r.lo, r.hi) for r in inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            n, lo, hi = counts[b]
            if above + n >= k:
                low, high = lo, hi
                break
            above += n
        if n <= FEW:
            break
    last = rows.where(F.col(key).between(low, high)).orderBy(F.desc(key), F.asc_nulls_first(tie)).limit(k - above)
    r = last.orderBy(F.asc(key), F.desc_nulls_last(tie)).first()
    return r[key], r[tie]


def classify(docs: DataFrame, labels: DataFrame, seed: int = 17, sample: int = SAMPLE) -> DataFrame:
    """doc_id, log_weight, per_gram, key, kept."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").distinct()
    picks = {y: known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas() for y in (0, 1)}  # at most 2 * sample ids
    text = {y: docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(spark.createDataFrame(p[["doc_id"]].astype("int64"), "doc_id long")), "doc_id") for y, p in picks.items()}
    raw = gram_counts(docs)
    target = gram_counts(text[1]) if len(picks[1]) else np.zeros_like(raw)
    table = log_ratio(target, raw) if target.sum() else np.zeros(BUCKETS)
    noise = -F.log(-F.log((F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)))
    scored = written(ratios(docs, table).withColumn("key", F.col("per_gram") * SHARPNESS + noise), "ratios")
    seen = {y: scored.join(F.broadcast(spark.createDataFrame(p[["doc_id"]].astype("int64"), "doc_id long")), "doc_id").select("per_gram").toPandas().per_gram.to_numpy() for y, p in picks.items()}
    cut = boundary(seen[1], seen[0])
    k = scored.where(F.col("per_gram") >= F.lit(cut)).count()
    n = scored.count()
    if k in (0, n):
        return scored.withColumn("kept", F.lit(k == n))
    key, tie = top_k(scored, "key", "doc_id", k)
    first = F.col("doc_id").isNull() if tie is None else F.coalesce(F.col("doc_id") <= tie, F.lit(True))
    return scored.withColumn("kept", (F.col("key") > key) | ((F.col("key") == key) & first))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
