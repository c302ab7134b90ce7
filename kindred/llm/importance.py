"""Resampling documents towards a target distribution by importance weights of hashed word runs.

Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII; features are all
runs of one to three consecutive words joined by one space, hashed by CRC-32 into BUCKETS buckets.
Two passes over the texts in Arrow batches:
1. each partition counts its features into one vector of BUCKETS numbers (np.bincount), and
   treeReduce adds the vectors up, so the driver gets one of them whatever the size of the table;
2. the log ratios of target to source (gains, BUCKETS numbers) are broadcast, gathered by each
   feature's bucket and summed by document (np.bincount with weights).
A document's score is its summed gain plus Gumbel noise keyed by its id, and the best share of
those with enough words is drawn: a sample without replacement by importance weights. The order
of the drawn rows comes from a range sort; no task sees all of them.

CRCs of runs come from those of their words: a CRC is linear over bits, so appending n bytes
sends it through a fixed map (four tables of 256 numbers), and only distinct words are hashed
byte by byte. Runs with a word of more than MOST bytes are hashed whole.

A null or empty text has no words and weight 0. An id that is null has the noise of an empty id and
comes last among ties. Rows that repeat an id share its noise and are scored each for itself. Without
any document, or fewer than 1 / share that are long enough, nothing is drawn. Other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import arrow, column, documents, per_worker, slices, written

BUCKETS = 10_000
RUN = 3  # words of the longest feature
MOST = 255  # bytes of a word whose CRC is appended through tables
WORDS = 400_000  # entries that a worker keeps
STEP, PIECE = 1 << 18, 1 << 20  # words handled at once; bytes of a text that are split at once
#: Bytes of words stay, capitals become small letters, all others separate.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CACHE: dict = {}


class _Words(dict):
    """Words to their CRC and, above its 32 bits, their length (MOST + 1 for all that are longer than MOST)."""

    def __missing__(self, word: bytes) -> int:
        v = zlib.crc32(word) | min(len(word), MOST + 1) << 32
        if len(self) < WORDS:
            self[word] = v
        return v


class Crc:
    """appended(c, n): what the CRCs c (of byte strings) contribute after n more bytes each; CRC(ab) = appended(CRC(a), |b|) ^ CRC(b)."""

    def __init__(self):
        byte = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
        byte ^= byte[0]  # linear part: the map of one byte's bits
        # A zero byte sends c to (c >> 8) ^ byte[c & 255], up to the constant that cancels in a combination.
        self.tables = np.zeros((MOST + 2, 4, 256), np.uint32)
        value = np.arange(256, dtype=np.uint32)
        for k in range(4):
            c = value << np.uint32(8 * k)
            for n in range(MOST + 2):
                self.tables[n, k] = c
                c = (c >> np.uint32(8)) ^ byte[c & np.uint32(255)]
        self.space = self.appended(np.full(MOST + 2, zlib.crc32(b" "), np.uint32), np.arange(MOST + 2))  # before a word of so many bytes

    def appended(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        t = self.tables.reshape(-1)
        base = n.astype(np.int32) * 1024
        out = t[base + (c & np.uint32(255)).astype(np.int32)]
        for k in (1, 2, 3):
            out ^= t[base + 256 * k + ((c >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int32)]
        return out


def words(text: str | None) -> Iterator[list[bytes]]:
    """A text's words in order, in lists of those of about PIECE bytes."""
    raw, at = (text or "").encode().translate(LETTERS), 0
    while len(raw) - at > PIECE:
        end = raw.rfind(b" ", at, at + PIECE)
        end = end if end >= at else raw.find(b" ", at + PIECE)
        if end < 0:
            break
        yield raw[at:end].split()
        at = end + 1
    yield raw[at:].split()


def runs(flat: list[bytes], doc: np.ndarray, old: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, bucket) of the features that end behind the first `old` words, and how many of them are single words."""
    crc, known = per_worker(_CACHE, "crc", lambda: (Crc(), _Words()))
    packed = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    c, n = (packed & 0xFFFFFFFF).astype(np.uint32), packed >> 32
    spaced, fresh = crc.space[n] ^ c, np.arange(len(flat)) >= old
    docs, hashes, run = [doc[old:]], [c[old:]], c
    for k in range(1, RUN):
        # The run of k words that ends one word earlier, a space, and this word.
        run = crc.appended(run[:-1], np.minimum(n[k:] + 1, MOST + 1)) ^ spaced[k:]
        for i in np.flatnonzero(n[k:] > MOST):
            run[i] = zlib.crc32(b" ".join(flat[i : i + k + 1]))
        some = (doc[k:] == doc[:-k]) & fresh[k:]
        docs.append(doc[k:][some])
        hashes.append(run[some])
    return np.concatenate(docs), (np.concatenate(hashes) % np.uint32(BUCKETS)).astype(np.int64), len(flat) - old


def features(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(place of the text in the list, bucket) of every feature of some texts, and how many rows from the top are single words.

    About STEP words are handled at once, with those before them that their runs need."""
    flat: list[bytes] = []
    owner: list[np.ndarray] = []
    old = 0
    for d, text in enumerate(texts):
        for more in words(text):
            flat += more
            owner.append(np.full(len(more), d))
            if len(flat) >= STEP:
                doc = np.concatenate(owner)
                yield runs(flat, doc, old)
                flat, owner = flat[1 - RUN :], [doc[1 - RUN :]]
                old = len(flat)
    if len(flat) > old:
        yield runs(flat, np.concatenate(owner), old)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of the column text lie in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            for _, bucket, _ in features(column(b, "text")):
                total += np.bincount(bucket, minlength=BUCKETS)
        yield pa.record_batch([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["counts"])

    vectors = texts.select("text").mapInArrow(count, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(BUCKETS, np.int64)
    return vectors.map(lambda r: np.frombuffer(r.counts, "<i8")).treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of both smoothed distributions, rounded down, by bucket."""
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + BUCKETS) / ((x + 1) * (t + BUCKETS)))) for x, y in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """1000 times a Gumbel variate of the id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, table: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS numbers
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_features", "weight", "score"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value.astype(float)
        for b in slices(batches):
            ids = column(b, "doc_id")
            n, w, size = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for doc, bucket, single in features(column(b, "text")):
                size += np.bincount(doc[:single], minlength=len(ids))
                n += np.bincount(doc, minlength=len(ids))
                w += np.bincount(doc, g[bucket], minlength=len(ids))  # whole numbers, exact below 2 ** 53
            weight = w.astype(np.int64).tolist()
            yield arrow([ids, size.tolist(), n.tolist(), weight, [x + noise(i, seed) for x, i in zip(weight, ids)]], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs: percent of those with at least `least` words are drawn."""
    table = gains(bucket_counts(docs), bucket_counts(target))
    scored = written(weigh(docs, table, seed), "weights")
    enough = F.col("n_words") >= least
    drawn = percent * scored.where(enough).count() // 100
    ranked = numbered(scored.where(enough), "rank", F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("n_features"), F.asc("n_words"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# The same in SQL: CRCs of the distinct features byte by byte, all features at once, by a recursion over places.
OP12_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT 0 AS side, row_number() OVER () AS nth, doc_id, text FROM documents
    UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
listed AS (
    SELECT side, nth, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
placed AS (SELECT side, nth, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
grams AS (
    SELECT side, nth, array_to_string(w[i:i + k - 1], ' ') AS gram FROM placed, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
bits(b, c, step) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc_table AS (SELECT b, c AS t FROM bits WHERE step = 8),
distinct_grams AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM grams)),
crcs(gram, h, c, p) AS (
    SELECT gram, h, 4294967295::BIGINT, 0 FROM distinct_grams
    UNION ALL
    SELECT gram, h, xor(c >> 8, t), p + 1
    FROM crcs JOIN crc_table ON b = xor(c & 255, ('0x' || substr(h, 2 * p + 1, 2))::BIGINT) WHERE 2 * p < length(h)),
hashed AS (SELECT gram, xor(c, 4294967295) % 10000 AS bucket FROM crcs WHERE 2 * p = length(h)),
found AS (SELECT side, nth, bucket FROM grams JOIN hashed USING (gram)),
counts AS (SELECT range AS bucket, count(f.side) FILTER (f.side = 0)::DOUBLE AS s, count(f.side) FILTER (f.side = 1)::DOUBLE AS t FROM range(10000) LEFT JOIN found f ON f.bucket = range GROUP BY 1),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts),
weights AS (SELECT nth, count(*) AS n, sum(gain)::BIGINT AS weight FROM found JOIN gains USING (bucket) WHERE side = 0 GROUP BY nth),
scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM listed LEFT JOIN weights USING (nth) WHERE side = 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features, n_words) AS place, count(*) FILTER (n_words >= 20) OVER () AS enough FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * enough // 100 THEN place END AS rank FROM ranked
"""
