"""Token-id output: documents in ascending doc_id order as files of rANS blocks.

A file set is a folder with two Parquet containers: `model` (one row: the frequency table) and
`blocks` (one row a block: its place, its documents' ids and lengths, its rANS bytes).

Every document ends with `end_id`. A null text is an empty one. A null doc_id sorts first and
stays null; rows that repeat a doc_id are separate documents, ordered by text. An empty table
gives an empty file set. Other columns are ignored. A document is never split over blocks; one
of any length is a block with as many checkpoints as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import arrow, column, drop, new_path, per_worker, slices, written
from .words import word_ids

BLOCK = 131_072  # ids after which a block ends
RAW = "part int, block int, start long, doc_ids array<long>, lengths array<long>, ids binary"
_TABLES: dict = {}


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int, partitions: int) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, block, start = word_ids(tokenizer), TaskContext.get().partitionId(), 0, 0
        kind = "<u2" if words.vocab_size <= 1 << 16 and end_id < 1 << 16 else "<u4"
        docs_, lens, parts, n = [], [], [], 0

        def out():
            raw = np.frombuffer(b"".join(parts), "<u4").astype(kind).tobytes()
            return arrow([[part], [block], [start], [docs_], [lens], [raw]], schema)

        for b in slices(batches):
            for i, text in zip(column(b, "doc_id"), column(b, "text")):
                x = words.ids(text) + end
                docs_.append(i)
                lens.append(len(x) // 4)
                parts.append(x)
                n += len(x) // 4
                if n >= BLOCK:
                    yield out()
                    block, start = block + 1, start + n
                    docs_, lens, parts, n = [], [], [], 0
        if docs_:
            yield out()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, RAW)


def _width(raw: bytes, lengths: list[int]) -> np.ndarray:
    n = sum(lengths)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, partitions: int | None = None) -> str:
    """Tokenizes once, counts the ids (at most the vocabulary's size reaches the driver) and writes the blocks."""
    spark = docs.sparkSession
    raw = written(_tokenized(docs, tokenizer, end_id, partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))), "raw-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for ids, lens in zip(column(b, "ids"), column(b, "lengths")):
                c = np.bincount(_width(ids, lens))
                total = np.pad(total, (0, max(0, len(c) - len(total))))
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = raw.select("ids", "lengths").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    freq = np.zeros(max((r.id for r in counts), default=0) + 1, np.int64)
    for r in counts:
        freq[r.id] = r.n
    spark.createDataFrame([(freq.astype("<i8").tobytes(),)], "counts binary").write.parquet(f"{path}/model")

    # One row a partition: the ids of the partitions before it.
    before, at = {}, 0
    for r in raw.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        before[r.part], at = at, at + r.n
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("coded", pa.binary())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = rans.Table(freq)
        for b in slices(batches, 8):
            part, lens = column(b, "part"), column(b, "lengths")
            coded = [rans.encode(_width(x, n), t) for x, n in zip(column(b, "ids"), lens)]
            yield arrow([part, column(b, "block"), [s + before[p] for p, s in zip(part, column(b, "start"))], column(b, "doc_ids"), lens, coded], schema)

    raw.mapInArrow(code, RAW.replace("ids binary", "coded binary")).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop(raw)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    freq = np.frombuffer(spark.read.parquet(f"{path}/model").first().counts, "<i8")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = per_worker(_TABLES, freq.tobytes(), lambda: rans.Table(freq))
        for b in slices(batches, 4):
            for start, docs, lens, coded in zip(*(column(b, c) for c in ("start", "doc_ids", "lengths", "coded"))):
                raw, at, rows = rans.decode(coded, t).astype("<u4").tobytes(), 0, []
                for n in lens:
                    rows.append(raw[4 * at : 4 * (at + n)])
                    at += n
                starts = (np.cumsum([0, *lens[:-1]]) + start).tolist()
                yield arrow([docs, starts, lens, rows, [zlib.crc32(x) for x in rows]], schema)

    blocks = spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "lengths", "coded")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import documents

    path = write_token_files(documents(spark, sf_dir), new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path).drop("ids")
