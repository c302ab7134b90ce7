"""SentencePiece encoding of merge-type (BPE) vocabularies by an agenda of adjacent pairs.

The agenda holds the adjacent symbol pairs that form a piece, best score first, ties to the
left; taking one merges it and enters its new neighbours. What is no piece in the end falls
back to bytes. No piece holds a space sign after another character, and none of several
characters holds a line break, so a text is cut there and each distinct chunk is encoded once
per worker. In each Arrow batch the chunks that are new are encoded by the sentencepiece
library too; a difference raises ValueError.

A null text is an empty one. Repeated rows and extra columns change nothing; null doc_ids stay.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, column, per_worker, slices

SPACE = "▁"
CHUNKS = 800_000  # entries kept per worker; beyond them chunks are encoded anew
SHORT, NEVER = 24, float("inf")
SIGNS = ".,;:!?%&*$#|"
_CACHE: dict = {}


class Agenda:
    def __init__(self, model: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        normal = [i for i in range(len(pieces)) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {pieces[i]: i for i in normal}
        self.score = {pieces[i]: sp.get_score(i) for i in normal}
        self.cost = {p: -s for p, s in self.score.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unk = sp.unk_id()
        self.has_bytes = all(sp.is_byte(i) for i in self.bytes)
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            self.cut = re.compile(r"(?s).+")
        elif any("\n" in p and len(p) > 1 for p in self.id):
            self.cut = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.cut = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.inner = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}  # neighbours that a merge can join
        self.parts: dict[str, tuple[int, ...]] = {}
        self.digits = [str(i) for i in range(len(pieces))]

    def merge(self, chunk: str) -> list[str]:
        sym = list(chunk)
        n, score = len(sym), self.score
        if n == 1:
            return sym
        if n <= SHORT:  # a list is the faster agenda; index() takes the leftmost of equals
            get = self.cost.get
            agenda = [get(a + b, NEVER) for a, b in zip(chunk, chunk[1:])]
            while agenda and (best := min(agenda)) is not NEVER:
                i = agenda.index(best)
                sym[i : i + 2] = [sym[i] + sym[i + 1]]
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = get(sym[i] + sym[i + 1], NEVER)
                if i:
                    agenda[i - 1] = get(sym[i - 1] + sym[i], NEVER)
            return sym
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            p = sym[i] + sym[i + 1]
            if p in score:
                agenda.append((-score[p], i, p))
        heapq.heapify(agenda)
        while agenda:
            _, i, p = heapq.heappop(agenda)
            j = right[i]
            if sym[i] is None or j >= n or len(sym[i]) + len(sym[j]) != len(p):
                continue  # one of the two has been merged since
            sym[i], sym[j] = p, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                q = p + sym[k]
                if q in score:
                    heapq.heappush(agenda, (-score[q], i, q))
            h = left[i]
            if h >= 0:
                q = sym[h] + p
                if q in score:
                    heapq.heappush(agenda, (-score[q], h, q))
        return [s for s in sym if s is not None]

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Of a word and signs behind it that no piece joins, each is encoded by itself: words return with other signs."""
        word = chunk.rstrip(SIGNS)
        if len(word) < len(chunk) and word and word[-1] + chunk[len(word)] not in self.inner:
            return self._part(word) + self._part(chunk[len(word) :])
        return self._part(chunk)

    def _part(self, chunk: str) -> tuple[int, ...]:
        v = self.chunks.get(chunk) or self.parts.get(chunk)
        if v is None:
            v = self._merged(chunk)
            if len(self.parts) < CHUNKS // 2:
                self.parts[chunk] = v
        return v

    def _merged(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for s in self.merge(chunk):
            i = self.id.get(s)
            if i is not None:
                out.append(i)
            elif self.has_bytes:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unk)
        return tuple(out)

    def split(self, text: str) -> list[str]:
        """The chunks of a text, with the space sign that the library puts in front."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; chunks that are new are checked by the library."""
        cut, known = [self.split(t) for t in texts], self.chunks
        new = {c for cs in cut for c in cs if c not in known}
        fresh: dict[str, tuple[int, ...]] = {}
        if new:
            # A chunk without a sign in front follows a line break: the break is put before it.
            asked = [c for c in new if c != "\n"]
            said = self.sp.encode([c[1:] if c[0] == SPACE else "\n" + c for c in asked], num_threads=1)
            start = tuple(self.encode_chunk(SPACE) + self.encode_chunk("\n"))
            for c, ids in zip(asked, said):
                own = self.encode_chunk(c)
                if c != SPACE and tuple(ids) != (own if c[0] == SPACE else start + own):
                    raise ValueError(f"the library encodes {c!r} as {ids}, the agenda as {own}")
                fresh[c] = own
            if "\n" in new:
                own = self.encode_chunk("\n")
                if tuple(self.sp.encode("\n")) != start:
                    raise ValueError("the library encodes a line break otherwise")
                fresh["\n"] = own
            if len(known) < CHUNKS:
                known.update(fresh)
        return [[i for c in cs for i in (known.get(c) or fresh[c])] for cs in cut]


def encode_pieces(docs: DataFrame, model: str, end: bool = True) -> DataFrame:
    """doc_id, ids (array), decoded (text): the library's ids with an end id, and its decoding of them."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = per_worker(_CACHE, model, lambda: Agenda(model))
        for b in slices(batches):
            ids = [x + [a.sp.eos_id()] * end for x in a.batch([t or "" for t in column(b, "text")])]
            yield arrow([column(b, "doc_id"), ids, [a.sp.decode(x) for x in ids]], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """encode_pieces() with digests instead of the ids and the text, which then never leave the worker."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = per_worker(_CACHE, model, lambda: Agenda(model))
        eos = a.sp.eos_id()
        for b in slices(batches):
            n, sha, dec = [], [], []
            for ids in a.batch([t or "" for t in column(b, "text")]):
                ids.append(eos)
                n.append(len(ids))
                sha.append(hashlib.sha256(" ".join(map(a.digits.__getitem__, ids)).encode()).hexdigest())
                dec.append(hashlib.sha256(a.sp.decode(ids).encode()).hexdigest())
            yield arrow([column(b, "doc_id"), n, sha, dec], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import documents

    return piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
