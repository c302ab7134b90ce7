"""Removal of passages that documents with smaller ids hold: every byte covered by a string of
SPAN bytes that also starts in a document with a smaller doc_id goes.

Equal strings are brought together by content: in every SPAN-byte window the smallest hash of
its K-byte grams is an anchor, so equal windows have equal anchors at the same place in them.
Documents lie in homes, rows of a stored table of about HOME bytes of text each.
1. Homes send their distinct anchors, as 32-bit numbers, to buckets of the hash range, and
   learn which occur in other documents.
2. For those anchors homes send the context that can hold windows around them, one row for
   each distinct context with its first document. Every form of a context is settled by that
   form's first document. Where an anchor has several forms, they are cut to what they can share.
   Where different cuts remain, a suffix array of them (linear grouping construction, see
   suffixes.py) puts equal windows side by side, and each learns its first document.
3. Homes learn for each context which windows started in an earlier document, and remove.
A home sends a context once, whatever number of its documents hold it: hot passages cost one
row per home. Hashes only sort contexts; their bytes decide whether they are equal.

Null texts are empty; texts under SPAN bytes lose nothing. A row without an id loses nothing
and takes nothing from others. Rows that repeat an id do not affect each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, drop, release, slices, written, written_in_buckets
from .shingles import mix
from .suffixes import suffix_array

SPAN, K = 50, 24
SIDE = SPAN - K  # bytes that a window can reach beyond its anchor
CTX = SPAN + SIDE
WINDOWS = SIDE + 1
HOME = 4 << 20
PIECE = 50_000  # contexts settled at once, beyond a single anchor's
BLOCK = 1 << 16  # bytes that one suffix array sorts, beyond a single anchor's
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))  # fixed values: odd multipliers


def _sliding(x: np.ndarray, f) -> np.ndarray:
    """f over every WINDOWS neighbours, by doubling."""
    n = 1
    while 2 * n <= WINDOWS:
        x, n = f(x[:-n], x[n:]), 2 * n
    return f(x[: -(WINDOWS - n)], x[WINDOWS - n :]) if n < WINDOWS else x


def _gram(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hashes of grams from their three words."""
    h = x * A
    h ^= h >> np.uint64(31)
    h += y * B
    h ^= h >> np.uint64(29)
    h += z * C
    h ^= h >> np.uint64(32)
    h *= A
    return h


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are the smallest of some window."""
    n = len(raw)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = np.ndarray((n - 7,), "<u8", raw, 0, (1,)).copy()
    h = _gram(x[: n - 23], x[8 : n - 15], x[16:])
    low = np.zeros(n - SPAN + 1 + 2 * SIDE, np.uint64)
    low[SIDE : len(low) - SIDE] = _sliding(h, np.minimum)
    at = np.flatnonzero(_sliding(low, np.maximum) == h)
    return at, mix(h[at])


def _words(m: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, which compare as the rows do."""
    m = np.pad(m, ((0, 0), (0, -m.shape[1] % 8)))
    return np.ascontiguousarray(m).view(">u8").astype(np.uint64)


def _hash(m: np.ndarray, *more: np.ndarray) -> np.ndarray:
    out = np.full(len(m), B, np.uint64)
    for w in [*_words(m).T, *(x.astype(np.uint64) for x in more)]:
        out = (out ^ w) * A
        out ^= out >> np.uint64(29)
    return mix(out)


def contexts(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CTX bytes around each anchor, with 255 (in no UTF-8) beyond the text, and the text's range in them."""
    pad = np.frombuffer(b"\xff" * SIDE + raw + b"\xff" * SIDE, np.uint8)
    lo, hi = np.maximum(SIDE - at, 0), np.minimum(len(raw) - at + SIDE, CTX)
    return np.lib.stride_tricks.sliding_window_view(pad, CTX)[at], lo.astype(np.uint8), hi.astype(np.uint8)


def of_contexts(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors and the text's ranges, from the bytes alone."""
    x = np.ascontiguousarray(ctx[:, SIDE:SPAN]).view("<u8").astype(np.uint64)
    lo, hi = (ctx[:, :SIDE] == 255).sum(axis=1), CTX - (ctx[:, SPAN:] == 255).sum(axis=1)
    return mix(_gram(x[:, 0], x[:, 1], x[:, 2])), lo.astype(np.uint8), hi.astype(np.uint8)


def planes(*fields: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: it compresses better."""
    return b"".join(np.ascontiguousarray(f).view(np.uint8).reshape(len(f), f.dtype.itemsize).T.tobytes() for f in fields)


def unplanes(raw: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


def window_bits(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bit t is set if the window from byte t of the context lies between lo and hi."""
    lo, n = lo.astype(np.uint64), np.maximum(hi.astype(np.int64) - SPAN + 1 - lo.astype(np.int64), 0).astype(np.uint64)
    return (((np.uint64(1) << n) - np.uint64(1)) << lo).astype(np.uint32)


def _shared(side: np.ndarray, length: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The most bytes that each row's side has in common with another row of the same anchor."""
    w = _words(side)
    order = np.lexsort((*w.T[::-1], g))
    s, n, gs = side[order], length[order].astype(np.int64), g[order]
    same = np.logical_and.accumulate(s[1:] == s[:-1], axis=1).sum(axis=1)
    lcp = np.where(gs[1:] == gs[:-1], np.minimum(same, np.minimum(n[1:], n[:-1])), 0)
    out = np.zeros(len(g), np.int64)
    out[order] = np.maximum(np.concatenate([[0], lcp]), np.concatenate([lcp, [0]])) if len(g) else 0
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys starts, in sorted rows."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _forms(g: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Where a new anchor or other bytes start. Rows sorted by hash that share it without being equal
    are new forms each: the suffix array then finds what they have in common."""
    new = _runs(g)
    if len(new):
        new[1:] |= (ctx[1:] != ctx[:-1]).any(axis=1)
    return new


def first_documents(strings: list[bytes], shift: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(strings, WINDOWS): for the window at each place the smallest first document of equal windows.

    One suffix array orders all suffixes; those that start a window inside their string keep
    this order, so equal windows are neighbours."""
    big = np.iinfo(np.int64).max
    out = np.full((len(strings), WINDOWS), big, np.int64)
    text = b"\xff".join(strings) + b"\xff" * 8
    size = np.array([len(s) for s in strings])
    begin = np.cumsum(np.concatenate([[0], size[:-1] + 1]))
    sa = np.array(suffix_array(text[:-8]), np.int64)
    own = np.searchsorted(begin, sa, "right") - 1
    ok = sa + SPAN <= begin[own] + size[own]
    sa, own = sa[ok], own[ok]
    x = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    new = _runs(*(x[sa + o] for o in (*range(0, SPAN - 7, 8), SPAN - 8)))
    group = np.cumsum(new) - 1
    low = np.minimum.reduceat(first[own], np.flatnonzero(new))
    out[own, sa - begin[own] + shift[own]] = low[group]
    return out


def settle(g: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """For each context with its first document of a home: the windows that an earlier document holds, as bits."""
    out = np.zeros(len(g), np.uint32)
    h = _hash(ctx, lo, hi)
    order = np.lexsort((doc, h, g))
    gs, ds = g[order], doc[order]
    newc, newg = _forms(gs, ctx[order]), _runs(gs)
    cid = np.cumsum(newc) - 1  # distinct contexts
    rep = order[newc]
    cdoc = doc[rep]
    anchor = (np.cumsum(newg) - 1)[newc]
    forms = np.bincount(anchor) if len(anchor) else np.zeros(0, np.int64)
    # A form's first document settles all windows of its other rows.
    alone = forms[anchor] == 1
    full = window_bits(lo[rep], hi[rep])
    out[order] = np.where(cdoc[cid] < ds, full[cid], 0)
    # Several forms: each is also cut to what it shares with any other.
    m = np.flatnonzero(~alone)
    if not len(m):
        return out
    c, mg = ctx[rep[m]], anchor[m]
    right = _shared(c[:, SPAN:], hi[rep[m]].astype(np.int64) - SPAN, mg)
    left = _shared(c[:, SIDE - 1 :: -1], SIDE - lo[rep[m]].astype(np.int64), mg)
    some = left + right + K >= SPAN
    m, c, mg, a, z = m[some], c[some], mg[some], (SIDE - left)[some], (SPAN + right)[some]
    place = np.arange(CTX)
    c = np.where((place >= a[:, None]) & (place < z[:, None]), c, 255).astype(np.uint8)
    th = _hash(c, a, z)
    torder = np.lexsort((cdoc[m], th, mg))
    newt = _forms(mg[torder], c[torder])
    trep = torder[newt]  # distinct cuts, each with its first document
    tid = np.empty(len(m), np.int64)
    tid[torder] = np.cumsum(newt) - 1
    kinds = np.bincount(mg[trep], minlength=len(forms))
    big = np.iinfo(np.int64).max
    first = np.full((len(trep), WINDOWS), big, np.int64)
    inside = (np.arange(WINDOWS) >= a[trep][:, None]) & (np.arange(WINDOWS) + SPAN <= z[trep][:, None])
    first[inside] = np.broadcast_to(cdoc[m[trep]][:, None], inside.shape)[inside]
    contested = np.flatnonzero(kinds[mg[trep]] > 1)
    size = np.cumsum((z - a)[trep[contested]] + 1)
    # Blocks end between anchors.
    ends = np.flatnonzero(_runs(mg[trep[contested]])) if len(contested) else np.zeros(0, np.int64)
    start = 0
    for e in [*ends[1:], len(contested)]:
        if e > start and (e == len(contested) or size[e - 1] - (size[start - 1] if start else 0) >= BLOCK):
            t = contested[start:e]
            strings = [c[i, a[i] : z[i]].tobytes() for i in trep[t]]
            first[t] = np.minimum(first[t], first_documents(strings, a[trep[t]], cdoc[m[trep[t]]]))
            start = e
    # Every row of a context compares its own document with each window's first.
    where = np.full(len(rep), -1, np.int64)
    where[m] = tid
    rows = np.flatnonzero(where[cid] >= 0)
    early = first[where[cid[rows]]] < ds[rows][:, None]
    out[order[rows]] |= (early.astype(np.uint32) << np.arange(WINDOWS, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    return out


class Home:
    """The documents of one row of the home table, and their anchors."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.raw = ids, [(t or "").encode() for t in texts]
        found = [anchors(r) if i is not None else anchors(b"") for i, r in zip(ids, self.raw)]
        self.at = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in found)])
        self.g = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in found)])
        self.doc = np.repeat(np.arange(len(ids)), [len(a) for a, _ in found])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchors, and whether several documents here have each."""
        order = np.lexsort((self.doc, self.g))
        g, d = self.g[order], np.array([-1 if i is None else i for i in self.ids], np.int64)[self.doc[order]]
        if not len(g):
            return g, np.zeros(0, bool)
        new = np.flatnonzero(_runs(g))
        return g[new], np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new)


def _bounds(g: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of sorted hashes starts, and the end."""
    step = (1 << 64) // buckets + 1
    return np.searchsorted(g, np.array([min(b * step, (1 << 64) - 1) for b in range(buckets)], np.uint64)).tolist() + [len(g)]


ENTRY = np.dtype([("g", "<u8"), ("doc", "<i8"), ("lo", "u1"), ("hi", "u1"), ("ctx", "u1", CTX)])
SEEN = {"doc": "<i4", "at": "<i8", "entry": "<i4", "lo": "u1", "hi": "u1", "later": "?"}  # of every anchor asked for
ROW = 8 + CTX  # bytes sent for a context: its first document here, and itself


def make_homes(docs: DataFrame, home_bytes: int = HOME) -> DataFrame:
    """All columns of docs as lists, one row for about home_bytes of text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            cols = [pa.array([(part << 32) + seq])]
            for c in range(t.num_columns):
                v = t.column(c)
                v = v.chunk(0) if v.num_chunks == 1 else pa.concat_arrays(v.chunks)
                cols.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
            return pa.RecordBatch.from_arrays(cols, names=["home", *names])

        for b in slices(batches, 16):
            held.append(b)
            size += b.get_total_buffer_size() if b.nbytes == 0 else b.nbytes
            if size >= home_bytes:
                yield out()
                seq, held, size = seq + 1, [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, "home long, " + ", ".join(f"`{c}` array<{k}>" for c, k in docs.dtypes))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", home_bytes: int = HOME) -> DataFrame:
    """Columns of docs but the text, then kept (binary: the bytes left), n_bytes, n_removed, n_spans, spans (starts
    and ends) and kept_text (the bytes left as text, without characters that lost some of their bytes; null for null).

    A column of docs that has the name of one of these results is left out."""
    spark, given_names = docs.sparkSession, docs.columns
    docs = docs.toDF(*(f"_{k}" for k in range(len(given_names))))  # no name of theirs meets one of ours
    id_column, text_column = (f"_{given_names.index(c)}" for c in (id_column, text_column))
    total = docs.select(F.sum(F.octet_length(text_column).cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (24 << 20) + 1)
    # Homes lie in files by their hash: what others say of them comes to them, their texts never move.
    homes = written_in_buckets(make_homes(docs, home_bytes), "homes", "home", buckets)
    here = homes.select("home", F.col(id_column).alias("ids"), F.col(text_column).alias("texts"))

    def by_home(said: DataFrame) -> DataFrame:
        """What is said of a home as one row: at most buckets + 1 of its columns' structs."""
        rest = [c for c in said.columns if c != "home"]
        return said.repartition(buckets, "home").groupBy("home").agg(F.collect_list(F.struct(*rest)).alias("replies")).hint("shuffle_hash")


    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches, 1):
            g, several = Home(column(b, "ids")[0], column(b, "texts")[0]).distinct()
            cut = _bounds(g, buckets)
            own = [k for k in range(buckets) if cut[k] < cut[k + 1]]
            low = (g & np.uint64(0xFFFFFFFF)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([column(b, "home")[0]] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array([low[cut[k] : cut[k + 1]].tobytes() for k in own], pa.binary()), pa.array([several[cut[k] : cut[k + 1]].tobytes() for k in own], pa.binary())],
                names=["home", "bucket", "low", "several"],
            )

    def meet(t: pa.Table) -> pa.Table:
        low = [np.frombuffer(x, "<u4") for x in t.column("low").to_pylist()]
        flags = np.concatenate([np.frombuffer(x, bool) for x in t.column("several").to_pylist()])
        every = np.concatenate(low)
        order = np.argsort(every, kind="stable")
        new = np.flatnonzero(_runs(every[order]))
        n = np.diff(np.concatenate([new, [len(every)]]))
        flags[order] = np.repeat((n > 1) | np.logical_or.reduceat(flags[order], new), n)
        cut = np.cumsum([len(x) for x in low])[:-1]
        return pa.table({"home": t.column("home"), "bucket": t.column("bucket"), "flags": pa.array([np.packbits(f).tobytes() for f in np.split(flags, cut)], pa.binary())})

    flags = written(here.mapInArrow(send, "home long, bucket int, low binary, several binary").groupBy("bucket").applyInArrow(meet, "home long, bucket int, flags binary"), "flags")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, 1):
            home, said = Home(column(b, "ids")[0], column(b, "texts")[0]), {r["bucket"]: r["flags"] for r in column(b, "replies")[0] or []}
            g, _ = home.distinct()
            cut = _bounds(g, buckets)
            shared = g[np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(said[k], np.uint8), count=cut[k + 1] - cut[k]).astype(bool) for k in range(buckets) if cut[k] < cut[k + 1])])]
            at = np.searchsorted(shared, home.g)
            at[at == len(shared)] = 0
            keep = np.flatnonzero(shared[at] == home.g) if len(shared) else np.zeros(0, np.int64)
            entry = np.zeros(len(keep), ENTRY)
            doc = home.doc[keep]
            for d, s, e in zip(*_spans(doc)):
                entry["ctx"][s:e], entry["lo"][s:e], entry["hi"][s:e] = contexts(home.raw[d], home.at[keep[s:e]])
            entry["g"] = home.g[keep]
            ids = np.array([-1 if i is None else i for i in home.ids], np.int64)
            entry["doc"] = ids[doc]
            h = _hash(entry["ctx"], entry["lo"], entry["hi"])
            order = np.lexsort((entry["doc"], h, entry["g"]))
            new = _forms(entry["g"][order], entry["ctx"][order])
            sent = entry[order[new]]
            which = np.empty(len(keep), np.int64)
            which[order] = np.cumsum(new) - 1
            seen = {"doc": doc, "at": home.at[keep], "entry": which, "lo": entry["lo"], "hi": entry["hi"], "later": entry["doc"] > sent["doc"][which]}
            cut = _bounds(sent["g"], buckets)
            own = [k for k in range(buckets) if cut[k] < cut[k + 1]]
            name = column(b, "home")[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(own) + 1), pa.int64()), pa.array([*own, -1], pa.int32()), pa.array([*(zip_.compress(planes(sent["doc"][cut[k] : cut[k + 1]]) + sent["ctx"][cut[k] : cut[k + 1]].tobytes()) for k in own), zip_.compress(planes(*(seen[c].astype(t) for c, t in SEEN.items())))], pa.binary())],
                names=["home", "bucket", "data"],
            )

    asked = written(here.join(by_home(flags), "home", "left").mapInArrow(ask, "home long, bucket int, data binary"), "contexts")
    drop(flags)

    def answer(t: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        rows = [unzip.decompress(x) for x in t.column("data").to_pylist()]
        sizes = [len(x) // ROW for x in rows]
        doc = np.concatenate([unplanes(x[: 8 * n], "<i8")[0] for x, n in zip(rows, sizes)])
        ctx = np.concatenate([np.frombuffer(x, np.uint8, n * CTX, 8 * n).reshape(n, CTX) for x, n in zip(rows, sizes)])
        del rows
        g, lo, hi = of_contexts(ctx)
        order = np.argsort(g, kind="stable")
        ends = np.append(np.flatnonzero(_runs(g[order])), len(g))
        bits, start = np.zeros(len(g), np.uint32), 0
        for end in ends[1:]:  # pieces end between anchors
            if end - start >= PIECE or end == len(g):
                x = order[start:end]
                bits[x] = settle(g[x], doc[x], lo[x], hi[x], ctx[x])
                start = end
        cut = np.cumsum(sizes)[:-1]
        return pa.table({"home": t.column("home"), "bucket": t.column("bucket"), "data": pa.array([x.astype("<u4").tobytes() for x in np.split(bits, cut)], pa.binary())})

    answers = written(asked.where("bucket >= 0").groupBy("bucket").applyInArrow(answer, "home long, bucket int, data binary").union(asked.where("bucket < 0")), "answers")
    drop(asked)
    results = ["kept", "n_bytes", "n_removed", "n_spans", "spans", "kept_text"]
    back = {f"_{k}": c for k, c in enumerate(given_names) if c.lower() not in results}
    rest = [c for c in docs.columns if c != text_column and c in back]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches, 1):
            said = {r["bucket"]: r["data"] for r in column(b, "replies")[0] or []}
            bits = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(said[k], "<u4") for k in sorted(said) if k >= 0)])
            seen = dict(zip(SEEN, unplanes(zstandard.ZstdDecompressor().decompress(said[-1]) if -1 in said else b"", *SEEN.values())))
            raw = [(t or "").encode() for t in column(b, text_column)[0]]
            sizes = np.array([len(r) for r in raw], np.int64)
            begin = np.cumsum(np.concatenate([[0], sizes]))
            mine = np.where(seen["later"], window_bits(seen["lo"], seen["hi"]), bits[seen["entry"]] if len(bits) else 0).astype(np.uint32)
            starts = np.zeros(begin[-1] + 1, np.int32)
            base = begin[seen["doc"]] + seen["at"] - SIDE
            for t in range(WINDOWS):
                starts[base[(mine >> np.uint32(t)) & np.uint32(1) == 1] + t] = 1
            run = np.cumsum(starts)
            gone = (run[:-1] - np.concatenate([np.zeros(min(SPAN, len(run) - 1), np.int32), run[: max(len(run) - 1 - SPAN, 0)]])) > 0
            given = column(b, text_column)[0]
            spans, kept, n_removed = [], [], []
            for i, r in enumerate(raw):
                own = gone[begin[i] : begin[i + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans.append(edge.tolist())
                n_removed.append(int(own.sum()))
                kept.append(np.frombuffer(r, np.uint8)[~own].tobytes() if len(edge) else r)
            cols = [b.column(b.schema.get_field_index(c))[0].values for c in rest]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([None if t is None else k.decode(errors="ignore") for t, k in zip(given, kept)], pa.string())],
                names=[*rest, "kept", "n_bytes", "n_removed", "n_spans", "spans", "kept_text"],
            )

    kinds = dict(docs.dtypes)
    out = homes.join(by_home(answers), "home", "left").mapInArrow(cut_out, "".join(f"`{c}` {kinds[c]}, " for c in rest) + "kept binary, n_bytes long, n_removed long, n_spans long, spans array<long>, kept_text string")
    return out.select(*(F.col(c).alias(back[c]) for c in rest), *results)


def _spans(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, end) of the runs in a sorted array."""
    s = np.flatnonzero(_runs(doc)) if len(doc) else np.zeros(0, np.int64)
    return doc[s], s, np.concatenate([s[1:], [len(doc)]]).astype(np.int64)[: len(s)]


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
