"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is CHUNKS x WIDE values of 16 bits. Two signatures that differ in at
most CHUNKS * (errors + 1) - 1 places differ in at most `errors` places of some chunk (pigeonhole),
so each chunk is indexed once for every choice of `errors` places left out: equal remainders meet
in a bucket. With 12 chunks of 5 and 1 error, the default, all pairs within 23 of 60 places are found:
a pair of similarity 0.85 differs in 9 on average, and in more than 23 in 2 cases of a million (0.8: 12, and 3 of
10 000; most copies have more than one link). With errors=2 it is 35 places, missed by 2 of 1e15 pairs (0.8: 1e-11),
for 2.5 times as many rows in buckets.
Every candidate is confirmed on its full shingle sets.

Documents with equal sets are one class, of which only a representative is indexed. Each
representative is first compared with one other, the smallest that it shares a bucket with: this
connects a group of near copies with work linear in its size. Buckets that then still hold
different components tie their members into clusters; each member goes, with its text, to its
cluster (to each pair of stripes of a large one), where near signatures are compared and
confirmed, the nearest first, unless they are connected already. Only links that join what is
not yet connected come out, so a group of copies makes no row for each pair, and no link
between different components is lost.

A document without words has n_shingles 0 and no link. Null texts are empty. A row without an
id takes no part: its component_id is null, and it is kept. Rows that repeat an id are
one document, which has the links of all its texts: each gets the same component. Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, column, documents, drop, kept_path, release, slices, written
from .components import components
from .shingles import common, mix, odd, shingle_set, signature

CHUNKS, WIDE = 12, 5
ERRORS = 1  # places of a chunk that may differ, unless an argument says otherwise
TILE = 2048
FAR = 255  # a distance that is no candidate's
SPREAD = 1024  # members that one copy of their hub's text is compared with


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (the set's 128-bit digest), sig, text_hash."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary()), ("text_hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        factors = odd("minhash", CHUNKS * WIDE)
        for b in slices(batches):
            n, digests, sigs = [], [], []
            for text in column(b, "text"):
                s = shingle_set(text, size)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s, factors).tobytes())
            d = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield arrow([column(b, "doc_id"), n, d[:, 0], d[:, 1], sigs, column(b, "text_hash")], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary, text_hash long")


def bucket_keys(sigs: np.ndarray, errors: int = ERRORS) -> np.ndarray:
    """(documents, keys): a 64-bit key for each chunk and choice of `errors` places left out."""
    out = []
    for c in range(CHUNKS):
        own = sigs[:, c * WIDE : (c + 1) * WIDE].astype(np.uint64)
        for left in combinations(range(WIDE), errors):
            key = np.full(len(sigs), (c << 8) + sum(1 << i for i in left) + 1, np.uint64)
            for i in range(WIDE):
                if i not in left:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, i])
            out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def _keys(reps: DataFrame, errors: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches, 2048):
            sigs = np.frombuffer(b"".join(column(b, "sig")), np.uint16).reshape(b.num_rows, -1)
            keys = bucket_keys(sigs, errors)
            cid = np.repeat(b.column(b.schema.get_field_index("cid")).to_numpy(), keys.shape[1])
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(cid)], ["key", "cid"])

    return reps.select("cid", "sig").mapInArrow(run, "key long, cid long")


def _live(reps: DataFrame, errors: int) -> DataFrame:
    """(key, cid, hub) of the buckets that hold several representatives; hub is the smallest of a bucket."""
    keys = _keys(reps, errors)
    buckets = keys.groupBy("key").agg(F.min("cid").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    return keys.join(buckets, "key").select("key", "cid", "hub")


def _roots(up: DataFrame) -> DataFrame:
    """(label, root) of a forest (label, parent) whose roots are their own parents, by pointer jumping."""
    now = written(up.select("label", "parent"), "forest")
    while True:
        above = now.select(F.col("label").alias("parent"), F.col("parent").alias("top"))
        new = written(now.select("label", "parent").join(above, "parent").select("label", F.col("top").alias("parent"), (F.col("top") < F.col("parent")).alias("moved")), "forest")
        drop(now)
        now = new
        if now.where("moved").isEmpty():
            return kept_path(now.select("label", F.col("parent").alias("root")), now)


def _clusters(rest: DataFrame) -> DataFrame:
    """(cid, cluster, size): representatives that the buckets of (key, cid) connect, whether or not they are similar.

    In each round every label ties itself to the smallest label of its buckets, so a round has one edge for
    each label; buckets that then hold one label are done with. The rounds end when no bucket holds two."""
    live = written(rest.select("key", F.col("cid").alias("label")).distinct(), "buckets")
    labels = written(rest.select("cid").distinct().select("cid", F.col("cid").alias("label")), "labels")
    while True:
        hubs = live.groupBy("key").agg(F.min("label").alias("hub"))
        roots = _roots(live.join(hubs, "key").groupBy("label").agg(F.min("hub").alias("parent")))
        new_labels = written(labels.join(roots, "label", "left").select("cid", F.coalesce("root", "label").alias("label")), "labels")
        moved = live.join(roots, "label").select("key", F.col("root").alias("label")).distinct()
        several = moved.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        new_live = written(moved.join(several, "key"), "buckets")
        for done in (live, labels, roots):
            drop(done)
        live, labels = new_live, new_labels
        if live.isEmpty():
            drop(live)
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    return labels.join(sizes, "label").select("cid", F.col("label").alias("cluster"), "size")


def _bodies(reps: DataFrame, live: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, n_shingles, sig, text) of the representatives in buckets."""
    texts = docs.select(F.col("doc_id").cast("long").alias("cid"), "text").join(live.select("cid").distinct(), "cid").withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["cid", "text_hash"])
    return texts.join(reps, ["cid", "text_hash"]).select("cid", "n_shingles", "sig", "text")


def _hub_links(live: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): links of representatives to the smallest hub of their buckets, confirmed on full sets.

    A hub's members are dealt by a hash in parts of about SPREAD, each with a copy of the hub's text
    in front, and compared as they stream by: no group of copies is held or compared with itself."""
    own = written(live.where("hub < cid").groupBy("cid").agg(F.min("hub").alias("hub")), "hubs")
    parts = written(own.groupBy("hub").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts")), "parts")
    members = own.join(parts, "hub").select("hub", F.pmod(F.xxhash64("cid"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), "cid")
    heads = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("hub").alias("cid"))
    dealt = members.union(heads).join(bodies.select("cid", "text"), "cid").select("hub", "part", "role", "cid", "text")
    dealt = dealt.repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at, head = None, np.zeros(0, np.uint64)
        for b in slices(batches):
            us, vs = [], []
            for hub, part, role, cid, text in zip(*(column(b, c) for c in ("hub", "part", "role", "cid", "text"))):
                if role:
                    if similar(head, shingle_set(text, size), percent):
                        us.append(hub)
                        vs.append(cid)
                elif at != (hub, part):  # another text under the hub's id waits for the tiles
                    at, head = (hub, part), shingle_set(text, size)
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = common(x, y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def linked(cid: np.ndarray, label: np.ndarray, n: np.ndarray, sigs: np.ndarray, texts: list, left: np.ndarray, right: np.ndarray, size: int, percent: int, errors: int = ERRORS) -> list[tuple[int, int]]:
    """Links that connect all similar pairs of different labels between rows `left` and rows `right` (each pair once):
    near pairs by signature, the nearest first, confirmed on full sets unless links or labels already connect them."""
    near = np.full((len(left), len(right)), FAR, np.uint8)  # a byte a pair, however many of them are near
    for i in range(0, len(left), 64):
        x = left[i : i + 64]
        d = (sigs[x][:, None, :] != sigs[right][None, :, :]).sum(axis=2)
        nx, ny = n[x][:, None], n[right][None, :]
        ok = (d < CHUNKS * (errors + 1)) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (label[x][:, None] != label[right][None, :])
        if left is right:
            ok &= x[:, None] < right[None, :]
        near[i : i + 64] = np.where(ok, d, FAR)
    sets: dict[int, np.ndarray] = {}
    part, out = np.unique(label, return_inverse=True)[1], []

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(texts[i], size)
        return sets[i]

    for d in np.setdiff1d(near, [FAR]):
        for i in range(0, len(left), 64):
            p, q = np.nonzero(near[i : i + 64] == d)
            x, y = left[i + p], right[q]
            apart = part[x] != part[y]
            for a, b in zip(x[apart].tolist(), y[apart].tolist()):
                if part[a] != part[b] and similar(full(a), full(b), percent):
                    part[part == part[a]] = part[b]
                    out.append((int(cid[a]), int(cid[b])))
    return out


def _links(bodies: DataFrame, clusters: DataFrame, labels: DataFrame, size: int, percent: int, errors: int) -> DataFrame:
    """(u, v): confirmed links that connect all similar representatives of each cluster that labels do not connect.

    A cluster of more than TILE members is dealt by a hash in stripes, and every pair of
    stripes is a group of its own, so no task holds more than two stripes."""
    stripes = F.ceil(F.col("size") / TILE).cast("int")
    rows = bodies.join(clusters, "cid").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    rows = rows.withColumn("stripe", F.pmod(F.xxhash64("cid"), stripes).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), stripes - 1), lambda k: F.struct(F.least(k, "stripe").alias("a"), F.greatest(k, "stripe").alias("b")))
    names = ["cluster", "a", "b", "stripe", "cid", "label", "n_shingles", "sig", "text"]
    dealt = rows.select("*", F.explode(tile).alias("t")).select("*", "t.a", "t.b").select(*names)
    dealt = dealt.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "cid")

    def group(rows: list[tuple]) -> list[tuple[int, int]]:
        a, b = rows[0][1:3]
        stripe, cid, label, n = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5, 6))
        sigs = np.frombuffer(b"".join([r[7] for r in rows]), np.uint16).reshape(len(rows), -1)
        left = np.flatnonzero(stripe == a)
        return linked(cid, label, n, sigs, [r[8] for r in rows], left, left if a == b else np.flatnonzero(stripe == b), size, percent, errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple] = []
        for b in slices(batches):
            out = []
            for r in zip(*(column(b, c) for c in names)):
                if held and held[0][:3] != r[:3]:
                    out += group(held)
                    held = []
                held.append(r)
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])
        if held:
            out = group(held)
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, errors: int = ERRORS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links are 100 * intersection >= percent * union.

    errors: places of a chunk that may differ, 0 to WIDE - 1; more find pairs that fewer miss, with more keys."""
    if not 0 <= errors < WIDE:
        raise ValueError(f"errors must lie in 0..{WIDE - 1}")
    sigs = written(signatures(docs, size), "signatures")
    named = sigs.where("doc_id is not null")
    # A table of its own, so that the join's large classes can be split between tasks.
    classes = written(named.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "low"), "copies")
    members = written(named.join(classes, ["d1", "d2"], "left").select("d1", "d2", "doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("cid")), "classes")
    # A smallest id may stand for several sets, each with its signature and text.
    chosen = members.where("doc_id = cid and n_shingles > 0").select("doc_id", "cid", "d1", "d2").distinct()
    reps = written(sigs.join(chosen, ["doc_id", "d1", "d2"]).dropDuplicates(["cid", "d1", "d2"]).select("cid", "n_shingles", "sig", "text_hash"), "representatives")
    # An id with several sets ties their classes.
    several = members.groupBy("doc_id").agg(F.min("cid").alias("u"), F.max("cid").alias("high")).where("u <> high")
    ties = members.join(several, "doc_id").where("cid <> u").select("u", F.col("cid").alias("v")).distinct()
    live = written(_live(reps, errors), "live")
    bodies = written(_bodies(reps, live, docs), "bodies")
    links = written(_hub_links(live, bodies, size, percent).union(ties), "links")
    labels = components(links)
    # Every similar pair meets in a bucket; those of different labels in one that still holds two.
    now = live.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label"))
    mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    rest = written(now.join(mixed, "key").select("key", "cid"), "rest")
    if not rest.isEmpty():
        clusters = written(_clusters(rest), "clusters")
        more = written(_links(bodies, clusters, labels, size, percent, errors).union(links), "links")
        drop(labels)
        labels = components(more)
        drop(clusters)
        drop(more)
    for done in (rest, links, bodies, live, reps, classes):  # the labels are stored, only members and sigs are read on
        drop(done)
    grouped = members.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").select("doc_id", "n_shingles", F.coalesce("label", "cid").alias("component_id"))
    alone = sigs.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
