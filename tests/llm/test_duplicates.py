import random
import tracemalloc
import weakref

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kindred.llm import neardup, repeats
from kindred.llm.components import components
from kindred.llm.suffixes import suffix_array

from .conftest import SCHEMA, prose


def sets(text, size=5):
    w = (text or "").encode().lower().split()
    return set(zip(*[w[k:] for k in range(size)])) if len(w) >= size else {tuple(w)} if w else set()


def groups(rows, percent):
    """Smallest reachable id by comparing all pairs."""
    ids = sorted({i for i, _ in rows if i is not None})
    s = {i: [sets(t) for j, t in rows if j == i] for i in ids}
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and any(100 * len(a & b) >= percent * len(a | b) and a and b for a in s[i] for b in s[j]):
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def family(seed, n, edits):
    """Texts each a few words away from the one before: chains whose ends are not linked."""
    r, out = random.Random(seed), [prose(seed, 120).split()]
    for _ in range(n - 1):
        t = [*out[-1]]
        for _ in range(edits):
            t[r.randrange(len(t))] = f"new{r.randrange(10**6)}"
        out.append(t)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_brute_force(spark, percent):
    texts = [t for k in range(12) for t in family(100 + k, 6, 1 + k % 4)] + [prose(1, 40)] * 30 + [prose(900 + k, 50) for k in range(20)] + ["a b", "A  B", "a b c", None, "", " "]
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, percent=percent).collect()}
    want = groups(rows, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    for i, t in rows:
        assert got[i].n_shingles == len(sets(t)) and got[i].kept == (want[i] == i)


def test_near_duplicates_of_odd_rows(spark, edge_docs, clashing_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    want = groups(rows, 85)
    for docs in (edge_docs, clashing_docs):
        got = neardup.near_duplicates(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id or r.doc_id is None)
    assert neardup.near_duplicates(empty_docs).count() == 0


def test_near_duplicates_of_ids_with_different_texts(spark):
    """Every text under a repeated id links, and ties what the id's other texts are linked to."""
    f = [family(300 + k, 4, 3) for k in range(12)]
    rows = []
    for k in range(0, 12, 2):
        rows += [(10 * k, f[k][0]), (10 * k, f[k + 1][0]), (10 * k + 1, f[k][1]), (10 * k + 2, f[k + 1][1]), (10 * k + 3, f[k + 1][2])]
    rows += [(500, f[0][2]), (500, f[2][2]), (501, f[0][1]), (502, None), (502, f[4][2]), (10, f[6][0]), (503, None), (503, "")]
    random.Random(4).shuffle(rows)
    want = groups(rows, 85)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(sets(t)), want[i], want[i] == i) for i, t in rows)


def test_tiles_of_large_clusters_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 7)
    monkeypatch.setattr(neardup, "SPREAD", 5)
    texts = family(55, 40, 3) + family(56, 25, 4)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows, 85)


@pytest.mark.parametrize("errors", [0, 1, 2, 3])
def test_signatures_within_the_distance_share_a_bucket(errors):
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = rng.integers(0, 1 << 16, 60).astype(np.uint16)
        b = a.copy()
        b[rng.choice(60, 12 * (errors + 1) - 1, replace=False)] += 1
        ka, kb = neardup.bucket_keys(np.stack([a, b]), errors)
        assert set(ka.tolist()) & set(kb.tolist())


def test_more_errors_find_pairs_that_fewer_miss(spark, monkeypatch):
    """Equal sets but for the signature, which is made to differ in a given number of places."""
    r, texts = random.Random(8), []
    for differ in (5, 11, 12, 23, 24, 35, 36):
        words = prose(100 + differ, 200).split()
        texts += [(differ, " ".join(words)), (differ, " ".join([*words, f"w{differ}"]))]
    marks = {text: (k, differ) for k, (differ, text) in enumerate(texts)}
    assert len(marks) == len(texts)
    base = [np.array([r.randrange(1 << 16) for _ in range(60)], np.uint16) for _ in texts[::2]]
    places = [r.sample(range(60), 60) for _ in base]

    def made(docs, size):
        rows = []
        for x in docs.collect():
            k, differ = marks[x.text]
            sig = base[k // 2].copy()
            if k % 2:
                sig[places[k // 2][:differ]] += 1
            rows.append((x.doc_id, len(sets(x.text)), k, k, bytearray(sig.tobytes())))
        out = spark.createDataFrame(rows, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")
        return out.join(docs.select("doc_id", F.xxhash64("text").alias("text_hash")), "doc_id")

    monkeypatch.setattr(neardup, "signatures", made)
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    for errors in (1, 2):
        linked = {x.doc_id // 2 for x in neardup.near_duplicates(df, errors=errors).collect() if not x.kept}
        surely = {k // 2 for k, (differ, _) in enumerate(texts) if differ < 12 * (errors + 1)}
        assert linked >= surely
    with pytest.raises(ValueError):
        neardup.near_duplicates(df, errors=5)


def test_memory_of_a_tile_of_near_copies_is_a_byte_a_pair():
    """Two million near pairs of different labels were held with their rows' numbers, and as lists."""
    rng = np.random.default_rng(5)
    texts = [f"one {i} " + " ".join(map(str, range(40))) for i in range(2000)]
    sigs = np.tile(rng.integers(0, 1 << 16, neardup.CHUNKS * neardup.WIDE, np.uint16), (2000, 1))
    sigs[np.arange(2000), rng.integers(0, 60, 2000)] += rng.integers(0, 3, 2000, np.uint16)
    label, n, every = np.arange(2000) * 7 + 5, np.full(2000, 38), np.arange(2000)
    tracemalloc.start()
    found = neardup.linked(label, label, n, sigs, texts, every, every, 5, 80)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(found) == 1999 and len({v for _, v in found} | {u for u, _ in found}) == 2000
    assert peak < 40, f"{peak:.0f} MB"


def test_words_of_one_operator_do_not_stay_for_the_next():
    """Word caches of the classifier and of the tokenizer lay side by side in a worker, and beside the tiles."""
    from kindred.llm import common, quality, words

    first = words.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    assert words.word_ids(public_tokenizers.path("word_bpe_49k.json")) is first
    kept = weakref.ref(first)
    del first
    quality.grams("some words")
    assert kept() is None
    kept = weakref.ref(common.MODEL["hashes"])
    common.release()
    assert kept() is None


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 150)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100 and got[200] == 150


def test_suffix_arrays():
    r = random.Random(5)
    for _ in range(1500):
        s = bytes(r.randrange(r.choice([1, 2, 3, 26])) for _ in range(r.randint(0, 40))) * r.choice([1, 1, 1, 3])
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def covered(rows):
    """Bytes of each row that a 50-byte string of a smaller id's document covers."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        c = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                c[p : p + 50] = True
        out.append(c)
    return out


def check_repeats(docs, rows, home_bytes):
    got = repeats.remove_repeats(docs, home_bytes=home_bytes).select("doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_text").collect()
    want = sorted(((-1 if i is None else i, len((t or "").encode()), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), np.frombuffer((t or "").encode(), np.uint8)[~c].tobytes()) for (i, t), c in zip(rows, covered(rows))))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_repeats_equal_brute_force(spark):
    r = random.Random(8)
    base = ["".join(r.choices("abcdefgh é", k=r.randint(40, 500))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 3)):
            b = r.choice(base)
            s = r.randrange(len(b))
            y = list(b[s : s + r.randint(0, 300)])
            for _ in range(r.randint(0, 2)):
                if y:
                    y[r.randrange(len(y))] = r.choice("xyzé")
            parts += ["".join(y), r.choice(["", "z" * r.randint(0, 130), "".join(r.choices("ijklmn", k=25))])]
        rows.append((i, "".join(parts)))
    r.shuffle(rows)
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rows, 1500)


def test_copies_whose_anchor_another_document_holds(spark):
    """Exact copies in two homes, and a third document that holds only a phrase of theirs, shorter than a window."""
    r = random.Random(21)
    text = lambda n, letters: "".join(r.choices(letters, k=n))
    copies = [text(r.randint(50, 90), "abcdefgh") for _ in range(24)]
    phrases = [text(40, "ijklmn") + c[s : s + r.randint(30, 45)] + text(40, "ijklmn") for c in copies for s in [r.randint(0, 20)]]
    rows = list(enumerate([*copies, *copies, *phrases]))
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(6, "doc_id"), rows, 1)
    x, y = np.frombuffer(copies[0].encode()[:50].ljust(76, b"\xff"), np.uint8), np.full(76, 255, np.uint8)
    y[20:76] = np.frombuffer(phrases[0].encode()[:56], np.uint8)
    full = repeats.window_bits(np.array([0]), np.array([50]))[0]
    got = repeats.settle(np.zeros(3, np.uint64), np.array([3, 7, 9]), np.array([0, 0, 20]), np.array([50, 50, 76]), np.stack([x, x, y]))
    assert got.tolist() == [0, full, 0]


def test_equal_hashes_of_different_contexts_change_nothing(monkeypatch):
    """Bytes decide what is equal: with one hash for everything the windows found are the same."""
    r = random.Random(31)
    gram = "".join(r.choices("klmno", k=24))
    sides = ["".join(r.choices("abcd", k=26)) for _ in range(3)]
    texts = [a[: r.randint(13, 26)][::-1].rjust(26, "#")[::-1] + gram + b for a in sides for b in sides for _ in range(3)]
    ctx = np.stack([np.frombuffer(t.encode(), np.uint8) for t in texts])
    n = len(ctx)
    args = np.full(n, 5, np.uint64), np.array(r.sample(range(100), n)), np.zeros(n, np.uint8), np.full(n, 76, np.uint8), ctx
    want = repeats.settle(*args)
    firsts = [sum(1 << t for t in range(27) if any(args[1][j] < args[1][i] and (ctx[j][t : t + 50] == ctx[i][t : t + 50]).all() for j in range(n))) for i in range(n)]
    assert want.tolist() == firsts and any(firsts)
    monkeypatch.setattr(repeats, "_hash", lambda m, *more: np.zeros(len(m), np.uint64))
    assert repeats.settle(*args).tolist() == firsts


def test_repeats_of_odd_rows(spark, edge_docs, clashing_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    check_repeats(edge_docs, rows, 4000)
    check_repeats(clashing_docs, rows, 1 << 20)
    assert repeats.remove_repeats(empty_docs).count() == 0
    kept = repeats.remove_repeats(clashing_docs)
    assert set(clashing_docs.columns) - {"text", "kept"} <= set(kept.columns)
    assert SCHEMA and F


UNLIKE = [prose(41, 40), prose(42, 60)]


@pytest.mark.parametrize("texts", [UNLIKE[:1], [None], [""], UNLIKE, ["too short", "also", None, ""]], ids=["one", "null", "empty", "unlike", "short"])
def test_repeats_where_nothing_is_shared(spark, texts):
    rows = list(enumerate(texts))
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rows, 1 << 20)


def test_repeats_of_a_home_without_shared_anchors(spark):
    """The last home of a partition shares nothing, others do."""
    shared = prose(43, 50)
    rows = list(enumerate([f"{UNLIKE[0]} {shared}"] * 17 + [prose(44 + k, 40) for k in range(31)]))
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rows, 1)
