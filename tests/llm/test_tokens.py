import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from kindred.llm import packing, rans
from kindred.llm.common import new_path
from kindred.llm.pieces import Agenda, encode_pieces, piece_digests
from kindred.llm.token_files import read_token_files, write_token_files
from kindred.llm.words import WordIds

BPE, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
ODD = ["a  b", " a", "", " ", "\n", "a\n\nb ", "İstanbul ΑΣ. I'll don't x\x1cy", "１２ ǅ ŉ ẞ 日本語 한국어 ́x K ½ ²3", "ﬁ ①　x\xa0y\r​z é", "<s></s> <unk>", "▁▁a▁b", "aaaa" * 200, "🎉" * 5, "tail   ", "word%%% and,!! x's 'S"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_ids_equal_the_library(library):
    w = WordIds(BPE)
    for t in ODD * 2:
        assert np.frombuffer(w.ids(t), "<u4").tolist() == library(t)


def test_special_tokens_in_texts_are_encoded_by_default(spark):
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(BPE), WordIds(BPE)
    texts = ["one <|endoftext|> two", "<|startoftext|>", "a<|endoftext|>b's <|ENDOFTEXT|>", "é<|endoftext|><|startoftext|>́x \n <|endoftext|", "<|endoftext|>\x1c<|endoftext|>. <|end oftext|>"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [637, 49407, 1237]
    assert [np.frombuffer(w.ids(x), "<u4").tolist() for x in texts * 2] == want * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = read_token_files(spark, write_token_files(docs, new_path(spark, "t"), BPE)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in out} == {i: [*x, 1] for i, x in enumerate(want)}
    assert sum(r.length for r in packing.pack_documents(docs, BPE, capacity=512).collect()) == sum(len(x) + 1 for x in want)


def test_rans_round_trip_parts_and_damage():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.4, 200_000) % 3000).astype(np.uint32)
    t = rans.Table(np.bincount(ids))
    for n in (0, 1, 1023, 1024, 1025, 65536, 65537, len(ids)):
        block = rans.encode(ids[:n], t)
        assert (rans.decode(block, t) == ids[:n]).all()
    step = rans.STEPS * rans.LANES
    assert (rans.decode_part(block, t, 1) == ids[step : 2 * step]).all()
    entropy = -sum(c / len(ids) * np.log2(c / len(ids)) for c in np.bincount(ids) if c)
    assert len(block) * 8 < len(ids) * entropy * 1.25
    bad = bytearray(block)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(bad), t)
    with pytest.raises(ValueError):
        rans.encode(np.array([1], np.uint32), rans.Table(np.array([1, 0, 1])))


@pytest.mark.parametrize("extra", [False, True])
def test_token_files(spark, edge_docs, clashing_docs, library, extra):
    docs = clashing_docs if extra else edge_docs
    out = read_token_files(spark, write_token_files(docs, new_path(spark, "t"), BPE, partitions=3)).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.select("doc_id", "text").collect()))
    got = sorted(out, key=lambda r: r.start)
    at = 0
    for (some, i, text), r in zip(rows, got, strict=True):
        ids = [*library(text), 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i if some else None, at, len(ids), crc(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)


def test_token_files_of_an_empty_table(spark, empty_docs):
    assert read_token_files(spark, write_token_files(empty_docs, new_path(spark, "t"), BPE)).count() == 0


def exact_bins(items, capacity):
    """Least number of bins by exhaustive search."""
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                bins[i] += items[k]
                go(k + 1, bins)
                bins[i] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum_and_plans_hold_all():
    r = random.Random(4)
    for _ in range(120):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        counts = {n: items.count(n) for n in items}
        fixed, rest = packing.reduce_instance(counts, 20)
        left = [n for n, c in rest.items() for _ in range(c)]
        assert sum(m for m, _ in fixed) + exact_bins(sorted(left, reverse=True), 20) == exact_bins(items, 20)
        total: dict[int, int] = {}
        for m, lengths in packing.plan(counts, 20):
            assert m > 0 and sum(lengths) <= 20
            for n in lengths:
                total[n] = total.get(n, 0) + m
        assert total == counts


def test_packing(spark, edge_docs, clashing_docs, empty_docs, library):
    for docs in (edge_docs, clashing_docs):
        out = packing.pack_documents(docs, BPE, capacity=512).collect()
        texts = docs.select("doc_id", "text").collect()
        assert sum(r.length for r in out) == sum(len(library(t.text)) + 1 for t in texts)
        seqs = {}
        for r in out:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s in seqs.values():
            at = 0
            for off, n in sorted(s):
                assert off == at
                at += n
            assert at <= 512
        long = [*library(next(t.text for t in texts if t.doc_id == 9)), 1]
        for r in (r for r in out if r.doc_id == 9):
            assert r.start == 512 * r.piece and r.ids_crc32 == crc(long[r.start : r.start + r.length])
    assert packing.pack_documents(empty_docs, BPE).count() == 0


def test_agenda_equals_the_library(spark, edge_docs, empty_docs):
    a = Agenda(PIECES)
    assert a.batch(ODD) == [a.sp.encode(t) for t in ODD]
    assert [a.merge(c) for c in ("▁abcabcabc" * 5, "▁th")] == [a.sp.encode(c[1:], out_type=str) for c in ("▁abcabcabc" * 5, "▁th")]
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    for r in encode_pieces(edge_docs, PIECES).collect():
        ids = [*a.sp.encode(texts[r.doc_id]), a.sp.eos_id()]
        assert (r.ids, r.decoded) == (ids, a.sp.decode(ids))
    for r in piece_digests(edge_docs, PIECES).collect():
        ids = [*a.sp.encode(texts[r.doc_id]), a.sp.eos_id()]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(a.sp.decode(ids).encode()).hexdigest()
    assert piece_digests(empty_docs, PIECES).count() == 0


def test_lower_bound_of_bins():
    r = random.Random(12)
    for _ in range(300):
        capacity = r.choice([7, 10, 31, 64])
        counts = {}
        for _ in range(r.randint(0, 12)):
            counts[r.randint(1, capacity)] = r.randint(1, 9)
        used = sum(bins for bins, _ in packing.plan(counts, capacity))
        low = packing.lower_bound(counts, capacity)
        assert -(-sum(n * c for n, c in counts.items()) // capacity) <= low <= used
    assert packing.lower_bound({6: 3, 4: 2}, 10) == 3 and packing.lower_bound({6: 4}, 10) == 4
