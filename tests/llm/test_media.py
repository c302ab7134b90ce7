import hashlib
import io
import zlib

import numpy as np
import pytest

from kindred.llm import media


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(1)
    return [rng.integers(0, 256, s, dtype=np.uint8) for s in ((1, 1), (5, 7), (16, 64), (33, 20), (6, 5, 3), (40, 31, 3))]


def test_lossless_round_trips(images):
    for a in images:
        for encode in (media.encode_netpbm, media.encode_bmp):
            assert (media.decode(encode(a)) == a).all()


def test_plain_and_bit_netpbm():
    assert media.decode(b"P2\n# c\n2 2\n255\n0 1\n2 255\n").tolist() == [[0, 1], [2, 255]]
    assert media.decode(b"P3 1 1 255\n9 8 7\n").tolist() == [[[9, 8, 7]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    # Samples that look like space or a comment start right after the header.
    a = np.frombuffer(b"  #\n", np.uint8).reshape(1, 4)
    assert (media.decode(media.encode_netpbm(a)) == a).all()
    assert media.decode(b"P5\n# a\n2 # b\n2\n#c\n255\n" + bytes([1, 2, 3, 4])).tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P2\n2 1\n255\n7 # seven\n8\n").tolist() == [[7, 8]]
    assert media.decode(b"P2 2 1 4 0 4 ").tolist() == [[0, 255]] and media.decode(b"P1 2 1\n10").tolist() == [[0, 255]]
    assert media.decode(b"P5\n2 1\n65535\n" + bytes([255, 255, 0, 0])).tolist() == [[255, 0]]
    for bad in (b"", b"GIF89a", b"P5\n2 2\n65535\n" + bytes(7), b"P2 1 1 255 300 ", b"P2 1 1 255 -1 ", b"P5 1 1 0 \0", b"P5 9 9", b"P5 1 1 3 \xff", b"P6x"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_the_mean_over_areas(images):
    for a in images:
        g = media.grey(a).astype(float)
        h, w = g.shape
        for th, tw in ((1, 1), (8, 9), (3, 2), (16, 16)):
            fine = np.kron(g, np.ones((th, tw)))  # every pixel th x tw times: cells are whole
            want = fine.reshape(th, h, tw, w).mean(axis=(1, 3))
            assert np.allclose(media.area_resize(g, th, tw), want)


def test_tiles_and_hashes(images):
    for a in images:
        t = media.tiles(a)
        assert len(t) == 4 and all(np.load(io.BytesIO(x)).shape[:2] == (8, 8) for x in t)
    ramp = np.tile(np.arange(64, dtype=np.uint8), (9, 1))
    assert media.difference_hash(ramp) == "f" * 16 and media.difference_hash(ramp[:, ::-1]) == "0" * 16


def test_features_of_texts(spark, edge_docs, clashing_docs, empty_docs):
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    for docs in (edge_docs, clashing_docs):
        out = media.media_features(media.text_media(docs), ["doc_id", "n_bytes"]).collect()
        assert len(out) == docs.count()
        for r in out:
            raw = texts[r.doc_id].encode()
            p = raw + bytes(-len(raw) % 64 if raw else 64)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
            assert r.media_bytes > r.payload_bytes and len(r.feature) == 16 and len(r.tiles) == 4
    assert media.media_features(media.text_media(empty_docs), ["doc_id"]).count() == 0


def broken_bmps():
    """A pixel beyond the palette, cut short, no width, and offsets beyond the file."""
    good = media.encode_bmp(np.full((2, 4), 200, np.uint8))
    small = good[:10] + (54 + 4 * 10).to_bytes(4, "little") + good[14:94] + good[-8:]  # ten colours
    return [small, good[:-3], good[:18] + bytes(4) + good[22:], good[:10] + b"\xff" * 4 + good[14:], good[:20], b"BM"]


def test_media_that_is_null_or_broken(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"nothing")), (3, bytearray(b"P5\n0 0\n255\n")), *((4 + k, bytearray(x)) for k, x in enumerate(broken_bmps()))], "id int, media binary")
    got = {r.id: r for r in media.media_features(rows, ["id"]).collect()}
    assert got[1].media_bytes is None and got[2].feature is None and got[2].media_bytes == 7 and got[3].feature is None
    assert all(got[k].feature is None and got[k].media_bytes is not None for k in got if k >= 4) and len(got) == 9
