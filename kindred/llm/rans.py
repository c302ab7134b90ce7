"""Static range asymmetric numeral system over token ids.

Integers from a shared frequency table (counts scaled to a total of 2**SCALE) code blocks that
are independent of each other. In a block, symbol i belongs to lane i mod LANES; the lanes'
states advance together, and their 32-bit words interleave in one stream. Every STEPS symbols
of a lane a checkpoint keeps the lanes' states and the place in the stream, so that the parts
of a block can be decoded in parallel too. CRC-32 guards the stream and the decoded ids.

Block format (little-endian): magic "KRA1", u32 crc of all that follows, u32 crc of the ids as
u32, u64 symbols, u32 lanes, u32 steps per checkpoint, u32 checkpoints, u64 words; then for
each checkpoint u64 word place and lanes x u64 states; then the words as u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE, LANES, STEPS = 20, 1024, 64
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIIQIIIQ")


class Table:
    """Frequencies of symbols, scaled so that each that occurs has at least 1 of 2**SCALE."""

    def __init__(self, counts: np.ndarray, scale: int = SCALE):
        counts = np.asarray(counts, np.int64)
        used = np.flatnonzero(counts)
        if len(used) > 1 << scale:
            raise ValueError("more symbols than the table's total")
        f = np.zeros(len(counts), np.int64)
        if len(used):
            share = counts[used] * ((1 << scale) - len(used)) / counts[used].sum()
            f[used] = 1 + np.floor(share).astype(np.int64)
            f[used[np.argmax(f[used])]] += (1 << scale) - f.sum()
        self.scale, self.freq = scale, f.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64) if len(f) else np.zeros(0, np.uint64)
        self.symbol = np.repeat(np.arange(len(f), dtype=np.uint32), f)


def encode(ids: np.ndarray, t: Table, lanes: int = LANES, steps: int = STEPS) -> bytes:
    """The block of these ids; an empty block is valid."""
    n, bits, mask32 = len(ids), np.uint64(t.scale), np.uint64(0xFFFFFFFF)
    f, c = t.freq[ids], t.start[ids]
    if n and not f.all():
        raise ValueError("an id outside the frequency table")
    x = np.full(lanes, LOW, np.uint64)
    words, places, marks, total = [], [], [], 0
    top = np.uint64((1 << 63) >> t.scale)
    for s in range((n + lanes - 1) // lanes - 1, -1, -1):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        fs, y = f[a:b], x[: b - a]
        full = y >= fs * top
        if full.any():
            w = y[full]
            words.append((w & mask32).astype(np.uint32)[::-1])
            total += len(w)
            y = y.copy()
            y[full] = w >> np.uint64(32)
        q, r = np.divmod(y, fs)
        x[: b - a] = (q << bits) + r + c[a:b]
        if s % steps == 0:
            places.append(total)
            marks.append(x.copy())
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    body = b"".join(struct.pack("<Q", total - p) + m.astype("<u8").tobytes() for p, m in zip(reversed(places), reversed(marks))) + stream.astype("<u4").tobytes()
    rest = HEAD.pack(b"KRA1", 0, zlib.crc32(np.asarray(ids, "<u4").tobytes()), n, lanes, steps, len(marks), total)[8:] + body
    return b"KRA1" + struct.pack("<I", zlib.crc32(rest)) + rest


def decode_part(block: bytes, t: Table, k: int) -> np.ndarray:
    """The ids from checkpoint k to the next one, from its states alone."""
    _, _, _, n, lanes, steps, marks, total = HEAD.unpack_from(block)
    at = HEAD.size + k * 8 * (lanes + 1)
    place = struct.unpack_from("<Q", block, at)[0]
    x = np.frombuffer(block, "<u8", lanes, at + 8).astype(np.uint64)
    words = np.frombuffer(block, "<u4", total, HEAD.size + marks * 8 * (lanes + 1))
    first, last = k * steps * lanes, min(n, (k + 1) * steps * lanes)
    out, bits, low = np.empty(last - first, np.uint32), np.uint64(t.scale), np.uint64((1 << t.scale) - 1)
    for a in range(first, last, lanes):
        b = min(last, a + lanes)
        y = x[: b - a]
        slot = y & low
        s = t.symbol[slot]
        y = t.freq[s] * (y >> bits) + slot - t.start[s]
        need = np.flatnonzero(y < LOW)
        if len(need):
            y[need] = (y[need] << np.uint64(32)) | words[place : place + len(need)]
            place += len(need)
        x[: b - a] = y
        out[a - first : b - first] = s
    return out


def decode(block: bytes, t: Table) -> np.ndarray:
    """All ids of a block; damage raises ValueError."""
    if len(block) < HEAD.size or block[:4] != b"KRA1":
        raise ValueError("not a block")
    _, crc, ids_crc, _, _, _, marks, _ = HEAD.unpack_from(block)
    if zlib.crc32(block[8:]) != crc:
        raise ValueError("damaged block")
    parts = [decode_part(block, t, k) for k in range(marks)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids differ from their checksum")
    return ids
