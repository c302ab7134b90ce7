"""Whole texts to token ids with a public word-level BPE file, through caches of words.

White space only separates words for this tokenizer, so the ids of a text are the ids of its
white-space-separated chunks in turn. Each distinct chunk is encoded once per Python worker
by the tokenizers library; its ids are kept as bytes, and a text is a join of those.
"""

from __future__ import annotations

import re
from struct import pack

import numpy as np
import regex

# Characters for which NFC is the identity and lower-casing is one to one.
PLAIN = re.compile(r"[!-~¡-¬®-įĲ-ɏ]+")
# Fixed value: the pre-tokenizer's pattern, as the tokenizer file states it.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CHUNKS, PIECES = 400_000, 400_000  # entries kept per worker; beyond them words are encoded anew


def byte_letters() -> list[str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the rest follow from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Known(dict):
    """Chunks to their ids; what is new is asked of make()."""

    def __init__(self, make):
        super().__init__({"": b""})
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        v = self.make(chunk)
        if len(self) < CHUNKS:
            self[chunk] = v
        return v


class WordIds:
    """ids(text): little-endian unsigned 32-bit ids, as the library gives them by default without adding special tokens.

    A special token's content in a text is that token, so a chunk that holds one goes to the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.vocab_size = self.tok.get_vocab_size()
        self.letters = byte_letters()
        added = self.tok.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or " " in t.content for t in added):
            raise ValueError("added tokens must be found in chunks as they are")
        self.special = [t.content for t in added]
        if any(c.isalpha() or c[:-1].isalpha() for c in self.special):
            raise ValueError("words must not be added tokens")
        self.chunks = _Known(self._chunk)
        self.pieces: dict[str, bytes] = {}

    def _piece(self, p: str) -> bytes:
        v = self.pieces.get(p)
        if v is None:
            s = p if p.isascii() else "".join([self.letters[b] for b in p.encode()])
            ids = [t.id for t in self.model.tokenize(s)]
            v = pack(f"<{len(ids)}I", *ids)
            if len(self.pieces) < PIECES:
                self.pieces[p] = v
        return v

    def _chunk(self, c: str) -> bytes:
        # Most chunks are a word, perhaps with one sign behind: no pattern is needed for them.
        if c.isascii():
            if c.isalpha():
                return self._piece(c.lower())
            if c[-1] in ",.!?;:" and c[:-1].isalpha():
                return self._piece(c[:-1].lower()) + self._piece(c[-1])
        if PLAIN.fullmatch(c) and not any([s in c for s in self.special]):
            return b"".join([self._piece(p) for p in SPLIT.findall(c.lower())])
        return np.array(self.tok.encode(c, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.chunks.__getitem__, (text or "").replace("\n", " ").split(" ")))


def word_ids(path: str) -> WordIds:
    from .common import MODEL, per_worker

    return per_worker(MODEL, path, lambda: WordIds(path))
