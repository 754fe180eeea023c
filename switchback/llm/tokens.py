"""Exact word-piece encoding with a bounded per-worker cache of words.

The tokenizer splits a text into pieces, none of which spans white space, and encodes
each piece on its own, so the ids of a text are the ids of its words in order.
Words recur, and a cache of them is several times faster than encoding whole texts. Texts with a character
outside a set for which normalisation is plain lower-casing go to the
tokenizer itself.
"""

from __future__ import annotations

import re
import struct

import numpy as np

CACHE_ENTRIES = 800_000
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
#: Byte-level vocabularies write printable Latin-1 bytes as themselves, and the others from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {byte: 0x100 + k for k, byte in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_UNSAFE = re.compile("[^\t\n\r\x20-\x7e¡-įı-ňŊ-ſ]")


class PieceEncoder:
    """``encode(texts)`` gives one uint32 array for each text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}

    def _learn(self, word: str) -> bytes:
        pieces = _PIECE.findall(word)
        if len(pieces) == 1:
            plain = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
            ids = struct.pack(f"<{len(found := self.model.tokenize(plain))}I", *[token.id for token in found])
        else:
            ids = b"".join([self.words.get(piece) or self._learn(piece) for piece in pieces])
        self.words[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [None if _UNSAFE.search(text) or "<|" in text else text.lower().split() for text in texts]
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        found = [words and list(map(self.words.get, words)) for words in split]
        short = [k for k, ids in enumerate(found) if ids and None in ids]
        for k in short:
            known = self.words.get
            found[k] = [known(word) or self._learn(word) for word in split[k]]
        return [
            np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4") if ids is None else np.frombuffer(b"".join(ids), "<u4")
            for text, ids in zip(texts, found, strict=True)
        ]
