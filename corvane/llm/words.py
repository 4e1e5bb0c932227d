"""Token ids of ``word_bpe_49k.json`` at word speed, equal to the tokenizers library's on every text.

The vocabulary's own pipeline (NFC, white space, lower case, split, BPE) treats each white-space-delimited word alone.
Texts whose characters lie below U+0250 and hold no control or special-token strings are therefore cut at white space
and each distinct word is encoded once by the library's BPE model; all other texts go through the library as a whole.
"""

from __future__ import annotations

import functools
import os
import re

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ]|<\\|")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CACHE_WORDS = 300_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """word -> its ids as little-endian 32-bit bytes; unknown words are encoded on first sight."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = bytearray()
        for piece in PIECES.findall(word):
            text = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            for token in self.model.tokenize(text):
                ids += token.id.to_bytes(4, "little")
        self[word] = out = bytes(ids)
        return out

    def ids(self, text: str) -> bytes:
        if PLAIN.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        return b"".join(map(self.__getitem__, text.lower().split()))


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker."""
    return WordEncoder(path)
