"""Token ids of whole texts by a public tokenizer, through a bounded cache of white-space chunks.

The tokenizer's normaliser and pre-tokeniser never join anything over white space, so a text's ids are those of its
chunks in turn. Ordinary chunks are cut into words by the tokenizer's own pattern and each word goes through the
tokenizer once; any other chunk (controls, scripts beyond Latin, special tokens) goes through it whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Fixed: the word pattern of the tokenizer's file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same of lower-case ASCII without white space and controls, and what tells that a chunk is none such or may hold a special token.
ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
ODD_BYTES = re.compile(rb"[^\x21-\x7e]|<\|")
#: Bytes that are a word of their own after letters, at a chunk's end.
MARKS = frozenset(b".,;:!?)")


def blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """data in pieces of about size bytes, cut at white space."""
    at, space = 0, re.compile(rb"[\x20\x09-\x0D]")
    while len(data) - at > size:
        m = space.search(data, at + size)
        if not m:
            break
        yield data[at : m.end()]
        at = m.end()
    yield data[at:]


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible in Latin-1, else one from 256 on."""
    seen = {b: b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b}
    return seen | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in seen)}


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for all of a worker's tasks."""
    return ChunkTokenizer(path)


class Chunks(dict):
    """Ids of chunks; one that is not there is looked for, or made, where it is asked for."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self[chunk] = self.find(chunk)
        return ids


class ChunkTokenizer:
    """Encodes texts to arrays of ids through caches of chunks and words.

    The cache of chunks has two generations of about half of ``most`` entries: what is found in the elder one goes to
    the younger too; when that is full it becomes the elder one, so what a text needs often stays.
    """

    def __init__(self, path: str, most: int = 800_000, most_words: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.odd = Tokenizer.from_file(path), regex.compile(WORDS), re.compile(r"[\x00-\x20\x7f-\xa0ɐ-\U0010ffff]|<\|")
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.of_chunk, self.elder = Chunks(self._find), {}
        self.of_word: dict[bytes, bytes] = {}
        self.most, self.most_words, self.model, self.letters = most, most_words, self.tokenizer.model, byte_letters()

    def _word(self, word: bytes) -> bytes:
        visible = word.decode() if word.isascii() else word.decode("latin-1").translate(self.letters)
        ids = self.of_word[word] = array(self.kind.char, [t.id for t in self.model.tokenize(visible)]).tobytes()
        return ids

    def _find(self, chunk: bytes) -> bytes:
        return self.elder.get(chunk) or self._learn(chunk)

    def _learn(self, chunk: bytes) -> bytes:
        ids, word, low = self.of_word, self._word, chunk.lower()
        if low.isalpha():  # of letters a to z alone
            return ids.get(low) or word(low)
        if low[:-1].isalpha() and low[-1] in MARKS:
            w, mark = low[:-1], low[-1:]
            return (ids.get(w) or word(w)) + (ids.get(mark) or word(mark))
        if not ODD_BYTES.search(low):
            return b"".join([ids.get(w) or word(w) for w in ASCII_WORDS.findall(low)])
        text = chunk.decode()
        low = text.lower() if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text).lower()
        if text.isascii() or self.odd.search(low) or self.odd.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if low.isalpha():
            w = low.encode()
            return ids.get(w) or word(w)
        return b"".join([ids.get(w) or word(w) for w in map(str.encode, self.words.findall(low))])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; null is empty."""
        out = []
        for block in blocks((text or "").encode()):
            if len(self.of_chunk) > self.most // 2:
                self.of_chunk, self.elder = Chunks(self._find), self.of_chunk
            if len(self.of_word) > self.most_words:
                self.of_word.clear()
            out.append(b"".join(map(self.of_chunk.__getitem__, block.split())))
        return np.frombuffer(b"".join(out), self.kind)
