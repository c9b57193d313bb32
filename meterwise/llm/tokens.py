"""Token ids of whole texts by a public tokenizer that splits at white space first.

Such a tokenizer gives a text's ids as those of its blank-separated chunks, one after the other; a chunk's ids are
looked up, and only a worker's new chunks are encoded.
"""

from __future__ import annotations

import string
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import ragged

KNOWN = 600_000  # chunks a worker remembers; beyond it, it starts anew


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write byte b as a visible letter: itself if printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _ends_a_word(stem: str) -> bool:
    """Whether marks after ``stem`` start a piece of their own: its last character, composed and lower-cased as the
    tokenizer sees it, is a letter or digit.  (U+0130 is a letter whose lower case ends in a combining mark.)"""
    return unicodedata.category(unicodedata.normalize("NFC", stem).lower()[-1])[0] in "LN"


class ChunkIds(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.letters = _byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and "Σ" not in chunk and unicodedata.is_normalized("NFC", chunk):
            low = chunk.lower()
            out = self[low] if low != chunk else self._word(chunk)
        else:
            stem = chunk.rstrip(string.punctuation)  # the marks after a word are a piece of their own
            if stem and stem != chunk and _ends_a_word(stem):
                out = self[stem] + self[chunk[len(stem):]]
            else:
                out = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= 40:
            if len(self) >= KNOWN:
                self.clear()
            self[chunk] = out
        return out

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(word)], "<u4").tobytes()


_OPEN: dict[str, ChunkIds] = {}  # by path, for as long as a worker lives


def chunk_ids(path: str) -> ChunkIds:
    if path not in _OPEN:
        _OPEN[path] = ChunkIds(path)
    return _OPEN[path]


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n + 1 texts, all their ids as uint32)."""
    known = chunk_ids(path)
    low = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
    parts = pc.split_pattern(low, " ")
    flat = pc.list_flatten(parts).dictionary_encode()
    pieces = [known[c] if c else b"" for c in flat.dictionary.to_pylist()]
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    return ragged(np.concatenate([[0], np.cumsum(counts)]), flat.indices.to_numpy(zero_copy_only=False), pieces)
