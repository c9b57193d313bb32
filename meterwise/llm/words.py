"""Words of whole texts, in Arrow batches: a batch's words as codes into the batch's own dictionary.

Per-word Python work then happens once per distinct word of a batch; positions are numpy arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = bytes([0x20, *range(0x09, 0x0E)])  # the blanks of the contracts: space and U+0009 to U+000D
BATCH_BYTES = 4 << 20  # text bytes handled at once; one longer text is one batch


def give_back() -> None:
    """Returns freed memory to the system.  Python workers live on from stage to stage, and what an earlier stage's batches
    took would else stay with them beside the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in runs of about ``limit`` bytes; null texts become empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, texts.slice(a, b - a)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: (offsets of n + 1 texts, codes of all words, distinct words)."""
    parts = pc.ascii_split_whitespace(texts)
    flat = pc.list_flatten(parts).cast(pa.large_binary()).dictionary_encode()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if b"" in words:  # texts that begin or end with blanks, and empty ones
        real = codes != words.index(b"")
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return offsets, codes, words


def ragged(offsets: np.ndarray, codes: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each code replaced by its piece, a run of little-endian unsigned 32-bit values: (offsets, all values)."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) >> 2
    values = np.frombuffer(b"".join(pieces), "<u4")
    first = np.cumsum(size) - size
    n = size[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    flat = values[np.repeat(first[codes] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.uint32)
    return np.concatenate([[0], ends])[offsets], flat
