"""Words of whole Arrow text columns as numpy arrays.

A column is handled as one byte buffer: a 256-entry table maps every byte of
UTF-8 to itself, to its lower case or to a blank, so words of all texts are
found by comparing neighbouring bytes.  No text is cut; memory is a small
multiple of the bytes of a chunk, and a chunk is a run of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = 0x20
CHUNK_BYTES = 1 << 21
_PIECE = 1 << 19


def _lower(table: np.ndarray) -> np.ndarray:
    table[0x41:0x5B] += 0x20
    return table


def blank_separated() -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    table = _lower(np.arange(256, dtype=np.uint8))
    table[0x09:0x0E] = BLANK
    return table


def letters_and_digits() -> np.ndarray:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z went to lower case."""
    table = np.full(256, BLANK, dtype=np.uint8)
    for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        table[low:high] = np.arange(low, high)
    return _lower(table)


def letters() -> np.ndarray:
    """Words of ASCII letters and all characters above ASCII, A-Z in lower case."""
    table = letters_and_digits()
    table[0x30:0x3A] = BLANK
    return table


class Words:
    """Words of a run of texts: word ``i`` is ``data[start[i]:end[i]]``, the words
    of text ``r`` are ``ptr[r]`` to ``ptr[r + 1]``; a null text has none."""

    def __init__(self, texts: pa.Array, table: np.ndarray):
        texts = texts.cast(pa.large_string())
        n = len(texts)
        raw = texts.buffers()
        off = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        low, high = int(off[0]), int(off[-1])
        data = np.frombuffer(raw[2], np.uint8)[low:high] if high > low else np.empty(0, np.uint8)
        off = off - low
        self.data = table[data]
        word = self.data != BLANK
        begin, last = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edges = off[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begin[edges] = word[edges]
        last[edges - 1] = word[edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def rows(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hash_slices(self.data, self.start, self.end)

    def packed(self) -> pa.LargeBinaryArray:
        """The words as one binary array."""
        size = np.concatenate([[0], np.cumsum(self.end - self.start)])
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.start), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(self.data[self.data != BLANK])]
        )

    def codes(self) -> tuple[np.ndarray, list[bytes]]:
        """Each word's number in the list of distinct words, and that list."""
        found = self.packed().dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole texts of about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


# -- hashing ---------------------------------------------------------------

_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers over all positions."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def hash_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash ``data[start:end]`` for ascending slices: polynomial sums of random
    byte values, read off prefix sums and shifted back to position 0."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _PIECE, "right")))
        low, high = int(start[i]), int(end[j - 1])
        up, back = _tables(max(high - low, _PIECE))
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=total[1:])
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = (total[b] - total[a]) * back[a]
        i = j
    return mix(out)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words of one text; of fewer words, the whole
    sequence as one; of none, nothing."""
    n = len(words)
    if n == 0:
        return words
    k_own = min(k, n)
    total = words[: n - k_own + 1].copy()
    for j in range(1, k_own):
        total = mix(total * _BASE + words[j : n - k_own + 1 + j])
    return total if k_own == k else mix(total + np.uint64(k_own))
