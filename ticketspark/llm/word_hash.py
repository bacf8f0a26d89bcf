"""Words and rolling hashes of whole columns of texts in numpy, without a Python object per word.

All arithmetic is modulo 2**64. A word's hash is a polynomial over random numbers for its bytes, mixed;
the hash of consecutive words is a polynomial over the hashes of the words, mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 20


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


BYTE = mix(np.arange(256, dtype=np.uint64), 17)
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20  # A-Z only


def buffer_of(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts in them); nulls are empty."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


class Words:
    """Places, hashes and documents of all words of a column of texts."""

    def __init__(self, column: pa.StringArray, lower: bool = False):
        self.raw, offsets = buffer_of(column)
        if lower:
            self.raw = LOWER[self.raw]
        self.n_docs = len(column)
        edge = np.zeros(len(self.raw) + 1, bool)
        edge[offsets] = True
        starts, ends, hashes = [], [], []
        lo = 0
        forward, backward = powers(BASE, 0), powers(INVERSE, 0)
        while lo < len(self.raw):
            hi = min(lo + CHUNK, len(self.raw))
            while hi < len(self.raw) and not (BLANK[self.raw[hi]] or edge[hi]):
                hi += 1
            part = self.raw[lo:hi]
            if len(part) > len(forward):
                forward, backward = powers(BASE, len(part)), powers(INVERSE, len(part))
            full = ~BLANK[part]
            first = full.copy()
            first[1:] &= ~full[:-1] | edge[lo + 1:hi]
            last = full.copy()
            last[:-1] &= ~full[1:] | edge[lo + 1:hi]
            a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE[part] * forward[:len(part)], out=total[1:])
            hashes.append(mix((total[b] - total[a]) * backward[a]))
            starts.append(a + lo)
            ends.append(b + lo)
            lo = hi
        none = np.empty(0, np.int64)
        self.starts, self.ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.hashes = np.concatenate([np.empty(0, np.uint64), *hashes])
        #: Number of the first word of each document, and one more for the end.
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def room(self) -> np.ndarray:
        """For each word, the words from it to the end of its document."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))

    def places(self) -> np.ndarray:
        """For each word, its number in its document."""
        return np.arange(len(self)) - np.repeat(self.first[:-1], self.counts)

    def runs(self, starts: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each start; the starts must have that much room."""
        values = mix(self.hashes, salt) if salt else self.hashes
        total = np.zeros(len(self) + 1, np.uint64)
        np.cumsum(values * powers(BASE, len(self)), out=total[1:])
        return mix((total[starts + length] - total[starts]) * powers(INVERSE, len(self) + 1)[starts], salt)

    def joined(self, keep: np.ndarray) -> pa.StringArray:
        """Per document the kept words, joined by one blank."""
        sizes = np.where(keep, self.ends - self.starts + 1, 0)
        ends = np.cumsum(sizes)
        out = np.full(int(sizes.sum()), 0x20, np.uint8)
        chosen = np.flatnonzero(keep)
        length = (self.ends - self.starts)[chosen]
        shift = np.repeat(self.starts[chosen] - (ends - sizes)[chosen], length)
        at = np.repeat((ends - sizes)[chosen] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        out[at] = self.raw[at + shift]
        # Every word is followed by a blank; the last one of a document is cut off.
        per_doc = np.concatenate([[0], ends])[self.first]
        size = np.diff(per_doc)
        trimmed = np.delete(out, (per_doc[1:] - 1)[size > 0])
        offsets = np.concatenate([[0], np.cumsum(size - (size > 0))])
        return pa.LargeStringArray.from_buffers(self.n_docs, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(trimmed)).cast(pa.string())
