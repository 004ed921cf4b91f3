"""Vectorised word handling for Arrow batches of texts: no loop over rows or words.

The texts of a batch are one UTF-8 buffer with offsets. Word starts and ends are found on the whole buffer and words are
hashed by a rolling polynomial over it. Work and memory are linear in the bytes of a chunk; a chunk is at most ``CHUNK``
bytes or a single longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _blank_table(drop_punctuation: bool) -> np.ndarray:
    """Byte to byte: 0 for blanks, A-Z lower-cased; 1 marks punctuation to be dropped."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if drop_punctuation:
        for c in range(33, 128):
            if not chr(c).isalnum():
                t[c] = 1
        t[:32] = 1
        t[127] = 1
    else:
        t[0] = 2
    t[[9, 10, 11, 12, 13, 32]] = 0
    return t


RAW, PLAIN = _blank_table(False), _blank_table(True)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    h = np.atleast_1d(h)
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * CHUNK:
            _powers[int(base)] = have
    return have


def chunks(texts: pa.Array, limit: int = CHUNK, rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the texts' offsets among them."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]


class Words:
    """Words of one chunk: ``start`` and ``end`` into ``data`` (as mapped by the table), ``doc`` and ``hash``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray = RAW):
        mapped = table[data]
        self.source = None
        if table is PLAIN:
            keep = mapped != 1
            self.source = np.flatnonzero(keep)
            off = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[off]
            mapped = mapped[keep]
        n = len(mapped)
        inside = mapped != 0
        first = np.zeros(n + 1, bool)
        first[off] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        self.data, self.off = mapped, off
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[mapped] * _power(_P, n)[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _power(_P_INV, n + 1)[self.start])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``size`` words within one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.hash[:n].copy()
        for k in range(1, size):
            h *= _P
            h += self.hash[k : n + k]
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, mix(h[at])
