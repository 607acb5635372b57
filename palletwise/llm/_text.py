"""Words of whole texts as numpy arrays (shared by the Arrow operators).

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; ``bytes.split()``
uses exactly that set, so the list of words and the arrays below line up.
Texts are handled in slices of an Arrow batch bounded by bytes, which bounds
the memory of a task whatever the text lengths add up to.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
CHUNK_BYTES = 1 << 20
# odd multipliers of the polynomial hashes (fixed values)
_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _random(key: np.ndarray) -> np.ndarray:
    """A random number for each (byte, place), place * 256 + byte."""
    return mix((key.astype(np.uint64) + np.uint64(1)) * _P)


_TABLE = _random(np.arange(64 * 256))  # of the first places of a word


def slices(batches: Iterable, column: str | list[str] = "text", max_bytes: int = CHUNK_BYTES) -> Iterator:
    """Slices of Arrow batches holding at most ``max_bytes`` of ``column``,
    or of several columns together (one row at least); an empty batch gives
    nothing."""
    import pyarrow.compute as pc

    columns = [column] if isinstance(column, str) else column

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        lo = 0
        while lo < n:
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null is an empty text."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class Words:
    """The words of several texts: byte spans in ``buf`` and owning text."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.joined = b"\n".join(texts)
        self.buf = np.frombuffer(self.joined, dtype=np.uint8)
        lens = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lens)])[:-1] if len(texts) else np.zeros(0, np.int64)
        inside = ~_WS[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # first word of each text
        self._inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: the sum of one random number per
        (byte, place).  (A polynomial modulo 2^64 would give some unlike
        words of a thousand letters equal hashes, whatever its factor.)"""
        if not len(self):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        at = np.flatnonzero(self._inside)
        place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
        key = place * 256 + self.buf[at]
        near = key < len(_TABLE)
        if near.all():
            value = _TABLE[key]
        else:
            value = _TABLE[np.where(near, key, 0)]
            value[~near] = _random(key[~near])
        return mix(np.add.reduceat(value, np.cumsum(length) - length))

    def windows(self, hashes: np.ndarray, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hash of ``size`` consecutive words at each word, and whether they
        all lie in one text."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(n, np.uint64)
        factor = np.uint64((2 * seed + 1) * int(_M2) & (2**64 - 1))
        for j in range(size):
            out *= factor
            out += hashes[j : j + n]
        return mix(out), self.doc[:n] == self.doc[size - 1 :]
