"""Words and word windows of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D)
in the UTF-8 text; the white-space bytes never occur inside a multi-byte
character, so bytes and characters give the same words. Hashes are polynomial
sums mod 2^64 over prefix sums, then mixed; equal word sequences have equal
hashes in every batch. Two given different sequences collide with a chance near
2^-64, unless words of over 1,000 letters were built to collide; among n windows
the chance of any collision is about n^2 / 2^65. Where that is too much, windows
are compared by a second hash with another base too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NULL = np.iinfo(np.int64).min

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93, "other": 0xA0761D6478BD642F}
_MASK = (1 << 64) - 1
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < n."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 19)
        out = []
        for b in (_BASE[kind], pow(_BASE[kind], -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[kind] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def forget_powers() -> None:
    """Frees the tables of powers; they are made anew when needed."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of several texts.

    starts, ends: byte places in buf; first: index of each text's first word
    (one more entry at the end); hashes: one uint64 a word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            up = (self.buf >= 65) & (self.buf <= 90)
            self.buf = self.buf + (up.view(np.uint8) << 5)
        self.at = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = ~_SPACE[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)
        forward, back = _power("byte", len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.multiply(self.buf, forward[: len(self.buf)], out=total[1:])
        np.cumsum(total[1:], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * back[self.starts]
        self.hashes = mix(h + (self.ends - self.starts).astype(np.uint64))

    def windows(self, size: int, kind: str = "word") -> tuple[np.ndarray, np.ndarray]:
        """Start words of all windows of size words inside one text, and their hashes (kind "other": by another base)."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        forward, back = _power(kind, n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * forward[:n], dtype=np.uint64)])
        h = (total[size:] - total[:-size]) * back[: n - size + 1]
        last = np.repeat(self.first[1:], self.counts)[: n - size + 1]
        at = np.flatnonzero(np.arange(n - size + 1) + size <= last)
        return at, mix(h[at] + np.uint64(size))

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def sequence_hash(self, i: int) -> np.uint64:
        """Hash of all words of text i as one window."""
        w = self.hashes[self.first[i] : self.first[i + 1]]
        forward, _ = _power("word", len(w) + 1)
        return mix((w * forward[: len(w)]).sum(dtype=np.uint64).reshape(1) + np.uint64(len(w)))[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of the batches of about most text bytes, with their texts; a null text is empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo).to_pylist()
            lo = hi


def longs(column: pa.Array) -> np.ndarray:
    """A column as int64; null becomes the smallest value."""
    return pc.fill_null(column.cast(pa.int64()), NULL).to_numpy(zero_copy_only=False)
