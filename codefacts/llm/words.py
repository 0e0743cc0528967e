"""Vectorised word work over Arrow string batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All functions look at the
concatenated UTF-8 bytes of many texts at once, so a task spends its time inside numpy and never
holds a Python object per word.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP = np.uint64(0xD6E8FEB86659FD93)
SLICE_BYTES = 2 << 20

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


class Words:
    """The words of some texts: byte range and hash of each, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False, hashes: bool = True, separators: np.ndarray = _SPACE):
        if fold:
            data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
        self.data, self.offsets = data, offsets
        n = len(data)
        space = separators[data]
        edge = np.ones(n + 1, dtype=bool)
        if n:
            edge[1:n] = space[:-1]
            inner = offsets[(offsets > 0) & (offsets < n)]
            edge[inner] = True
            self.starts = np.flatnonzero(~space & edge[:n])
            edge[:n] = np.append(space[1:], True)
            edge[inner - 1] = True
            self.ends = np.flatnonzero(~space & edge[:n]) + 1
        else:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.starts, offsets)  # of text k: words first[k]..first[k + 1]
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        if hashes:
            up, _ = _power_table(n + 1)
            with np.errstate(over="ignore"):
                self.sums = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])
            self.hash = self.hash_of(self.starts, self.ends)

    def hash_of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte range; equal for equal bytes, wherever they stand."""
        _, down = _power_table(len(self.data) + 1)
        with np.errstate(over="ignore"):
            h = (self.sums[ends] - self.sums[starts]) * down[starts]
            return mix(h + (ends - starts).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every n consecutive words of one text, and the index of its first word."""
        h, m = self.hash, len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        g = h[:m].copy()
        with np.errstate(over="ignore"):
            for k in range(1, n):
                g = g * _STEP + h[k : m + k]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(g[at]), at

    def text(self, a: int, b: int) -> bytes:
        """Words a..b joined by one space."""
        d = self.data
        return b" ".join(d[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column with at most `limit` bytes, or one row: (from, to, bytes, offsets)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if column.null_count:  # a null's bytes, if it has any, don't count
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
        _, off, buf = column.buffers()
        offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[:n]
