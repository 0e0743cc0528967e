"""Periodic runs in texts, by internal pattern matching.

A run is a stretch of words with smallest period q (words q apart are equal), at least max(12, 2q) words
long, that no neighbouring word extends.  The words of some texts get numbers, exact ones, and a suffix
array by prefix doubling; a text's suffixes are sorted among themselves.  While the doubling passes
blocks of 4, 8, 16, ... words it notes where the blocks at regular places have their range of the suffix
array.  A run of period q holds such a block, of about a quarter of q words, together with its copy q words
on.  So the block is asked for in the window of those distances: a wavelet matrix over the suffix array gives the
next occurrence at or after a place (range successor).  Occurrences that overlap by half a block or more form
a progression whose step is the block's own period; one question finds it whole.  A progression
that the block itself lies in has multiples of the step only, which are no smallest periods, and is passed over;
each term of any other is a candidate period.

Candidates are extended both ways by binary search over sums of random word weights, and what comes out
is compared word by word.  Of equal stretches the smallest period stays.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import _SPACE, Words, _power_table, mix, slices

LEAST = 12
FIRST_BLOCK, FIRST_STRIDE, FIRST_REACH = 4, 3, 14
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class WaveletMatrix:
    """Numbers below 2**levels; how many in a range are below x, and the k-th smallest of a range."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.n, self.levels = n, max(1, int(values.max(initial=0)).bit_length())
        self.blocks, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = ((values >> level) & 1).astype(np.uint8)
            padded = np.zeros(-(-(n + 1) // 64) * 64, dtype=np.uint8)
            padded[:n] = bits
            block = np.packbits(padded, bitorder="little").view(np.uint64)
            self.blocks.append(block)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(block), dtype=np.int64))))
            self.zeros.append(n - int(bits.sum()))
            values = np.concatenate((values[bits == 0], values[bits == 1]))

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        inside = self.blocks[k][at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[k][at >> 6] + np.bitwise_count(inside)

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        found, low, high = np.zeros(len(x), dtype=np.int64), low.copy(), high.copy()
        for k in range(self.levels):
            one = ((x >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, low), self._ones(k, high)
            found += np.where(one, (high - b) - (low - a), 0)
            low, high = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, high - b)
        return np.where(x >> self.levels > 0, np.int64(1) << 62, found)

    def smallest(self, low: np.ndarray, high: np.ndarray, k_th: np.ndarray) -> np.ndarray:
        found, low, high, k_th = np.zeros(len(low), dtype=np.int64), low.copy(), high.copy(), k_th.copy()
        for k in range(self.levels):
            a, b = self._ones(k, low), self._ones(k, high)
            zeros = (high - b) - (low - a)
            one = k_th >= zeros
            k_th -= np.where(one, zeros, 0)
            found = (found << 1) | one
            low, high = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, high - b)
        return found

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest number >= x in the range; -1 if there is none."""
        k = self.below(low, high, x)
        out = np.full(len(x), -1, dtype=np.int64)
        some = np.flatnonzero(k < high - low)
        out[some] = self.smallest(low[some], high[some], k[some])
        return out


class Blocks:
    """A suffix array of texts sorted by prefix doubling, and the ranges of blocks noted on the way."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n, count = len(words), np.diff(first)
        text = np.repeat(np.arange(len(count)), count)
        self.end = first[1:][text]  # of the text that a place is in
        place = np.arange(n) - first[text]
        key = text * np.int64(words.max(initial=0) + 1) + words
        self.suffixes, rank, size = np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, n, dtype=np.int64)
        live = np.arange(n)
        self.asked: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # block, places, ranges
        h, most = 1, int(count.max(initial=0))
        while True:
            self._refine(key, live, rank, size)
            live = live[size[live] > 1]
            if h >= FIRST_BLOCK:
                stride = FIRST_STRIDE if h == FIRST_BLOCK else h
                at = live[(place[live] % stride == 0) & (live + h <= self.end[live])]
                self.asked.append((h, at, rank[at], rank[at] + size[at]))
            # Blocks of h words serve periods up to 4h - 2, at most half of a text.
            if not len(live) or (h >= FIRST_BLOCK and 2 * (4 * h - 1) > most):
                break
            after = live + h
            inside = after < self.end[live]
            key = rank[live] * np.int64(n + 1)
            key[inside] += rank[after[inside]] + 1
            h *= 2

    def _refine(self, key: np.ndarray, live: np.ndarray, rank: np.ndarray, size: np.ndarray) -> None:
        """Sort the suffixes `live` by key, each inside its range [rank, rank + size)."""
        if not len(live):
            return
        order = np.argsort(key, kind="stable")
        sorted_, key = live[order], key[order]
        old = rank[sorted_]
        begins = np.concatenate(([True], old[1:] != old[:-1]))
        at = np.flatnonzero(begins)
        inner = np.arange(len(old)) - np.repeat(at, np.diff(np.append(at, len(old))))
        self.suffixes[old + inner] = sorted_
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        lengths = np.diff(np.append(starts, len(key)))
        rank[sorted_] = np.repeat((old + inner)[starts], lengths)
        size[sorted_] = np.repeat(lengths, lengths)


class Agreement:
    """How far two places of one text agree, forwards and backwards."""

    def __init__(self, words: np.ndarray, text_first: np.ndarray, text_end: np.ndarray):
        self.first, self.end, self.words = text_first, text_end, words
        with np.errstate(over="ignore"):
            weight = mix(words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
            self.up, _ = _power_table(len(words) + 1)
            self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(weight * self.up[: len(words)])))

    def _equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[i + n] - self.sums[i]) * self.up[j - i] == self.sums[j + n] - self.sums[j]

    def _longest(self, room: np.ndarray, equal) -> np.ndarray:
        low = np.zeros(len(room), dtype=np.int64)
        step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
        while step and len(room):
            longer = low + step
            try_ = np.flatnonzero(longer <= room)
            low[try_] = np.where(equal(try_, longer[try_]), longer[try_], low[try_])
            step >>= 1
        return low

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from places i < j on."""
        return self._longest(self.end[i] - j, lambda k, n: self._equal(i[k], j[k], n))

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before places i < j."""
        return self._longest(i - self.first[i], lambda k, n: self._equal(i[k] - n, j[k] - n, n))


class PlainAgreement(Agreement):
    """The same, by the words themselves: for texts in which sums agree where words don't."""

    def _equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        same = (np.array_equal(self.words[a : a + m], self.words[b : b + m]) for a, b, m in zip(i.tolist(), j.tolist(), n.tolist(), strict=True))
        return np.fromiter(same, dtype=bool, count=len(i))


def _ranges(first: np.ndarray, step: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, first + step, ... for each row, and the row of each."""
    row = np.repeat(np.arange(len(first)), count)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return first[row] + inner * step[row], row


def _candidates(blocks: Blocks, agree: Agreement) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods: blocks with a copy that many words on."""
    none = np.zeros(0, dtype=np.int64)
    if not any(len(at) for _, at, _, _ in blocks.asked):
        return none, none
    tree, places, periods = WaveletMatrix(blocks.suffixes), [], []
    for block, at, low, high in blocks.asked:
        if block == FIRST_BLOCK:
            nearest, farthest = 1, FIRST_REACH
            step = np.zeros(len(at), dtype=np.int64)  # so near, every occurrence is asked for
        else:
            nearest, farthest = 2 * block - 1, 4 * block - 2
            after = tree.successor(low, high, at + 1)
            step = np.where((after >= 0) & (2 * (after - at) <= block), after - at, 0)
        ask = at + nearest
        own = np.flatnonzero(step)
        # Past the progression that the block itself lies in.
        ask[own] = np.maximum(ask[own], at[own] + step[own] + agree.forwards(at[own], at[own] + step[own]) - block + 1)
        live = np.flatnonzero(ask <= at + farthest)
        while len(live):
            found = tree.successor(low[live], high[live], ask[live])
            hit = (found >= 0) & (found <= at[live] + farthest)
            live, found = live[hit], found[hit]
            s, d = at[live], step[live]
            count, ask[live] = np.ones(len(live), dtype=np.int64), found + 1
            several = np.flatnonzero(d)
            ends = found[several] + d[several]
            inside = ends < agree.end[s[several]]
            several, ends = several[inside], ends[inside]
            last = ends + agree.forwards(found[several], ends) - block  # where the last of the progression stands
            last = np.maximum(last, found[several])
            ask[live[several]] = last + 1
            count[several] += (np.minimum(last, s[several] + farthest) - found[several]) // d[several]
            q, row = _ranges(found - s, d, count)
            places.append(s[row])
            periods.append(q)
            live = live[ask[live] <= at[live] + farthest]
    return np.concatenate(places or [none]), np.concatenate(periods or [none])


def find_runs(words: np.ndarray, first: np.ndarray, agreement: type[Agreement] = Agreement) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run of the texts words[first[k]:first[k + 1]], by start, then period."""
    none = np.zeros(0, dtype=np.int64)
    if not len(words):
        return none, none, none
    blocks = Blocks(words, first)
    agree = agreement(words, np.repeat(first[:-1], np.diff(first)), blocks.end)
    s, q = _candidates(blocks, agree)
    if not len(s):
        return none, none, none
    start, end = s - agree.backwards(s, s + q), s + q + agree.forwards(s, s + q)
    long = end - start >= np.maximum(LEAST, 2 * q)
    s, q, start, end = s[long], q[long], start[long], end[long]
    order = np.lexsort((q, end, start))
    s, q, start, end = s[order], q[order], start[order], end[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # of equal stretches the smallest period
    s, q, start, end = s[new], q[new], start[new], end[new]
    if _wrong(words, start, end, q).any():
        return find_runs(words, first, PlainAgreement)
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _wrong(words: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray, at_once: int = 1 << 22) -> np.ndarray:
    """Which stretches don't have their period."""
    out, size = np.zeros(len(q), dtype=bool), end - start - q
    upto, a = np.cumsum(size), 0
    while a < len(q):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + at_once, side="right")))
        place, row = _ranges(start[a:b], np.ones(b - a, dtype=np.int64), size[a:b])
        differ = words[place] != words[place + q[a:b][row]]
        out[a + np.unique(row[differ])] = True
        a = b
    return out


def _numbers(w: Words) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    raw = w.data[~_SPACE[w.data]]
    offsets = np.concatenate(([0], np.cumsum(w.ends - w.starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(w.starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _repeating(numbers: np.ndarray, w: Words) -> np.ndarray:
    """Texts in which some FIRST_BLOCK words may occur twice, as all texts with runs do."""
    m = len(numbers) - FIRST_BLOCK + 1
    if m <= 0:
        return np.zeros(len(w.count), dtype=bool)
    with np.errstate(over="ignore"):
        key = mix(w.doc[:m].astype(np.uint64))
        for k in range(FIRST_BLOCK):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + numbers[k : m + k].astype(np.uint64))
    at = np.flatnonzero(w.doc[:m] == w.doc[FIRST_BLOCK - 1 :])
    order = np.argsort(key[at])
    key = key[at][order]
    out = np.zeros(len(w.count), dtype=bool)
    out[w.doc[at[order[1:][key[1:] == key[:-1]]]]] = True
    return out & (w.count >= LEAST)


def cycled(doc_ids: list, w: Words) -> np.ndarray:
    """For each word of a text the word that stands there: in a tenth of the texts, chosen by the
    crc32 h of the decimal doc_id, a stretch at the end is made to repeat its first words."""
    source = np.arange(len(w.starts))
    for k, doc_id in enumerate(doc_ids):
        n = int(w.count[k])
        if doc_id is None or not n:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            begin = int(w.first[k]) + a
            source[begin : begin + n - a] = begin + np.arange(n - a) % p
    return source


def _report(cycle: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, offsets in slices(batch.column("text")):
                yield _rows(ids.slice(a, b - a), Words(data, offsets, hashes=False), cycle)

    return run


def _rows(ids: pa.Array, w: Words, cycle: bool) -> pa.RecordBatch:
    source = cycled(ids.to_pylist(), w) if cycle else np.arange(len(w.starts))
    numbers = _numbers(w)[source]
    texts = np.flatnonzero(_repeating(numbers, w))
    # The texts that may have runs, one after the other.
    count = w.count[texts]
    place, _ = _ranges(w.first[:-1][texts], np.ones(len(texts), dtype=np.int64), count)
    start, end, period = find_runs(numbers[place], np.concatenate(([0], np.cumsum(count))))
    if len(start):
        end, start = place[end - 1] + 1, place[start]
    of = w.doc[start] if len(start) else start
    length = end - start
    local = start - w.first[of]
    # Words after the first period of a run go.
    edge = np.zeros(len(source) + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    stays = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    word = source[stays]
    size = (w.ends - w.starts)[word] + 1
    out = np.concatenate(([0], np.cumsum(size)))
    raw = np.append(w.data, np.uint8(32))[np.arange(out[-1]) + np.repeat(w.starts[word] - out[:-1], size)]
    raw[out[1:] - 1] = 32
    upto = np.searchsorted(stays, w.first)
    cuts = np.searchsorted(of, np.arange(len(w.count) + 1))
    best = np.lexsort((period, local, -length, of))
    n_runs = np.diff(cuts)
    some = n_runs > 0
    top = best[np.minimum(cuts[:-1], max(0, len(best) - 1))] if len(best) else np.zeros(len(some), dtype=np.int64)

    def of_top(values: np.ndarray) -> pa.Array:
        return pa.array(values[top] if len(values) else np.zeros(len(some), dtype=np.int64), mask=~some, type=pa.int64())

    digests, collapsed, view = [], [], raw.data
    rows = list(zip(local.tolist(), length.tolist(), period.tolist(), strict=True))
    nothing = hashlib.sha256(b"").hexdigest()
    for k in range(len(some)):
        digests.append(hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in rows[cuts[k] : cuts[k + 1]]).encode()).hexdigest() if some[k] else nothing)
        first, last = out[upto[k]], out[upto[k + 1]] - 1
        collapsed.append(hashlib.sha256(view[first : max(first, last)]).hexdigest())
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), pa.array(n_runs.astype(np.int64)), of_top(local), of_top(length), of_top(period), of_top(1000 * length // np.maximum(period, 1)), pa.array(digests, type=pa.string()), pa.array(collapsed, type=pa.string())],
        names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    )


def periodic_runs(docs: DataFrame, cycle: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256: a row for each row of docs.

    start, length, period and exponent_milli (1000 lengths per period, rounded down) are those of the longest run (ties:
    smallest start, then period), null if there is none.  runs_sha256 is the hash of a line
    `start,length,period` for each run by start, then period; collapsed_sha256 that of the words,
    joined by one space, without those that a run holds after its first period.  With `cycle` the texts
    are first rewritten as `cycled` says; a row without doc_id is left as it is.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  A null or empty text has no words
    and no runs.  Each row counts by itself, so repeated rows and doc_ids are no special case; other
    columns are ignored, and an empty table gives an empty result.  There is no shuffle; a text is a
    row of one task, whose memory grows with the longest text.
    """
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_report(cycle), _SCHEMA)
