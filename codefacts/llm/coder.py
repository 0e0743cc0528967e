"""An adaptive context-mixing range coder for token ids, in blocks that stand alone.

A segment's header holds what each of its blocks starts from: the segment's ids with their frequencies
(order 0), and for each id the one that most often follows it, with how often (order 1).  Within a
block three predictors guess the next id: the id that last followed the two before it (order 2), the
one before it (order 1; until the block has its own, the header's), and the commonest so far (order 0).
Each knows how often guesses of its confidence came true; the probabilities of those that agree with
the guess of the highest order are mixed in the logistic domain, with weights that learn as the block
goes on.  The mixed probability drives the range coder: it codes whether the guess is right, and if
not, the id by its frequency, in one go.

A block starts from the same state whatever came before, and carries its length and a checksum of
its ids.  Many blocks are coded in step, a numpy lane for each, so the model's work is vectorised
across blocks; all arithmetic is in integers, so that any machine reads what another wrote.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

BLOCK_IDS = 2048
LANES = 4096
_SLOTS = 11  # log2 of a block's table sizes
_WORD = np.uint64(16)
_FLAG = np.uint64(12)  # log2 of a flag's frequencies
_WIDE = np.uint64(1 << 48)  # the least range between ids
_PIECE = 1 << 20  # ids counted at once
_LOOK = 18  # log2 of the decoder's table of symbols
_WEIGHT = 3 << 16  # the largest weight, three
_LEAST = 32  # chance of 65536
_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(_LEAST >> 4, 4096)], dtype=np.int32)
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], dtype=np.int32)


_CLASSES = 16  # of confidence: 8 of the block's own guesses, 8 of the header's


class _Start:
    """What blocks start from: symbols (ids in order), their cumulative frequencies of 2**bits, and for
    each the symbol that follows it most often (-1: none does so often) with a class of confidence."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, follower: np.ndarray, confidence: np.ndarray):
        self.symbols, self.counts, self.follower, self.confidence = symbols, counts, follower, confidence
        self.bits = min(28, max(16, len(symbols).bit_length() + 6))
        room = (1 << self.bits) - len(symbols)
        self.frequency = (1 + counts * room // max(1, int(counts.sum()))).astype(np.uint64)
        self.cumulative = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.frequency)))
        # Guesses as in the model's tables; a block's first id follows none: symbol len(symbols).
        self.head = np.append(np.where(follower < 0, 0, follower << 4 | 8 | confidence), 0).astype(np.uint32)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[_Start, np.ndarray]:
        """The start for these ids, and the ids as places among the symbols."""
        if len(ids) and int(ids.max()) < 1 << 20:
            counts = np.sum([np.bincount(ids[a : a + _PIECE], minlength=int(ids.max()) + 1) for a in range(0, len(ids), _PIECE)], axis=0)
            symbols = np.flatnonzero(counts)
            place = np.zeros(len(counts), dtype=np.uint32)
            place[symbols] = np.arange(len(symbols))
            places, counts = place[ids], counts[symbols]
        else:
            symbols, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
        n = len(symbols)
        follower, confidence = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        if len(ids) > 1:
            kind = np.uint32 if n < 1 << 16 else np.uint64
            pairs = places[:-1].astype(kind)
            pairs *= kind(n)
            pairs += places[1:].astype(kind, copy=False)
            pairs.sort()
            at = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
            often = np.diff(np.append(at, len(pairs)))
            at, often = at[often >= 3], often[often >= 3]
            first, second = np.divmod(pairs[at].astype(np.int64), n)
            starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else first
            most = np.repeat(np.maximum.reduceat(often, starts), np.diff(np.append(starts, len(first)))) if len(first) else often
            best = np.flatnonzero(often == most)[::-1]  # of equally often ones the first stays
            best = best[16 * often[best] >= counts[first[best]]]
            follower[first[best]] = second[best]
            confidence[first[best]] = np.minimum(7, 8 * often[best] // counts[first[best]])
        return cls(symbols.astype(np.int64), counts.astype(np.int64), follower, confidence), places.astype(np.uint32)

    def pack(self) -> bytes:
        columns = (np.diff(self.symbols, prepend=0), self.counts, self.follower + 1, self.confidence)
        planes = np.stack(columns).astype("<u4").view(np.uint8).reshape(4, -1, 4).transpose(0, 2, 1)
        return zlib.compress(np.ascontiguousarray(planes).tobytes(), 6)

    @classmethod
    def unpack(cls, raw: bytes) -> _Start:
        planes = np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(4, 4, -1).transpose(0, 2, 1)
        steps, counts, follower, confidence = np.ascontiguousarray(planes).view("<u4").reshape(4, -1).astype(np.int64)
        return cls(np.cumsum(steps), counts, follower - 1, confidence)

    def finder(self):
        """A function from values below 2**bits to the symbols whose frequencies hold them."""
        shift = np.uint64(max(0, self.bits - _LOOK))
        firsts = np.arange(1 << min(self.bits, _LOOK), dtype=np.uint64) << shift
        table = (np.searchsorted(self.cumulative, firsts, side="right") - 1).clip(0, len(self.symbols) - 1).astype(np.uint32)
        ends = self.cumulative[1:]

        def find(values: np.ndarray) -> np.ndarray:
            found = table.take(values >> shift)
            far = (ends.take(found) <= values).nonzero()[0]  # a table's entry holds several symbols
            if len(far):
                found[far] = np.minimum(np.searchsorted(ends, values[far], side="right"), len(ends) - 1)
            return found

        return find


class _Model:
    """State of the predictors for every lane; ids are places among the start's symbols.

    Arrays have a row for each order (1, 2, 0).  A guess is held as 16 times the place plus a class of
    confidence (0: none, 1 to 7: the block's own, from 8 on: the header's).
    """

    def __init__(self, lanes: int, start: _Start):
        self.head = start.head
        self.base = np.arange(2 * lanes).reshape(2, lanes) << _SLOTS
        self.table = np.zeros(2 * lanes << _SLOTS, dtype=np.uint32)
        self.times = np.zeros(lanes << _SLOTS, dtype=np.uint16)  # that an id has been seen, by its slot of order 1
        self.guesses = np.zeros((3, lanes), dtype=np.uint32)
        self.guesses[2] = int(np.argmax(start.counts)) if len(start.counts) else 0
        self.most = np.zeros(lanes, dtype=np.uint16)
        # Chance of coming true by class, above the least: a quarter, or what the header's class says.
        first = np.array([1 << 14] * 8 + [(2 * c + 1) << 12 for c in range(8)], dtype=np.int32) - _LEAST
        self.right = np.tile(first, 3 * lanes)
        self.rows = np.arange(3 * lanes).reshape(3, lanes) * _CLASSES
        self.at = self.rows.copy()
        self.weight = np.full((3, lanes), 1 << 15, dtype=np.int32)
        self.steps = 0
        self.contexts = np.zeros((2, lanes), dtype=np.uint32)
        self._enter(np.full(lanes, len(start.symbols), dtype=np.uint32))

    def _enter(self, ids: np.ndarray) -> None:
        """Take up the guesses for what follows these ids and those before them."""
        self.contexts[1] = (self.contexts[0] * 40503) + ids
        np.add(ids, 1, out=self.contexts[0])
        self.slots = self.base + ((self.contexts * 0x2545F491) >> (32 - _SLOTS))
        self.held = held = self.table.take(self.slots)
        self.trust = held & 15
        held[0] = np.where(self.trust[0] == 0, self.head.take(ids), held[0])

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The guess of the highest order that has one, and its frequency (of 4096) of coming true."""
        guesses, classes = self.guesses, self.held & 15
        np.right_shift(self.held, 4, out=guesses[:2])
        np.add(self.rows[:2], classes, out=self.at[:2])
        np.add(self.rows[2], np.minimum(self.most >> 4, 7), out=self.at[2])
        known = classes > 0
        self.guess = np.where(known[1], guesses[1], np.where(known[0], guesses[0], guesses[2]))
        self.chance = self.right.take(self.at)
        self.inputs = _STRETCH.take(self.chance >> 4)
        self.inputs *= guesses == self.guess
        weighed = self.weight * self.inputs
        dot = weighed[0]
        dot += weighed[1]
        dot += weighed[2]
        dot >>= 16
        dot += 2047
        self.p = _SQUASH.take(dot, mode="clip")
        return self.guess, self.p

    def update(self, ids: np.ndarray) -> None:
        err = (ids == self.guess) * np.int32(4096)
        err -= self.p
        self.inputs *= err
        self.inputs >>= 10
        self.weight += self.inputs
        self.steps += 1
        if self.steps % 8 == 0:  # between, no product leaves 32 bits
            np.clip(self.weight, -_WEIGHT, _WEIGHT, out=self.weight)
        hit = self.guesses == ids
        more = hit * np.int32(65535 - 2 * _LEAST)
        more -= self.chance
        more >>= 5
        more += self.chance
        self.right[self.at] = more
        trust = np.where(hit[:2], np.minimum(self.trust + 1, 7), self.trust >> 1)
        kept = self.guesses[:2] << 4
        kept |= trust
        self.table[self.slots] = np.where(trust > 0, kept, (ids << 4) | 1)
        self._enter(ids)
        slot = self.slots[0]
        n = self.times.take(slot)
        n += 1
        self.times[slot] = n
        self.guesses[2] = np.where(n > self.most, ids, self.guesses[2])
        np.maximum(n, self.most, out=self.most)


class _Writer:
    """Range coder for every lane: 64-bit low and range, 16-bit words.  An id is coded in one go, the flag
    and after a wrong guess the symbol, and then words move out until the range has 48 bits again.  What
    low overflows by is added to the words before."""

    def __init__(self, lanes: int, steps: int, start: _Start):
        self.frequency, self.cumulative, self.bits = start.frequency, start.cumulative, np.uint64(start.bits)
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.range = np.full(lanes, np.iinfo(np.uint64).max, dtype=np.uint64)
        width = steps * (12 + start.bits) // 16 + 8
        self.words = np.zeros(lanes * width, dtype=np.uint16)
        self.first = np.arange(lanes) * width
        self.next = self.first.copy()

    def _add(self, lanes: int, more: np.ndarray) -> None:
        low = self.low[:lanes]
        low += more
        at = self.next[(low < more).nonzero()[0]] - 1
        while len(at):
            word = self.words[at] + np.uint16(1)
            self.words[at] = word
            at = at[word == 0] - 1

    def put(self, ids: np.ndarray, hit: np.ndarray, p: np.ndarray) -> None:
        """The ids of the first lanes, whether the guess was right, and how often of 4096 it is."""
        n = len(ids)
        p = p.astype(np.uint64)
        step = self.range[:n] >> _FLAG
        flag = step * p
        fine = ((step << _FLAG) - flag) >> self.bits
        self.range[:n] = np.where(hit, flag, fine * self.frequency.take(ids))
        self._add(n, np.where(hit, np.uint64(0), flag + fine * self.cumulative.take(ids)))
        go = (self.range[:n] < _WIDE).nonzero()[0]
        while len(go):
            low, wide, at = self.low[go], self.range[go] << _WORD, self.next[go]
            self.words[at] = low >> np.uint64(48)
            self.next[go], self.low[go], self.range[go] = at + 1, low << _WORD, wide
            go = go[wide < _WIDE]

    def finish(self) -> list[bytes]:
        """Every lane's words; the last is the least that lies within the range with zeros behind it."""
        self._add(len(self.low), np.full(len(self.low), _WIDE - np.uint64(1)))
        self.words[self.next] = self.low >> np.uint64(48)
        return [self.words[a : b + 1].astype("<u2").tobytes() for a, b in zip(self.first, self.next, strict=True)]


class _Reader:
    """Reads what _Writer wrote; holds how far the words lie above low."""

    def __init__(self, parts: list[bytes], start: _Start):
        self.frequency, self.cumulative, self.bits = start.frequency, start.cumulative, np.uint64(start.bits)
        self.last, self.find = np.uint64((1 << start.bits) - 1), start.finder()
        width = max(len(p) for p in parts) // 2 + 4
        self.words = np.zeros((len(parts), width), dtype=np.uint16)
        for k, p in enumerate(parts):
            w = np.frombuffer(p, dtype="<u2")
            self.words[k, : len(w)] = w
        self.above = np.zeros(len(parts), dtype=np.uint64)
        for k in range(4):
            self.above = (self.above << _WORD) | self.words[:, k]
        self.words = self.words.ravel()
        self.range = np.full(len(parts), np.iinfo(np.uint64).max, dtype=np.uint64)
        self.next = np.arange(len(parts)) * width + 4

    def take(self, guess: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The ids of the first lanes, whose guess is right p times of 4096."""
        n = len(guess)
        p, ids = p.astype(np.uint64), guess.copy()
        above, wide = self.above[:n], self.range[:n]
        step = wide >> _FLAG
        flag = step * p
        miss = (above >= flag).nonzero()[0]
        fine = (((step << _FLAG) - flag) >> self.bits)[miss]
        rest = above[miss] - flag[miss]
        found = self.find(np.minimum(rest // fine, self.last))
        ids[miss] = found
        above[miss] = rest - fine * self.cumulative.take(found)
        wide[:] = flag
        wide[miss] = fine * self.frequency.take(found)
        go = (wide < _WIDE).nonzero()[0]
        while len(go):
            at, more = self.next[go], wide[go] << _WORD
            # Damaged words may lead beyond the end; the checksum tells.
            above[go] = (above[go] << _WORD) | self.words.take(at, mode="clip")
            self.next[go], wide[go] = at + 1, more
            go = go[more < _WIDE]
        return ids


def _running(lengths: np.ndarray) -> list[int]:
    """For each step the lanes still running in it; lanes must be sorted by falling length."""
    return np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right").tolist()


def _encode_lanes(blocks: list[np.ndarray], start: _Start) -> list[bytes]:
    """Coded blocks; only the last of them may be shorter than the others."""
    lengths = np.array([len(b) for b in blocks])
    ids = np.zeros((len(blocks), lengths[0]), dtype=np.uint32)
    for k, b in enumerate(blocks):
        ids[k, : len(b)] = b
    ids = np.ascontiguousarray(ids.T)
    model, out = _Model(len(blocks), start), _Writer(len(blocks), len(ids), start)
    for now, n in zip(ids, _running(lengths), strict=True):
        guess, p = model.predict()
        out.put(now[:n], (now == guess)[:n], p[:n])
        model.update(now)
    return out.finish()


def _decode_lanes(parts: list[bytes], lengths: np.ndarray, start: _Start) -> list[np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    ids = np.zeros((lengths[0], len(parts)), dtype=np.uint32)
    model, source = _Model(len(parts), start), _Reader([parts[o] for o in order], start)
    for now, n in zip(ids, _running(lengths), strict=True):
        guess, p = model.predict()
        now[:n] = source.take(guess[:n], p[:n])
        model.update(now)
    ids = np.ascontiguousarray(ids.T)
    back = [ids[0][:0]] * len(parts)
    for k, o in enumerate(order):
        back[o] = ids[k, : lengths[k]]
    return back


def encode(ids: np.ndarray, block: int = BLOCK_IDS, lanes: int = LANES) -> bytes:
    """Ids (0 to 2**32 - 1) as bytes: number of blocks and bytes of the start, the start, then for each
    block its ids, bytes and crc32 (little-endian 32-bit), then the coded blocks."""
    start, places = _Start.of(ids)
    blocks = [places[a : a + block] for a in range(0, len(ids), block)]
    coded: list[bytes] = []
    for a in range(0, len(blocks), lanes):
        coded += _encode_lanes(blocks[a : a + lanes], start)
    head = []
    for k, c in enumerate(coded):
        own = ids[k * block : (k + 1) * block]
        head += [len(own), len(c), zlib.crc32(own.astype("<u4").tobytes())]
    packed = start.pack()
    return np.array([len(blocks), len(packed)], dtype="<u4").tobytes() + packed + np.array(head, dtype="<u4").tobytes() + b"".join(coded)


def _opened(raw: bytes) -> tuple[_Start, np.ndarray, np.ndarray]:
    """The start, a row (ids, bytes, crc32) for each block, and where the blocks begin and end."""
    n, size = np.frombuffer(raw, dtype="<u4", count=2).tolist()
    head = np.frombuffer(raw, dtype="<u4", count=3 * n, offset=8 + size).reshape(n, 3).astype(np.int64)
    return _Start.unpack(raw[8 : 8 + size]), head, 8 + size + 12 * n + np.concatenate(([0], np.cumsum(head[:, 1])))


def decode(raw: bytes, first: int = 0, count: int | None = None, lanes: int = LANES) -> np.ndarray:
    """The ids of encode(), of `count` blocks from block `first` on (all, by default), which alone are
    read; a block that doesn't match its checksum is an error."""
    start, head, at = _opened(raw)
    n = len(head) if count is None else min(len(head), first + count)
    out: list[np.ndarray] = []
    for a in range(first, n, lanes):
        rows = range(a, min(n, a + lanes))
        out += _decode_lanes([raw[at[k] : at[k + 1]] for k in rows], head[rows.start : rows.stop, 0], start)
    ids = [start.symbols[b].astype("<u4") for b in out]
    for k, b in enumerate(ids, first):
        if zlib.crc32(b.tobytes()) != head[k, 2]:
            raise ValueError(f"block {k} of {len(head)} doesn't match its checksum")
    return np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, dtype=np.uint32)
