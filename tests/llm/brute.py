"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def fold(b):
    return bytes(c | 32 if 65 <= c <= 90 else c for c in b)


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text, n):
    w = [fold(x) for x in words(text)]
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def near_duplicates(docs, percent, n):
    """docs: [(doc_id, text)] -> {doc_id: (size, component, kept)}."""
    sets = {i: shingles(t, n) for i, t in docs}
    where, common, union = defaultdict(list), defaultdict(int), Union()
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[min(a, b), max(a, b)] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            union.join(a, b)
    return {i: (len(s), union.find(i), union.find(i) == i) for i, s in sets.items()}


def without_repeats(docs, window):
    """{doc_id: (words, removed, sha256 of the kept words)}."""
    first = {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in docs:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        kept = b" ".join(x for x, y in zip(w, keep, strict=True) if y)
        out[i] = (len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest())
    return out


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """Target of each source (None last), by resharing the excess until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        got = {s: float(epochs * sizes[s]) if s in capped else rest * weight[s] / share for s in order}
        above = {s for s in order if s not in capped and got[s] > epochs * sizes[s] + 1e-9}
        if not above:
            return got
        capped |= above


def links(vectors, threshold):
    """vectors: [(vec_id, vector, label)] -> {vec_id: (links, component)}, by all pairs within a label."""
    union, count = Union(), {i: 0 for i, _, _ in vectors}
    fit = [(i, np.array(v, dtype=float), c) for i, v, c in vectors if v and c is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for k, (i, x, c) in enumerate(fit):
        for j, y, d in fit[:k]:
            if c == d and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                union.join(i, j)
                count[i] += 1
                count[j] += 1
    return {i: (n, union.find(i)) for i, n in count.items()}
