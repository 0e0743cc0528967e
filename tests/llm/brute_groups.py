"""Plain versions of operators 11 to 13, one document or table at a time."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def exact(rows):
    """(doc_id, text) rows -> sorted (doc_id, keep_id, group_size, sha256), and kept rows by text."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            out.append((i, max(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return out, groups


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    for c in own:
        own[c].sort()
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])
        rebuilt[c] = tuple((r, t) for _, r, t in base[:h] + own[c][h:])
    nodes = defaultdict(set)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].add(c)
    kids = defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(nodes, key=len, reverse=True):
        if not kids[p]:
            leaves[p] += 1
        if p:
            saved[p] += (len(nodes[p]) - 1) * len(p[-1][1])
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = defaultdict(list)
    for c, seq in rebuilt.items():
        ends[seq].append(c)
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in nodes.items()
    )


def runs_of(x, least=12):
    """(start, end, smallest period) of the runs of a list, trying every period."""
    n, found = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b, q) for (a, b), q in found.items())


def periodic(doc_id, text):
    """A row of the operator's result, and its cycled words."""
    words = WORD.findall((text or "").encode())
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found, gone = runs_of(words), set()
    for a, b, q in found:
        gone.update(range(a + q, b))
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(found, key=lambda r: (r[0], r[2])))
    best = min(((a - b, a, q) for a, b, q in found), default=None)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
